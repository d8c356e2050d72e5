"""All registered queries and their oracle SQL."""

from __future__ import annotations

from foliant.plans import app, bible, bibles, checked, documents, identities, knowledge, novels, rolling, structure, tables

MODULES = (documents, tables, novels, structure, knowledge, identities, bible, app, rolling, checked, bibles)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
