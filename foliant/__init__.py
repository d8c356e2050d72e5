"""foliant: document-structure and narrative-knowledge analytics on Spark."""
