"""The rolling merge of facts as a composed scan (F-06, E-05).

What a run of facts does to its key is a function of the active fact before it:
without one, the run's first fact becomes active; an active fact that a fact of
the run supersedes is replaced, unless both have one value; any other stays.  So
a run's function is its result for no fact, a few special facts and a default
that changes nothing, and the functions of two runs compose to one of that form.

Rows are ordered by (novel, ord) in range partitions first, and a novel of at most
BLOCK facts that lies inside one is folded as it passes: nothing of it is guessed or
composed.  The novels at the ends of partitions, which may go on in the next, and
those of more facts are scanned.

These rows are ordered by (novel, key, ord) in range partitions and cut into blocks of
at most BLOCK rows.  Only a key that goes on from one block to the next needs the
function of a block's last or first run; these are composed in a tree of FAN
blocks a node, upwards and down again, which gives each block the fact that is
active before it.  No group of rows grows with a key or a novel.

An id that a novel holds more than once couples its keys: once accepted, later
facts of that id change nothing.  Which facts come later than an accepted one of
their id is guessed (none), the scan is made, and the guess is renewed from what
was accepted until it stays: a fact depends on earlier facts only, so the guess
that stays is the only right one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.knowledge import normal
from foliant.sources.stage import staged

BLOCK, FAN = 4096, 64

State = tuple  # (id, value) of the active fact, or () for none


def after(state: State, fact: tuple) -> tuple[State, str]:
    """The state after a fact (id, value, supersedes) of an id not yet accepted,
    and what became of it."""
    ident, value, supersedes = fact
    if not state:
        return (ident, value), "new"
    if state[1] == value:
        return state, "merge"
    if supersedes is not None and supersedes == state[0]:
        return (ident, value), "replace"
    return state, "conflict"


class Effect:
    """What a run of facts does to the state before it: ``none`` is the state
    after no fact; ``special`` has for an id that the run may replace the
    [(value, state)] it ends in, the first whose value isn't the active one's."""

    def __init__(self, none: State, special: dict[str, list[tuple[str, State]]]) -> None:
        self.none, self.special = none, special

    @staticmethod
    def of(facts: list[tuple]) -> Effect:
        """Of facts (id, value, supersedes) in order.  A fact of the run can't be
        active before it, so what supersedes one of these is never special."""
        own = {f[0] for f in facts}
        state: State = ()
        for f in facts:
            state = after(state, f)[0]
        special: dict[str, list[tuple[str, State]]] = {}
        for i, f in enumerate(facts):
            if f[2] is None or f[2] in own:
                continue
            have = special.setdefault(f[2], [])
            if len(have) < 2 and all(v != f[1] for v, _ in have):
                end: State = (f[0], f[1])
                for g in facts[i + 1 :]:
                    end = after(end, g)[0]
                have.append((f[1], end))
        return Effect(state, special)

    def __call__(self, state: State) -> State:
        if not state:
            return self.none
        for value, end in self.special.get(state[0], ()):
            if value != state[1]:
                return end
        return state

    def then(self, other: Effect) -> Effect:
        """This run's effect and then another's."""
        none = other(self.none)
        special = {i: [(v, other(end)) for v, end in have] for i, have in self.special.items()}
        for i, more in other.special.items():
            have = special.setdefault(i, [])
            for v, end in more:
                if len(have) < 2 and all(v != w for w, _ in have):
                    have.append((v, end))
        return Effect(none, special)


EFFECT = "none array<string>, special array<struct<id:string,value:string,end:array<string>>>"


def packed(e: Effect) -> tuple:
    return list(e.none), [{"id": i, "value": v, "end": list(end)} for i, have in e.special.items() for v, end in have]


def unpacked(none, special) -> Effect:
    found: dict[str, list] = {}
    for x in special if special is not None else ():
        found.setdefault(x["id"], []).append((x["value"], tuple(x["end"])))
    return Effect(tuple(none) if none is not None else (), found)


def _runs(pdf: pd.DataFrame):
    """(novel, key, rows) of the runs of a block in order."""
    held: list = []
    at = None
    for r in pdf.itertuples(index=False):
        if held and (r.novel_id, r.key) != at:
            yield (*at, held)
            held = []
        at = (r.novel_id, r.key)
        held.append(r)
    if held:
        yield (*at, held)


def _effects(rows: DataFrame) -> DataFrame:
    """(novel_id, key, at, none, special) of the first and the last run of each
    block, those that a neighbour may share."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = list(_runs(pdf.sort_values("pos")))
        ends = runs if len(runs) < 2 else [runs[0], runs[-1]]
        out = [(n, k, int(pdf["block"].iloc[0]), *packed(Effect.of([(r.id, r.value, r.supersedes) for r in held if not r.known]))) for n, k, held in ends]
        return pd.DataFrame(out, columns=["novel_id", "key", "at", "none", "special"])

    return rows.groupBy("block").applyInPandas(task, f"novel_id string, key string, at long, {EFFECT}")


def _entries(effects: DataFrame, fan: int) -> DataFrame:
    """(block, entry): the fact that is active before a block's first run, for
    blocks that go on with a key of the block before."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in pdf.sort_values("at").itertuples(index=False):
            e = unpacked(r.none, r.special)
            whole = e if whole is None else whole.then(e)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["novel_id"], first["key"], int(first["at"]) // fan, *packed(whole))], columns=["novel_id", "key", "at", "none", "special"])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        state: State = ()
        for k, r in enumerate(pdf.sort_values("at").itertuples(index=False)):
            if not k and r.entry is not None:
                state = tuple(r.entry)
            out.append((r.novel_id, r.key, r.at, list(state)))
            state = unpacked(r.none, r.special)(state)
        return pd.DataFrame(out, columns=["novel_id", "key", "at", "entry"])

    node = [*(F.col(c) for c in ("novel_id", "key")), F.floor(F.col("at") / fan).alias("up")]
    shared = effects.groupBy("novel_id", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("e.novel_id").eqNullSafe(F.col("s.novel_id")) & F.col("e.key").eqNullSafe(F.col("s.key"))
    levels = [staged(effects.alias("e").join(shared.alias("s"), same, "left_semi"))]
    while not levels[-1].groupBy("novel_id", "key").count().where("count > 1").isEmpty():
        levels.append(staged(levels[-1].groupBy(*node).applyInPandas(lambda _, pdf: up(pdf), f"novel_id string, key string, at long, {EFFECT}")))
    top = levels.pop()
    entries = top.select("novel_id", "key", "at", F.array().cast("array<string>").alias("entry"))
    for level in reversed(levels):
        above = entries.select(F.col("novel_id").alias("_n"), F.col("key").alias("_k"), F.col("at").alias("up"), "entry")
        on = F.col("novel_id").eqNullSafe(F.col("_n")) & F.col("key").eqNullSafe(F.col("_k")) & (F.floor(F.col("at") / fan) == F.col("up"))
        rows = level.join(above, on).select(*level.columns, "entry")
        entries = staged(rows.groupBy(*node).applyInPandas(lambda _, pdf: down(pdf), "novel_id string, key string, at long, entry array<string>"))
    return entries.where(F.size("entry") > 0).select(F.col("at").alias("block"), F.col("novel_id").alias("entry_novel"), F.col("key").alias("entry_key"), "entry")


def _scan(rows: DataFrame, fan: int) -> DataFrame:
    """(novel_id, ord, key, id, value, outcome, active) with the rows marked
    ``known`` changing nothing; their outcome is null."""
    entries = _entries(_effects(rows), fan)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("pos")
        entry = pdf["entry"].iloc[0]
        at = (pdf["entry_novel"].iloc[0], pdf["entry_key"].iloc[0])
        for k, (novel, key, held) in enumerate(_runs(pdf)):
            state: State = tuple(entry) if not k and entry is not None and at == (novel, key) else ()
            for r in held:
                outcome = None
                if not r.known:
                    state, outcome = after(state, (r.id, r.value, r.supersedes))
                out.append((novel, r.ord, key, r.id, r.value, outcome, state[0] if state else None))
        return pd.DataFrame(out, columns=["novel_id", "ord", "key", "id", "value", "outcome", "active"])

    wide = rows.join(entries, "block", "left")
    return wide.groupBy("block").applyInPandas(task, "novel_id string, ord long, key string, id string, value string, outcome string, active string")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with block, numbered without gaps in order of pos; pos holds the
    partition above its 33rd bit.  Only a number a partition meets in one task."""
    part, local = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    have = rows.groupBy(part.alias("_part")).agg((F.floor(F.max(local) / size) + 1).alias("n"))
    before = have.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn("block", F.col("_before") + F.floor(local / size)).drop("_part", "_before")


FACT = ("novel_id", "ord", "key", "id", "value", "supersedes")


def folded(facts: list[tuple]) -> list[tuple]:
    """The facts (as FACT) of one novel in order, each with its outcome and what its
    key has active behind it."""
    ids: dict = {}
    now: dict[str | None, State] = {}
    out = []
    for f in facts:
        _, _, key, ident, value, supersedes = f
        state = now.get(key, ())
        if ident is not None and ident in ids:
            outcome = "merge" if ids[ident] == (key, value) else "conflict"
        else:
            state, outcome = after(state, (ident, value, supersedes))
            if outcome in ("new", "replace"):
                now[key], ids[ident] = state, (key, value)
        out.append((*f, outcome, state[0] if state else None))
    return out


def inside(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over a partition's facts in order of novel: those of the novels that
    lie inside it and have at most ``most`` are folded, the others go on without an
    outcome.  It holds a novel of at most ``most`` facts."""
    schema = pa.schema([(c, pa.int64() if c == "ord" else pa.string()) for c in (*FACT, "outcome", "active")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, held, out = object(), False, [], []
        first = True
        for batch in batches:
            for f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f[0] != at:
                    out += folded(held) if whole else [(*x, None, None) for x in held]
                    at, whole, held, first = f[0], not first, [], False
                held.append(f)
                if not whole or len(held) > most:
                    out += [(*x, None, None) for x in held]
                    whole, held = False, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*x, None, None) for x in held), strict=True), schema.types, strict=True)], schema=schema)

    return task


def roll_facts(deltas: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """F-06, M-01: (novel_id, ord, key, id, outcome, active) of facts (novel_id,
    ord, key, id, value, supersedes), as ``knowledge.roll_facts`` folds them.

    Keys and values are compared in normal form; facts of one ord come by id.  A
    null value is a value of its own; facts without an id are never known.
    """
    given = normal(deltas).select("novel_id", F.col("ord").cast("long").alias("ord"), "key", "id", F.coalesce("value", F.lit("\0")).alias("value"), "supersedes")
    order = ["novel_id", "ord", "key", "id", "value"]  # of one id by key and value, of one key by id
    rows = given.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.mapInArrow(inside(block), "novel_id string, ord long, key string, id string, value string, supersedes string, outcome string, active string"))
    done = rows.where("outcome is not null").select("novel_id", "ord", "key", "id", "outcome", "active")
    return done.unionByName(_composed(rows.where("outcome is null").select(*FACT), block, fan))


def _composed(given: DataFrame, block: int, fan: int) -> DataFrame:
    """What ``roll_facts`` returns of ``given``, by scans."""
    order = ["novel_id", "key", "ord", "id", "value"]
    rows = staged(given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    rows = staged(_blocks(rows, block))
    again = rows.groupBy("novel_id", "id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").drop("n")
    again = staged(again)
    known = rows.withColumn("known", F.lit(False))
    if again.isEmpty():
        return _scan(known, fan).select("novel_id", "ord", "key", "id", "outcome", "active")
    before = None
    while True:
        done = staged(_scan(known, fan))
        took = done.where("outcome in ('new', 'replace')").join(again, ["novel_id", "id"], "left_semi")
        first = took.groupBy("novel_id", "id").agg(F.min(F.struct("ord", "key", "value")).alias("f"))
        first = staged(first.select("novel_id", "id", F.col("f.ord").alias("_ord"), F.col("f.key").alias("_key"), F.col("f.value").alias("_value")))
        mark = first.agg(F.count("*"), F.sum(F.xxhash64("novel_id", "id", "_ord", "_key", "_value").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        late = F.coalesce((F.col("ord") > F.col("_ord")) | ((F.col("ord") == F.col("_ord")) & (F.struct("key", "value") > F.struct("_key", "_value"))), F.lit(False))
        known = staged(rows.join(first, ["novel_id", "id"], "left").withColumn("known", late).select(*rows.columns, "known"))
    same = (F.col("key").eqNullSafe(F.col("_key"))) & (F.col("value") == F.col("_value"))
    got = done.join(first, ["novel_id", "id"], "left")
    outcome = F.coalesce("outcome", F.when(same, "merge").otherwise("conflict"))
    return got.select("novel_id", "ord", "key", "id", outcome.alias("outcome"), "active")
