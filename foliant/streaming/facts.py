"""Facts merged under keyed streaming state (M-01), and runs of a stream that
commit each trigger once, resume after a failure and say how far they came
(M-02, M-03, M-08)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliant.operators.knowledge import normal
from foliant.operators.rolling_scan import after
from foliant.sources.stage import get_json, put_json

OUTCOME = "novel_id string, ord long, key string, id string, outcome string, active string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Accepted facts up to which a novel's state is one entry.
FEW = 512


class Entries(dict):
    """The entries of a map state that are asked for, None where there is none;
    each is read once.  Without a state there are no others."""

    def __init__(self, state=None, have: Iterable[tuple] = ()) -> None:
        super().__init__(have)
        self.state = state

    def __missing__(self, k):
        self[k] = tuple(self.state.getValue((k,))) if self.state is not None and self.state.containsKey((k,)) else None
        return self[k]


def fold(novel, facts: Iterable[tuple], active: Entries, ids: Entries) -> tuple[list[tuple], set, list]:
    """Outcomes of facts (ord, key, id, value, supersedes) in order, on what the
    keys have active and the accepted ids stand for; the keys and ids that changed."""
    out, keys, new = [], set(), []
    for place, key, ident, value, supersedes in facts:
        known, now = ids[ident], active[key] or ()
        if known is not None:
            outcome = "merge" if known == (key, value) else "conflict"
        else:
            now, outcome = after(now, (ident, value, supersedes))
            if outcome in ("new", "replace"):
                active[key], ids[ident] = now, (key, value)
                keys.add(key)
                new.append(ident)
        out.append((novel, place, key, ident, outcome, now[0] if now else None))
    return out, keys, new


class FactMerge(StatefulProcessor):
    """The state of a novel: the active fact of each key and what each accepted id
    stands for, as two maps.  Only entries that a trigger asks for are read and
    only those that it changes are written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "key string", "id string, value string")
        self.ids = handle.getMapState("ids", "id string", "key string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """An entry costs a round trip to the engine: each that the rows ask for is
        read once, and a key's active fact is written once, as the last row leaves
        it."""
        facts = pd.concat(list(rows)).sort_values(["ord", "key", "id", "value"])[["ord", "key", "id", "value", "supersedes"]]
        yield pd.DataFrame(self.spread(key[0], facts.itertuples(index=False, name=None)), columns=["novel_id", "ord", "key", "id", "outcome", "active"])

    def spread(self, novel, facts: Iterable[tuple]) -> list[tuple]:
        active, ids = Entries(self.active), Entries(self.ids)
        out, keys, new = fold(novel, facts, active, ids)
        self.put(((k, active[k]) for k in keys), ((i, ids[i]) for i in new))
        return out

    def put(self, active: Iterable[tuple], ids: Iterable[tuple]) -> None:
        for state, entries in ((self.active, active), (self.ids, ids)):
            for k, v in entries:
                state.updateValue((k,), v)

    def close(self) -> None:
        pass


def place(fact: tuple) -> list[tuple]:
    """Sorts facts by ord, key, id and value, nulls last."""
    return [(x is None, x) if x is not None else (True,) for x in fact[:4]]


FACT = ("ord", "key", "id", "value", "supersedes")


def packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of the facts (JSON texts) that a batch holds of a novel."""
    for pdf in frames:
        of: dict = {}
        for novel, fact in zip(pdf["novel_id"], pdf["fact"], strict=True):
            of.setdefault(novel, []).append(fact)
        yield pd.DataFrame([(novel, f"[{','.join(x)}]") for novel, x in of.items()], columns=["novel_id", "facts"])


class NovelMerge(FactMerge):
    """Takes rows of ``packs`` and gives rows of outcomes: a cell of a row costs the
    engine more time than a fact does.  Up to FEW accepted facts the state of a novel
    is one entry, read and written once a trigger, as most of a trigger of many novels
    would be round trips; a novel that outgrows it has the maps from then on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.few = handle.getValueState("few", "held string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts = [tuple(map(x.get, FACT)) for r in rows for x in json.loads(r["facts"])]
        facts.sort(key=lambda f: [(x is None, x) if x is not None else (True,) for x in f[:4]])
        have = self.few.get()
        if have is not None and have[0] is None:
            out = self.spread(key[0], facts)
        else:
            active, ids = (Entries(None, ((k, tuple(v)) for k, v in x)) for x in (json.loads(have[0]) if have else ([], [])))
            out, keys, new = fold(key[0], facts, active, ids)
            held = [[(k, v) for k, v in x.items() if v is not None] for x in (active, ids)]
            if len(held[1]) > FEW:
                self.put(*held)
                self.few.update((None,))
            elif new:
                self.few.update((json.dumps(held),))
        for some in batched(out, 1000):
            yield Row(novel_id=key[0], found=json.dumps([x[1:] for x in some]))


def merge_facts(stream: DataFrame) -> DataFrame:
    """M-01: outcomes of a stream of facts (novel_id, ord, key, id, value,
    supersedes) under state in RocksDB; facts of one trigger come in order of ord.
    A trigger's facts of one novel meet in memory: bound the trigger, not the
    novel.  Keys and values are compared in normal form."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = normal(stream).withColumn("value", F.coalesce("value", F.lit("\0"))).select("novel_id", F.to_json(F.struct(*FACT)).alias("fact"))
    packed = rows.mapInPandas(packs, "novel_id string, facts string")
    got = packed.groupBy("novel_id").transformWithState(NovelMerge(), "novel_id string, found string", "append", "none")
    got = got.select("novel_id", F.explode(F.from_json("found", "array<array<string>>", {"mode": "FAILFAST"})).alias("x"))
    return got.select("novel_id", *(F.col("x")[k].cast(t).alias(c) for k, (c, t) in enumerate((("ord", "long"), ("key", "string"), ("id", "string"), ("outcome", "string"), ("active", "string")))))


class RunFailed(RuntimeError):
    """M-08: a run that ended early; ``durable`` is the number of its last
    committed trigger (-1 for none) and ``boundary`` what that one reached."""

    def __init__(self, message: str, durable: int, boundary: dict | None) -> None:
        super().__init__(message)
        self.durable, self.boundary = durable, boundary


class Run:
    """A stream's results in a folder that all executors share: a folder a
    trigger, and a commit record for each that is written whole.  The record is
    made last and by one rename, so a trigger without one counts as not done:
    readers don't see it and a restart writes it again."""

    def __init__(self, spark: SparkSession, path: str, identity: str) -> None:
        """M-02: ``identity`` names the source, its cut and what works on it; a
        folder that another identity began is refused."""
        if not identity.strip():
            raise ValueError("identity must name the source and what works on it")
        self.spark, self.path = spark, path.rstrip("/")
        have = self._read("identity")
        if have is None:
            self._write("identity", {"identity": identity})
        elif have["identity"] != identity:
            raise ValueError("the run in this folder belongs to another source or configuration")

    def _read(self, name: str) -> dict | None:
        return get_json(self.spark, f"{self.path}/_run/{name}.json")

    def _write(self, name: str, value: dict) -> None:
        put_json(self.spark, f"{self.path}/_run/{name}.json", value)

    def durable(self) -> tuple[int, dict | None]:
        """(number, boundary) of the last committed trigger."""
        n = -1
        while self._read(f"commit-{n + 1}") is not None:
            n += 1
        return n, self._read(f"commit-{n}")["boundary"] if n >= 0 else None

    def results(self) -> DataFrame:
        """The rows of all committed triggers."""
        n, _ = self.durable()
        schema = self._read("schema")
        if schema is None:
            raise ValueError("nothing is committed")
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(*(f"{self.path}/batch={k}" for k in range(n + 1)))

    def commit(self, batch: DataFrame, number: int, boundary: Callable[[DataFrame], dict] | None, hook: Callable[[str, int], None]) -> None:
        """Writes a trigger's rows, checks that they go on where the last one
        ended, and commits them.  ``boundary`` gives {'start': .., 'end': ..}."""
        if self._read(f"commit-{number}") is not None:
            batch.write.format("noop").mode("overwrite").save()  # its state was lost with the engine's commit
            return
        place = f"{self.path}/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        hook("written", number)
        reached = boundary(self.spark.read.schema(batch.schema).parquet(place)) if boundary else None
        last = self._read(f"commit-{number - 1}")
        if reached and last and last["boundary"] and reached["start"] != last["boundary"]["end"] + 1:
            raise ValueError(f"expected a trigger from {last['boundary']['end'] + 1}, got one from {reached['start']}")
        if not number:
            self._write("schema", json.loads(batch.schema.json()))
        self._write(f"commit-{number}", {"boundary": reached})
        hook("committed", number)

    def go(self, stream: DataFrame, boundary: Callable[[DataFrame], dict] | None = None, hook: Callable[[str, int], None] = lambda what, number: None, output: str = "append") -> tuple[int, dict | None]:
        """Takes all that the source holds and returns what ``durable`` does.  It
        resumes from the checkpoint in the folder: committed triggers aren't run
        again, one that was cut short is.  A failure raises RunFailed with the last
        durable trigger.  ``hook`` is called when a trigger is written and when it
        is committed."""
        query = stream.writeStream.outputMode(output).option("checkpointLocation", f"{self.path}/_run/checkpoint").trigger(availableNow=True)
        query = query.foreachBatch(lambda batch, number: self.commit(batch, number, boundary, hook)).start()
        try:
            query.awaitTermination()
        except Exception as e:
            raise RunFailed(str(e).splitlines()[0][:500], *self.durable()) from e
        return self.durable()
