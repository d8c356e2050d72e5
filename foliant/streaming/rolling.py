"""Rolling state over streams of deltas, with checkpoint and resume (M-01 .. M-08)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.knowledge import normal, step
from foliant.sources.model import sse

STATE = "ids array<string>, id_keys array<string>, id_values array<string>, keys array<string>, active_ids array<string>, active_values array<string>"
OUTCOME = "novel_id string, ord long, key string, id string, outcome string, active string"


def rolling_facts(deltas: DataFrame) -> DataFrame:
    """M-01: outcomes of a stream of facts (novel_id, ord, key, id, value,
    supersedes) under a state per novel that Spark checkpoints.  Facts of one
    trigger are taken in order of ord; keys and values are compared in normal
    form, as in ``knowledge.roll_facts``."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        by_id: dict = {}
        active: dict = {}
        if state.exists:
            ids, id_keys, id_values, keys, active_ids, active_values = state.get
            by_id = {i: (k, v) for i, k, v in zip(ids, id_keys, id_values, strict=True)}
            active = {k: (i, v) for k, i, v in zip(keys, active_ids, active_values, strict=True)}
        out = []
        for r in pd.concat(list(frames)).sort_values("ord").itertuples(index=False):
            outcome = step(r, by_id, active)
            out.append((key[0], r.ord, r.key, r.id, outcome, active[r.key][0] if r.key in active else None))
        state.update((list(by_id), [k for k, _ in by_id.values()], [v for _, v in by_id.values()], list(active), [i for i, _ in active.values()], [v for _, v in active.values()]))
        yield pd.DataFrame(out, columns=["novel_id", "ord", "key", "id", "outcome", "active"])

    return normal(deltas).groupBy("novel_id").applyInPandasWithState(fold, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """M-02, U-04: chunks without a result under their present fingerprint."""
    return chunks.join(done.select("novel_id", "chunk_id", "fingerprint"), ["novel_id", "chunk_id", "fingerprint"], "left_anti")


def commit_each(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """M-03: every trigger's rows go through ``work`` and are written once: a
    batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def progress(stage: str, done: int, total: int) -> dict:
    """M-07: the state of a stage; percent runs from 15 to 90 as the map ends."""
    return {"stage": stage, "completed": done, "total": total, "percent": 15 + int(done / max(total, 1) * 75 + 0.5)}


def progress_events(done: DataFrame) -> DataFrame:
    """M-07, S-10: (pos, event) texts of a table (pos, stage, completed, total)."""
    pct = F.lit(15) + F.floor(F.col("completed") / F.greatest("total", F.lit(1)) * 75 + 0.5)
    return done.select("pos", sse(F.to_json(F.struct("stage", "completed", "total", pct.alias("percent")))).alias("event"))


class Listener(StreamingQueryListener):
    """E-02, M-07: calls ``on_progress`` with the query's name, its trigger and the
    rows so far after every trigger, and ``on_end`` with its error or None."""

    def __init__(self, on_progress: Callable[[dict], None], on_end: Callable[[str | None], None] = lambda error: None) -> None:
        self.on_progress, self.on_end, self.rows = on_progress, on_end, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.on_progress({"stage": p.name, "completed": p.batchId + 1, "rows": self.rows[str(p.id)]})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_end(event.exception)


def cancel(spark, group: str) -> None:
    """M-06: stops the running jobs of a group and starts no more of them."""
    spark.sparkContext.cancelJobGroup(group)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """M-07, E-02: ``df`` and what its next action will have counted on the way:
    aggregates gathered by the tasks that make its rows, without a pass of their
    own.  ``get`` of the observation waits for the action."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen
