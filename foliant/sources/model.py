"""The model boundary: recorded or live responses, JSON recovery, usage, errors
(E-01, K-02, K-03, S-10 .. S-16)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import trim
from foliant.sources.stage import staged

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def recorded(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """E-01: requests with their recorded answers (raw), null where none is."""
    return requests.join(responses.select("request_id", "raw"), "request_id", "left")


def in_flight(call: Callable[[str], str], messages: Iterator[tuple], most: int) -> Iterator[tuple]:
    """M-04, M-05: (index, answer, error) of (index, message) pairs, in their order,
    with at most ``most`` calls under way: the next is begun when the oldest is
    handed on, so answers that come early wait in a buffer of that size.  A call
    that fails gives its error; once the reader stops, no call is begun."""

    def one(message: str) -> tuple[str | None, str | None]:
        try:
            return call(message), None
        except Exception as e:  # a failed request is a row, not a lost job
            return None, str(e)

    pool = ThreadPoolExecutor(most)
    waiting: deque = deque()
    try:
        for index, message in messages:
            waiting.append((index, pool.submit(one, message)))
            if len(waiting) >= most:
                index, got = waiting.popleft()
                yield (index, *got.result())
        while waiting:
            index, got = waiting.popleft()
            yield (index, *got.result())
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


#: Bytes of messages that one task of a pool reads at most, or about.
TASK_BYTES = 128 << 20


def live(requests: DataFrame, call: Callable[[str], str], workers: int, each: int = 1) -> DataFrame:
    """E-01, M-04: (request_id, raw, error): answers by ``call`` on (request_id,
    message) rows: ``workers`` tasks with at most ``each`` calls under way in one.
    Rows of a task keep their order whatever their calls take.  A failed call
    gives its error instead; a null message is asked like any other.

    Messages of more than TASK_BYTES a task are dealt to waves of ``workers`` tasks
    that are asked one after the other, their answers written: what a task reads
    doesn't grow with the requests, and no more calls are under way."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = ((r.request_id, r.message) for pdf in frames for r in pdf.itertuples(index=False))
        for some in batched(in_flight(call, asked, each), max(each, 64)):
            yield pd.DataFrame(list(some), columns=["request_id", "raw", "error"])

    kind = requests.schema["request_id"].dataType.simpleString()
    ask = lambda rows: rows.repartition(workers).mapInPandas(task, f"request_id {kind}, raw string, error string")
    rows = requests.select("request_id", "message")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("message"), F.lit(0)) + 16)).first()[0] or 0
    waves = -(-size // (workers * TASK_BYTES))
    if waves <= 1:
        return ask(rows)
    dealt = staged(rows.withColumn("_wave", (F.monotonically_increasing_id() % waves).cast("int")), "_wave")
    return reduce(DataFrame.unionByName, [staged(ask(dealt.where(F.col("_wave") == k).drop("_wave"))) for k in range(waves)])


class Calls:
    """M-06: jobs of model calls under one tag.  ``cancel`` stops those that run and
    lets no more begin; calls under way end with their workers, which the engine
    gives two seconds (spark.python.task.killTimeout)."""

    def __init__(self, spark, tag: str) -> None:
        self.spark, self.tag, self.stopped = spark, tag, False

    def run(self, work: Callable[[], object]) -> object:
        """``work``, an action, under the tag; an error once cancelled."""
        if self.stopped:
            raise RuntimeError(f"{self.tag} is cancelled")
        self.spark.sparkContext.addJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(True)  # else its Python workers go on
        try:
            return work()
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self.spark.sparkContext.setInterruptOnCancel(False)

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


#: What decides where a JSON object ends, one at a time, and the text between.
TOKENS = r'[{}"\\]|[^{}"\\]+'


def balanced(raw: Column) -> Column:
    """K-02: from the first brace to the one that closes it, to the end where none
    does; braces in strings don't count, nor do quotes behind a backslash there.

    The text from the first brace on is cut into tokens and folded by JVM
    functions: depth, whether a string is open, whether the next character is
    escaped, the characters so far and where the object ended.
    """
    first = F.locate("{", raw)
    rest = raw.substr(first, F.length(raw))
    state = "struct<depth:int,quoted:boolean,escaped:boolean,at:int,end:int>"
    start = F.struct(F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0)).cast(state)

    def step(x: Column, t: Column) -> Column:
        at = x["at"] + F.length(t)
        closes = ~x["quoted"] & (t == "}")
        return F.struct(
            F.when(x["quoted"], x["depth"]).when(t == "{", x["depth"] + 1).when(t == "}", x["depth"] - 1).otherwise(x["depth"]).alias("depth"),
            F.when(x["quoted"], (t != '"') | x["escaped"]).otherwise(t == '"').alias("quoted"),
            (x["quoted"] & ~x["escaped"] & (t == "\\")).alias("escaped"),
            at.alias("at"),
            F.when(x["end"] > 0, x["end"]).when(closes & (x["depth"] == 1), at).otherwise(0).alias("end"),
        ).cast(state)

    end = F.aggregate(F.regexp_extract_all(rest, F.lit(TOKENS), F.lit(0)), start, step, lambda x: F.when(x["end"] > 0, x["end"]).otherwise(F.length(rest)))
    return F.when(first == 0, raw).otherwise(rest.substr(F.lit(1), end))


def extract_json(raw: Column) -> Column:
    """K-02: the first fenced block, else the balanced object, else the text."""
    return trim(F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(balanced(raw)))


def json_text(raw: Column) -> Column:
    """A text that parses as ``extract_json`` of ``raw`` does.  One that begins with
    a brace and reads as JSON is taken as it is, as readers stop where its object
    ends; only others are searched for where theirs does."""
    plain = raw.startswith("{") & ~raw.rlike(FENCE) & F.try_parse_json(raw).isNotNull()
    return F.when(plain, raw).otherwise(extract_json(raw))


def parse_json(raw: Column) -> Column:
    """The VARIANT of ``extract_json``, null where that is no JSON."""
    plain = F.when(raw.startswith("{") & ~raw.rlike(FENCE), F.try_parse_json(raw))
    return F.coalesce(plain, F.try_parse_json(extract_json(raw)))


def safe_parse(raw: Column, schema: str, fallback: Column | None = None) -> Column:
    """K-03: parsed by ``schema``; malformed text gives ``fallback``."""
    got = F.when(F.try_parse_json(extract_json(raw)).isNotNull(), F.from_json(extract_json(raw), schema))
    return got if fallback is None else F.coalesce(got, fallback)


def usage(raw: Column) -> dict[str, Column]:
    """S-13: token counts under either spelling; the total is derived if absent."""
    of = lambda *names: F.coalesce(*(F.get_json_object(raw, f"$.{n}").cast("long") for n in names))
    i, o = of("input_tokens", "prompt_tokens"), of("output_tokens", "completion_tokens")
    return {"input": i, "output": o, "total": F.coalesce(of("total_tokens"), i + o)}


def error_kind(status: Column, raw: Column) -> Column:
    """S-14: the first class whose rule fits; the patterns are fixed values."""
    low = F.lower(raw)
    return (
        F.when(low.rlike("contentfilter|content_filter|sensitive|敏感|审核|不安全"), "filter")
        .when((status == 401) | low.rlike("unauthorized|invalid api key|invalid_api_key"), "auth")
        .when((status == 403) | low.rlike("forbidden|permission|没有权限"), "permission")
        .when((status == 429) | low.rlike("rate.?limit|too many requests|限流"), "rate")
        .when(low.rlike("quota|insufficient|余额|额度|payment"), "quota")
        .when((status == 404) | low.rlike("model.*not.*found|模型不存在"), "model")
        .when(status >= 500, "server")
        .otherwise("other")
    )


def sse(event: Column) -> Column:
    """S-10: one server-sent event."""
    return F.concat(F.lit("data: "), event, F.lit("\n\n"))


def sse_events(rows: DataFrame, body: str) -> DataFrame:
    """S-11: (rest, pos, event) of the well-formed data lines."""
    rest = [c for c in rows.columns if c != body]
    got = rows.select(*rest, F.posexplode(F.split(body, "\n")).alias("pos", "line")).where(F.col("line").startswith("data: "))
    got = got.select(*rest, "pos", F.substring("line", 7, 1 << 30).alias("event"))
    return got.where(F.try_parse_json("event").isNotNull())


def reassembled(reads: DataFrame) -> DataFrame:
    """S-11: (stream, line_no, event) of the well-formed data lines of streams
    that came in pieces: reads (stream, seq, piece).  A line may go on from one
    piece to the next; one without its end is not read yet."""
    whole = reads.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("body"))
    done = whole.select("stream", F.substring_index("body", "\n", -1).alias("rest"), "body")
    done = done.select("stream", F.expr("left(body, length(body) - length(rest))").alias("body"))
    return sse_events(done, "body").select("stream", F.col("pos").alias("line_no"), "event")


def overlaid(user: DataFrame, defaults: dict[str, str], key: str = "user") -> DataFrame:
    """S-06: a row of settings for each user, each setting that is null or absent
    from its default."""
    have = [c for c in defaults if c in user.columns]
    return user.select(key, *(F.coalesce(F.col(c), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in defaults.items()))


def done_stats(events: DataFrame) -> DataFrame:
    """I-07: (stream, scenes, characters, repaired, errors) of the last event of a
    stream that says it is done."""
    n = lambda path: F.coalesce(F.json_array_length(F.get_json_object("event", path)), F.lit(0))
    done = events.where(F.get_json_object("event", "$.done") == "true")
    last = done.groupBy("stream").agg(F.max_by("event", "line_no").alias("event"))
    return last.select("stream", F.coalesce(F.get_json_object("event", "$.scenes").cast("long"), F.lit(0)).alias("scenes"), n("$.screenplay.characters").cast("long").alias("characters"), F.coalesce(F.get_json_object("event", "$.repaired") == "true", F.lit(False)).alias("repaired"), n("$.validation.errors").cast("long").alias("errors"))


def with_default(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """S-16: values by key, the table's last row's where there is none."""
    last = table.agg(F.max_by(value, "ord").alias("_last"))
    return keys.join(table.select(key, value), key, "left").join(F.broadcast(last)).select(key, F.coalesce(value, "_last").alias(value))
