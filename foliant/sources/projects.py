"""The project store (S-05): sorted runs of versions by id, merged as they pile
up; new projects and edits of their rows (S-17, P-15, P-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import default_title, trim
from foliant.sources.stage import drop, get_json, put_json

UNTITLED = "未命名改编"


def latest(versions: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest version of each key: a grouped maximum, so it is pre-aggregated."""
    rest = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("v"))
    return best.select(key, "v.*")


def renamed(projects: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """P-16: ``projects`` (id, title, updated_at, ...) under their new titles (id,
    title): trimmed, cut to 40 characters, the default where nothing is left.  A
    project whose title stays the same stays as it is."""
    new = titles.select("id", F.coalesce(F.nullif(F.substring(trim(F.col("title")), 1, 40), F.lit("")), F.lit(UNTITLED)).alias("_new"))
    differs = F.coalesce(F.col("_new") != F.col("title"), F.lit(False))
    rows = projects.join(new, "id", "left")
    return rows.withColumns({"updated_at": F.when(differs, now).otherwise(F.col("updated_at")), "title": F.when(differs, F.col("_new")).otherwise(F.col("title"))}).drop("_new")


def edited(rows: DataFrame, patch: DataFrame, key: list[str], columns: list[str], status: str = "status") -> DataFrame:
    """P-15: ``rows`` with the values of their patches, which are marked edited;
    a null in a patch leaves the value as it is, and other columns stay.  Of
    several patches of one key the largest value counts."""
    p = patch.groupBy(*key).agg(F.lit(True).alias("_hit"), *(F.max(c).alias(f"_{c}") for c in columns))
    got = rows.join(p, key, "left")
    made = {c: F.coalesce(f"_{c}", c) for c in columns} | {status: F.when(F.col("_hit"), "edited").otherwise(F.col(status))}
    return got.withColumns(made).select(*rows.columns)


class ProjectStore:
    """S-05, I-08: projects by id in sorted runs, for one writer at a time.

    A put or a deletion is a run: its rows sorted by id in files of their own, whose
    smallest and largest ids a manifest holds.  FAN runs of a level are merged into
    one of the next, of each id its last version; deletions go when nothing lies
    deeper.  So ids stand in at most FAN - 1 runs a level, and of these a read opens
    only what its ids may be in, and in it only row groups that may hold them.
    The manifest is replaced by a rename; what it no longer names goes one merge
    later, so that readers can end.
    """

    SCHEMA = "id string, title string, novel string, created_at timestamp, updated_at timestamp"
    COLUMNS = ("id", "title", "novel", "created_at", "updated_at")
    FAN = 8

    def __init__(self, spark: SparkSession, path: str, group_bytes: int = 8 << 20) -> None:
        self.spark, self.path, self.group_bytes = spark, path.rstrip("/"), group_bytes

    def _manifest(self) -> dict:
        return get_json(self.spark, f"{self.path}/manifest.json") or {"next": 0, "runs": [], "old": []}

    def _read(self, runs: list[dict]) -> DataFrame:
        schema = f"{self.SCHEMA}, deleted boolean, seq long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{r['name']}" for r in runs))

    def _write(self, rows: DataFrame, number: int, level: int) -> dict | None:
        """Writes a run and says what it holds; None for an empty one."""
        run = {"name": f"run-{number:08d}", "level": level}
        place = f"{self.path}/{run['name']}"
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", self.group_bytes).parquet(place)
        low, high, n = self._read([run]).agg(F.min("id"), F.max("id"), F.count("*")).first()
        return run | {"low": low, "high": high, "rows": n} if n else None

    def _add(self, rows: DataFrame, deleted: bool) -> None:
        m = self._manifest()
        rows = latest(rows.select(*self.COLUMNS, F.lit(deleted).alias("deleted"), F.lit(m["next"]).cast("long").alias("seq")), "id", "updated_at", "title")
        if run := self._write(rows, m["next"], 0):
            m["runs"].append(run)
        m["next"] += 1
        put_json(self.spark, f"{self.path}/manifest.json", m)
        self._merge(m)

    def _merge(self, m: dict) -> None:
        level = 0
        while len(many := [r for r in m["runs"] if r["level"] == level]) >= self.FAN:
            rows = latest(self._read(many), "id", "seq", "updated_at")
            if not any(r["level"] > level for r in m["runs"]):
                rows = rows.where("not deleted")
            run = self._write(rows, m["next"], level + 1)
            for name in m["old"]:
                drop(self.spark, f"{self.path}/{name}")
            m["old"] = [r["name"] for r in many]
            m["runs"] = [r for r in m["runs"] if r["level"] != level] + ([run] if run else [])
            m["next"] += 1
            put_json(self.spark, f"{self.path}/manifest.json", m)
            level += 1

    def put(self, projects: DataFrame) -> None:
        """Upserts rows (id, title, novel, created_at, updated_at); of several rows
        of one id the latest counts."""
        self._add(projects, False)

    def delete(self, ids: DataFrame) -> None:
        kinds = dict(x.split(" ") for x in self.SCHEMA.split(", "))
        gone = ids.select("id", *(F.lit(None).cast(kinds[c]).alias(c) for c in self.COLUMNS[1:-1]), F.current_timestamp().alias("updated_at"))
        self._add(gone, True)

    def _live(self, runs: list[dict], where: Column) -> DataFrame:
        return latest(self._read(runs).where(where), "id", "seq", "updated_at").where("not deleted").select(*self.COLUMNS)

    def runs_of(self, low: str, high: str) -> list[dict]:
        """The runs that may hold an id from ``low`` to ``high``."""
        return [r for r in self._manifest()["runs"] if r["low"] <= high and r["high"] >= low]

    def scan(self, prefix: str = "") -> DataFrame:
        """Live projects whose id has the prefix, newest first (O-01)."""
        rows = self._live(self.runs_of(prefix, prefix + chr(0x10FFFF)), F.col("id").startswith(prefix))
        return rows.orderBy(F.desc("updated_at"), "id")

    def get(self, ident: str) -> DataFrame:
        return self._live(self.runs_of(ident, ident), F.col("id") == ident)


def new_projects(texts: DataFrame, text: str = "novel", title: str | None = None, now: Column | None = None) -> DataFrame:
    """S-17: (id, title, novel, created_at, updated_at): a row for each text, under
    the title given, else its first line with something in it, cut to 20
    characters, else the default; with an id of its own and the time."""
    given = F.nullif(trim(F.col(title)), F.lit("")) if title else F.lit(None).cast("string")
    at = F.current_timestamp() if now is None else now
    return texts.select(F.expr("uuid()").alias("id"), F.coalesce(given, default_title(F.col(text))).alias("title"), F.col(text).alias("novel"), at.alias("created_at"), at.alias("updated_at"))
