"""Operator 11: fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a run of ASCII letters, or one other code point) and
two cuts between units split it into prefix, middle and suffix.  Tasks emit
pieces of at most UNITS units and PIECE bytes, keyed by their row and their
position in the output; one shuffle by row with a sort inside the partitions
(repartition and sortWithinPartitions, the DataFrame form of
repartitionAndSortWithinPartitions) brings a row's pieces to one task in output
order, where they stream into the assembled text or an incremental digest.  For
restoration the output's pieces are read back, told apart by the markers among
them alone, and sorted once more into the order of the text, inside the same
partitions.  No task holds more than one piece and a digest of a row in Python.

Rows are keyed by their number within their input partition, so equal ids, null
ids and repeated rows stay apart and no key is hot; the input has to be one that
a lost task reads again in the same order, as files are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, table
from foliant.llm.textkit import column, slices

UNITS = 4096
PIECE = 1 << 16
BATCH = 8 << 20
#: The three markers, in the order prefix, middle, suffix.
MARKERS = (b"<P>", b"<M>", b"<S>")
#: Order of the parts in the output of each form, and of every text.
PSM, SPM, TEXT_ORDER = (0, 2, 1), (2, 0, 1), (0, 1, 2)
PLAIN_SHARE, SPM_SHARE = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def draws(doc_id: Column, salt: str = "1:") -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the sha256 of the
    salt and the decimal id, as numbers; a null id counts as ''."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def units(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which units begin in a run of UTF-8 texts."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    if len(data):
        inside = letter[1:] & letter[:-1]
        edge = offs[(offs > 0) & (offs < len(data))]
        begins[1:] &= ~inside
        begins[edge] = True
    return np.flatnonzero(begins)


def marked(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the markers."""
    out = np.zeros(len(offs) - 1, bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == MARKERS[0][0]) & (data[2:] == MARKERS[0][2]))
        at = at[np.isin(data[at + 1], [m[1] for m in MARKERS])]
        row = np.searchsorted(offs, at, "right") - 1
        out[row[at + 3 <= offs[row + 1]]] = True
    return out


def cuts(begins: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of the pieces of bytes ``a`` to ``b``: every UNITS units, and every
    PIECE bytes of longer ones."""
    inside = begins[np.searchsorted(begins, a, "right") : np.searchsorted(begins, b)]
    out, last = [], a
    for e in [*inside[UNITS - 1 :: UNITS].tolist(), b]:
        out += range(last + PIECE, e, PIECE)
        out.append(e)
        last = e
    return out


class Sink:
    """Collects rows of pieces into Arrow batches of about BATCH bytes."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.rows: list[tuple] = []
        self.size = 0

    def put(self, row: tuple, size: int) -> bool:
        """Adds a row; true when it is time to ``take``."""
        self.rows.append(row)
        self.size += size
        return self.size >= BATCH or len(self.rows) >= 10_000

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


HEAD = [pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64())]
HEAD_SQL = "n long, form string, prefix_chars long, middle_chars long"


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_row, _pos, doc_id, n, form, prefix_chars, middle_chars, piece): the
    pieces of every row's output in output order, markers being pieces of their
    own.  What describes a row stands in its first piece only; an empty text has
    one empty piece."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        for batch in batches:
            if sink is None:
                sink = Sink(pa.schema([pa.field("_row", pa.int64()), pa.field("_pos", pa.int32()), pa.field("doc_id", column(batch, "doc_id").type), *HEAD, pa.field("piece", pa.binary())]))
            rows, ids = column(batch, "_row").to_pylist(), column(batch, "doc_id").to_pylist()
            h = [np.asarray(column(batch, f"_h{k}")) for k in (1, 2, 3, 4)]
            for lo, hi, data, offs in slices(column(batch, "_text")):
                begins = units(data, offs)
                first = np.searchsorted(begins, offs)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                plain = marked(data, offs) | (np.diff(offs) == 0) | (h[2][lo:hi] % 100 >= 100 - PLAIN_SHARE)
                raw = data.tobytes()
                for i in range(hi - lo):
                    n, a, b = int(first[i + 1] - first[i]), int(offs[i]), int(offs[i + 1])
                    if plain[i]:
                        head, parts = (n, "plain", None, None), [(None, a, b)]
                    else:
                        place = lambda k: b if k == n else int(begins[first[i] + k])  # noqa: B023, E731
                        x, y = sorted((int(h[0][lo + i] % (n + 1)), int(h[1][lo + i] % (n + 1))))
                        x, y = place(x), place(y)
                        bounds = ((a, x), (x, y), (y, b))
                        spm = h[3][lo + i] % 100 < SPM_SHARE
                        head = (n, "spm" if spm else "psm", int(points[x] - points[a]), int(points[y] - points[x]))
                        parts = [(MARKERS[k], *bounds[k]) for k in (SPM if spm else PSM)]
                    pos, about = 0, (ids[lo + i], *head)
                    for mark, s, e in parts:
                        found = [mark] if mark else []
                        if e > s:
                            ends = cuts(begins, s, e) if e - s > UNITS else [e]
                            found += [raw[u:v] for u, v in zip([s, *ends[:-1]], ends, strict=True)]
                        for p in found or [b""]:
                            full = sink.put((rows[lo + i], pos, *about, p), len(p))
                            pos, about = pos + 1, (None,) * 5
                            if full:
                                yield from sink.take()
        if sink is not None:
            yield from sink.take()

    given = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *draws(F.col(doc_id)))
    return given.mapInArrow(task, f"_row long, _pos int, doc_id {id_type}, {HEAD_SQL}, piece binary")


def by_row(found: DataFrame) -> DataFrame:
    """The pieces of a row together and in order: the one shuffle."""
    return found.repartition("_row").sortWithinPartitions("_row", "_pos")


def _joined(found: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The pieces of each row, which come in order, as one text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*keep).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, last, about, held = None, None, (), []
        for batch in batches:
            if sink is None:
                sink = Sink(pa.schema([*(batch.schema.field(k) for k in keep), pa.field(name, pa.string())]))
            for row, piece, *head in zip(column(batch, "_row").to_pylist(), column(batch, "piece").to_pylist(), *(column(batch, k).to_pylist() for k in keep), strict=True):
                if row != last and last is not None:
                    if sink.put((*about, b"".join(held).decode("utf-8", "replace")), sum(map(len, held))):
                        yield from sink.take()
                if row != last:
                    last, about, held = row, tuple(head), []
                held.append(piece)
        if last is not None:
            sink.put((*about, b"".join(held).decode("utf-8", "replace")), 0)
            yield from sink.take()

    return found.mapInArrow(task, f"{fields}, {name} string")


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text in its
    fill-in-middle form.

    A null text is empty; an empty text, one with a marker in it and a tenth of
    the others stay plain, which leaves prefix_chars and middle_chars null.  Equal
    and null ids and repeated rows each keep their row; other columns are
    ignored; an empty table gives no rows.
    """
    return _joined(by_row(pieces(docs, text, doc_id)), ["doc_id", "n", "form", "prefix_chars", "middle_chars"], "output")


def restore(made: DataFrame, output: str = "output", form: str = "form", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text): the texts that the outputs of ``transform`` were made of,
    from output and form alone.  A null output counts as plain and empty."""
    small_batches(made.sparkSession)
    id_type = made.schema[doc_id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        for batch in batches:
            if sink is None:
                sink = Sink(pa.schema([pa.field("_row", pa.int64()), pa.field("_pos", pa.int32()), pa.field("doc_id", column(batch, "doc_id").type), pa.field("piece", pa.binary())]))
            for row, i, kind, whole in zip(*(column(batch, k).to_pylist() for k in ("_row", "doc_id", "_form", "_output")), strict=True):
                raw = (whole or "").encode()
                parts = [raw]
                if kind in ("psm", "spm"):
                    order = PSM if kind == "psm" else SPM
                    at = [raw.index(MARKERS[k]) for k in order] + [len(raw)]
                    got = {k: raw[at[j] + 3 : at[j + 1]] for j, k in enumerate(order)}
                    parts = [got[k] for k in TEXT_ORDER]
                todo = [p[j : j + PIECE] for p in parts for j in range(0, len(p), PIECE)]
                for pos, p in enumerate(todo or [b""]):
                    if sink.put((row, pos, i, p), len(p)):
                        yield from sink.take()
        if sink is not None:
            yield from sink.take()

    given = made.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(form).alias("_form"), F.col(output).alias("_output"))
    return _joined(by_row(given.mapInArrow(task, f"_row long, _pos int, doc_id {id_type}, piece binary")), ["doc_id"], "text")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256): digests of every row's output and of the text restored from
    it, neither of which is ever held whole after the cut.  Cases as in
    ``transform``."""
    found = by_row(pieces(docs, text, doc_id))
    id_type = docs.schema[doc_id].dataType.simpleString()
    part_of = {m: k for k, m in enumerate(MARKERS)}

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests the output and labels its pieces with their part of the text."""
        sink, last, about, digest, part = None, None, (), None, 0
        for batch in batches:
            if sink is None:
                sink = Sink(pa.schema([pa.field("_row", pa.int64()), pa.field("_part", pa.int32()), pa.field("_pos", pa.int32()), batch.schema.field("doc_id"), *HEAD, pa.field("output_sha256", pa.string()), pa.field("piece", pa.binary())]))
            for row, pos, piece, *head in zip(*(column(batch, k).to_pylist() for k in ("_row", "_pos", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars")), strict=True):
                if row != last:
                    if last is not None and sink.put((last, -1, 0, *about, digest.hexdigest(), None), 0):
                        yield from sink.take()
                    last, about, digest, part = row, tuple(head), hashlib.sha256(), 0
                digest.update(piece)
                if about[2] != "plain" and piece in part_of:
                    part = part_of[piece]
                elif sink.put((row, part, pos, None, None, None, None, None, None, piece), len(piece)):
                    yield from sink.take()
        if last is not None:
            sink.put((last, -1, 0, *about, digest.hexdigest(), None), 0)
            yield from sink.take()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests the pieces in the order of the text."""
        sink, about, digest = None, None, None
        for batch in batches:
            if sink is None:
                sink = Sink(pa.schema([batch.schema.field("doc_id"), *HEAD, pa.field("output_sha256", pa.string()), pa.field("restored_sha256", pa.string())]))
            for part, piece, *head in zip(*(column(batch, k).to_pylist() for k in ("_part", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")), strict=True):
                if part >= 0:
                    digest.update(piece)
                    continue
                if about is not None and sink.put((*about, digest.hexdigest()), 0):
                    yield from sink.take()
                about, digest = tuple(head), hashlib.sha256()
        if about is not None:
            sink.put((*about, digest.hexdigest()), 0)
            yield from sink.take()

    labelled = found.mapInArrow(assemble, f"_row long, _part int, _pos int, doc_id {id_type}, {HEAD_SQL}, output_sha256 string, piece binary")
    again = labelled.sortWithinPartitions("_row", "_part", "_pos")
    return again.mapInArrow(rebuild, f"doc_id {id_type}, {HEAD_SQL}, output_sha256 string, restored_sha256 string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, form and digests of every document."""
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
