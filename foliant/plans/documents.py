"""Queries over texts: segmentation, packing, rendering, text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import segment as S
from foliant.plans.base import oracle, query, read

TARGET, OVERLAP = 1000, 200
WS = T.WS
#: CTE of numbered paragraphs with their costs and prefix sums.
PARAS = rf"""
lines AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) > 0)) AS text,
                 generate_subscripts(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) > 0), 1) AS n FROM documents),
paras AS (SELECT doc_id, n, text, length(text) + length('¶' || n || ' ') AS cost FROM lines)"""
PACK = f"""
{PARAS},
fill(doc_id, n, bin, used) AS (
  SELECT doc_id, n, 0, cost FROM paras WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, CASE WHEN f.used + 1 + p.cost > {TARGET} THEN f.bin + 1 ELSE f.bin END,
         CASE WHEN f.used + 1 + p.cost > {TARGET} THEN p.cost ELSE f.used + 1 + p.cost END
  FROM fill f JOIN paras p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
cores AS (SELECT doc_id, bin AS idx, min(n) AS s, max(n) AS e, max(used) AS core_chars FROM fill GROUP BY doc_id, bin)"""
OVER = f"""
{PACK},
pre AS (SELECT doc_id, n, sum(cost + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto, cost FROM paras),
wide AS (SELECT c.doc_id, c.idx, c.s, c.e, c.core_chars,
    (SELECT min(p.n) FROM pre p, pre q WHERE p.doc_id = c.doc_id AND q.doc_id = c.doc_id AND q.n = c.s - 1 AND p.n < c.s AND q.upto - (p.upto - p.cost - 1) - 1 <= {OVERLAP}) AS before,
    (SELECT max(p.n) FROM pre p, pre q WHERE p.doc_id = c.doc_id AND q.doc_id = c.doc_id AND q.n = c.e AND p.n > c.e AND p.upto - q.upto - 1 <= {OVERLAP}) AS after
  FROM cores c)"""


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("novel_id"), T.lines(F.col("text")).alias("paras"))


def chunked(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = novels(spark, sf_dir)
    return S.chunks(rows, TARGET, OVERLAP)


@query(f"WITH {PARAS} SELECT doc_id, n::BIGINT AS n, text FROM paras")
def paragraph_split(spark, sf_dir):
    return S.paragraphs(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").select(F.col("novel_id").alias("doc_id"), F.col("n").cast("long").alias("n"), "text")


@query(rf"SELECT doc_id, length(regexp_replace(text, '{WS}', '', 'g'))::BIGINT AS solid, length(text)::BIGINT AS points, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def char_metrics(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.solid_chars(t).cast("long").alias("solid"), T.prompt_chars(t).cast("long").alias("points"), F.octet_length(t).cast("long").alias("bytes"))


@query(f"WITH {PARAS} SELECT doc_id, (sum(cost) + count(*) - 1)::BIGINT AS cost FROM paras GROUP BY doc_id")
def numbered_cost(spark, sf_dir):
    p = novels(spark, sf_dir).where(F.size("paras") > 0)
    total = F.aggregate(F.transform("paras", lambda x, i: T.numbered_cost(x, i + 1)), F.lit(0), lambda a, x: a + x)
    return p.select(F.col("novel_id").alias("doc_id"), (total + F.size("paras") - 1).cast("long").alias("cost"))


@query(f"WITH {PARAS} SELECT doc_id, string_agg('¶' || n || ' ' || text, chr(10) ORDER BY n) AS text FROM paras GROUP BY doc_id")
def numbered_text(spark, sf_dir):
    p = novels(spark, sf_dir).where(F.size("paras") > 0)
    return p.select(F.col("novel_id").alias("doc_id"), S.numbered_text(F.col("paras"), F.lit(1), F.size("paras")).alias("text"))


@query(f"WITH {PARAS} SELECT doc_id, string_agg(text, chr(10) ORDER BY n) AS text FROM paras WHERE n BETWEEN 2 AND 3 GROUP BY doc_id")
def range_slice_join(spark, sf_dir):
    p = novels(spark, sf_dir).where(F.size("paras") > 1)
    return p.select(F.col("novel_id").alias("doc_id"), F.array_join(F.slice("paras", 2, 2), "\n").alias("text"))


@query(rf"SELECT doc_id, CASE WHEN length(regexp_replace(text, '{WS}', '', 'g')) > 500000 THEN 'chars' WHEN octet_length(encode(text)) > 10485760 THEN 'bytes' ELSE 'ok' END AS verdict FROM documents")
def input_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", S.input_guard(F.col("text")).alias("verdict"))


@query(rf"SELECT doc_id, md5(regexp_replace(lower(text), '{WS}', '', 'g')) AS key FROM documents")
def norm_text_key(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(T.norm_text(F.col("text")).cast("binary")).alias("key"))


@query(rf"WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS clipped FROM f")
def clip_ellipsis(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.clip(F.col("text"), 60).alias("clipped"))


@query("SELECT doc_id, substr(text, 1, 80) AS snippet FROM documents")
def snippet80(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.substring("text", 1, 80).alias("snippet"))


@query(rf"""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) > 0)[1], 1, 20), '未命名改编') AS title,
  regexp_replace(coalesce(source, '') || '/' || coalesce(lang, '') || ':' || doc_id, '[\\/:*?"<>|]', '_', 'g') AS file FROM documents""")
def default_title(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))
    return d.select("doc_id", T.default_title(F.col("text")).alias("title"), T.safe_filename(name).alias("file"))


@query(f"WITH RECURSIVE {PACK} SELECT doc_id, idx::BIGINT AS idx, s::BIGINT AS first_n, e::BIGINT AS last_n, core_chars::BIGINT AS core_chars FROM cores")
def chunk_pack(spark, sf_dir):
    c = chunked(spark, sf_dir)
    return c.select(F.col("novel_id").alias("doc_id"), *(F.col(a).cast("long").alias(b) for a, b in (("idx", "idx"), ("start", "first_n"), ("end", "last_n"), ("core_chars", "core_chars"))))


@query(f"""WITH RECURSIVE {OVER} SELECT w.doc_id, idx::BIGINT AS idx, coalesce(before, 0)::BIGINT AS before, coalesce(after, 0)::BIGINT AS after,
  (SELECT sum(cost + 1) - 1 FROM paras p WHERE p.doc_id = w.doc_id AND p.n BETWEEN coalesce(before, s) AND coalesce(after, e))::BIGINT AS context_chars FROM wide w""")
def chunk_overlap(spark, sf_dir):
    c = chunked(spark, sf_dir)
    return c.select(F.col("novel_id").alias("doc_id"), *(F.coalesce(a, F.lit(0)).cast("long").alias(a) for a in ("idx", "before", "after", "context_chars")))


@query(f"WITH RECURSIVE {PACK}, p AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id) SELECT count(DISTINCT c.doc_id)::BIGINT AS novels, count(*)::BIGINT AS chunks, sum(e - s + 1)::BIGINT AS covered, (SELECT sum(n) FROM p)::BIGINT AS paragraphs, 0::BIGINT AS violations FROM cores c")
def chunk_coverage_violations(spark, sf_dir):
    c = chunked(spark, sf_dir)
    n = novels(spark, sf_dir).select("novel_id", F.size("paras").alias("n_paragraphs"))
    bad = S.coverage_violations(c, n, TARGET).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))
    made = c.agg(F.count_distinct("novel_id").alias("novels"), F.count("*").alias("chunks"), F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("covered"))
    return made.join(n.agg(F.sum("n_paragraphs").cast("long").alias("paragraphs"))).join(bad)


@query(f"""WITH RECURSIVE {OVER}, part AS (SELECT w.doc_id, w.idx, w.s, w.e, before, after, n, '¶' || n || ' ' || text AS t FROM wide w JOIN paras p ON p.doc_id = w.doc_id AND p.n BETWEEN coalesce(before, s) AND coalesce(after, e))
SELECT doc_id, idx::BIGINT AS idx, md5(concat_ws(chr(10), CASE WHEN any_value(before) IS NOT NULL THEN '{S.BEFORE}' END, string_agg(t, chr(10) ORDER BY n) FILTER (n < s), '{S.CORE}', string_agg(t, chr(10) ORDER BY n) FILTER (n BETWEEN s AND e),
  CASE WHEN any_value(after) IS NOT NULL THEN '{S.AFTER}' END, string_agg(t, chr(10) ORDER BY n) FILTER (n > e))) AS digest FROM part GROUP BY doc_id, idx""")
def chunk_render_len(spark, sf_dir):
    c = S.chunks(novels(spark, sf_dir), TARGET, OVERLAP, keep=("paras",))
    text = S.render_chunk(F.col("paras"), {k: F.col(k) for k in ("start", "end", "before", "after")})
    return c.select(F.col("novel_id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.md5(text.cast("binary")).alias("digest"))


@query(None)
def text_split_budget(spark, sf_dir):
    """X-08, C-01: no SQL form; checked by its invariants."""
    cut = S.split_oversized(novels(spark, sf_dir), TARGET, OVERLAP)
    return cut.select(F.col("novel_id").alias("doc_id"), F.size("paras").cast("long").alias("pieces"), F.md5(F.array_join("paras", "").cast("binary")).alias("digest"), F.array_max(F.transform("paras", lambda x: F.length(x))).cast("long").alias("longest"))


@query(f"""WITH RECURSIVE {PACK}, c AS (SELECT doc_id, string_agg(idx || ':' || s || ':' || e || ':' || core_chars, '|' ORDER BY idx) AS c FROM cores GROUP BY doc_id)
SELECT d.doc_id, sha256('chunks-2|' || sha256(d.text) || '|' || coalesce(c, '')) AS fingerprint FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def fingerprint(spark, sf_dir):
    """X-20: digest of a novel's text and its chunks, to tell whether a checkpoint
    still fits: an edit that keeps all lengths changes it too."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("novel_id"), F.sha2("text", 256).alias("digest"))
    c = chunked(spark, sf_dir).groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "core_chars"))).alias("x"))
    parts = F.array_join(F.transform("x", lambda x: F.concat_ws(":", *(x[k].cast("string") for k in ("idx", "start", "end", "core_chars")))), "|")
    got = rows.join(c, "novel_id", "left")
    return got.select(F.col("novel_id").alias("doc_id"), F.sha2(F.concat(F.lit("chunks-2|"), "digest", F.lit("|"), F.coalesce(parts, F.lit(""))), 256).alias("fingerprint"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, lang, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, source FROM documents),
take(source, k, used, took) AS (SELECT source, k, CASE WHEN size <= 20000 THEN size ELSE 0 END, size <= 20000 FROM s WHERE k = 1
  UNION ALL SELECT s.source, s.k, CASE WHEN t.used + s.size <= 20000 THEN t.used + s.size ELSE t.used END, t.used + s.size <= 20000 FROM take t JOIN s ON s.source IS NOT DISTINCT FROM t.source AND s.k = t.k + 1)
SELECT source, count_if(took)::BIGINT AS taken, count_if(NOT took)::BIGINT AS omitted, max(used)::BIGINT AS used FROM take GROUP BY source""")
def snapshot_budget_take(spark, sf_dir):
    """O-05: items that don't fit are passed over, later ones still tried."""
    from foliant.operators.paging import budget_take

    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").select("source", "doc_id", F.length("text").alias("size"))
    return budget_take(d, "source", "doc_id", "size", 20000)


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, source FROM documents),
take(source, doc_id, k, used, took) AS (SELECT source, doc_id, k, CASE WHEN size <= 9000 THEN size ELSE 0 END, size <= 9000 FROM s WHERE k = 1
  UNION ALL SELECT s.source, s.doc_id, s.k, CASE WHEN t.used + s.size <= 9000 THEN t.used + s.size ELSE t.used END, t.used + s.size <= 9000 FROM take t JOIN s ON s.source IS NOT DISTINCT FROM t.source AND s.k = t.k + 1)
SELECT source, doc_id, took AS taken FROM take""")
def snapshot_budget_pick(spark, sf_dir):
    """O-05, E-04: which documents of a source fit, one by one."""
    from foliant.operators.paging import budget_pick

    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").select("source", "doc_id", F.length("text").alias("size"))
    return budget_pick(d, ["source"], "doc_id", "size", F.lit(9000)).select("source", "doc_id", "taken")


@query(r"""WITH s AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents),
b AS (SELECT *, k // 4 AS blk, k % 4 AS i, count(*) OVER (PARTITION BY source, k // 4) AS n, sum(size) OVER (PARTITION BY source, k // 4) AS total FROM s),
h AS (SELECT *, CASE WHEN i < (n + 1) // 2 THEN 0 ELSE 1 END AS half FROM b), g AS (SELECT *, sum(size) OVER (PARTITION BY source, blk, half) AS part FROM h)
SELECT source, doc_id, (dense_rank() OVER (PARTITION BY source ORDER BY blk, CASE WHEN total > 6000 THEN half ELSE 0 END, CASE WHEN total > 6000 AND part > 6000 THEN i ELSE 0 END) - 1)::BIGINT AS block FROM g""")
def halved_document_blocks(spark, sf_dir):
    """O-09, F-17: blocks of four documents of a source, halved where too long."""
    from foliant.operators.paging import halved_blocks

    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").select("source", "doc_id", F.length("text").alias("size"))
    return halved_blocks(d, ["source"], "doc_id", "size", 4, 6000, "block").select("source", "doc_id", F.col("block").cast("long").alias("block"))


@query(r"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS total FROM documents),
o AS (SELECT DISTINCT total, floor(i * (total - 1) / 6.0 + 0.5)::BIGINT AS k FROM (SELECT DISTINCT total FROM r) t, range(7) x(i))
SELECT r.source, r.doc_id, r.k::BIGINT AS k FROM r JOIN o ON r.total = o.total AND r.k = o.k""")
def even_sampling(spark, sf_dir):
    """O-07: evenly spaced ordinals, rounded half up."""
    from foliant.operators.sequences import even_sample

    return even_sample(read(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id", 7)


@query(r"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_theta_join(spark, sf_dir):
    """J-07: the needles are a table of names; it is broadcast behind a check."""
    from foliant.operators.relations import contains_join

    return contains_join(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", F.col("text").alias("needle")), "text", "needle").select("doc_id", "item_id")


BODY = """replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"""


@query(f"""WITH o AS (SELECT doc_id, '{{"t": "' || {BODY} || '{{", "n": {{"id": ' || doc_id || '}}, "x": "\\\\}}"}}' AS j FROM documents)
SELECT doc_id, md5(CASE doc_id % 4 WHEN 1 THEN substr(j, 1, length(j) - 9) WHEN 3 THEN j ELSE j END) AS digest, doc_id % 4 <> 1 AS parses FROM o""")
def json_in_text(spark, sf_dir):
    """K-02, K-03: objects set into texts, which they hold whole: with words and
    braces around them, cut off, and fenced."""
    from foliant.sources.model import extract_json

    d = read(spark, sf_dir, "documents", "doc_id", "text")
    body = F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    j = F.concat(F.lit('{"t": "'), body, F.lit('{", "n": {"id": '), F.col("doc_id").cast("string"), F.lit('}, "x": "\\\\}"}'))
    k = F.col("doc_id") % 4
    dirty = F.when(k == 0, F.concat(F.lit("the answer:\n"), "j", F.lit("\nwith {more} to say"))).when(k == 1, F.concat(F.lit("cut "), F.expr("substr(j, 1, length(j) - 9)"))).when(k == 2, F.concat("j", F.lit("}}"))).otherwise(F.concat(F.lit("so ```json\n"), "j", F.lit("\n``` done {")))
    got = d.select("doc_id", j.alias("j")).select("doc_id", extract_json(dirty).alias("g"))
    return got.select("doc_id", F.md5(F.col("g").cast("binary")).alias("digest"), F.try_parse_json("g").isNotNull().alias("parses"))


QUERIES, ORACLES = oracle(__name__)
