from pyspark.sql import functions as F

from foliant.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_lengths(spark):
    t = F.col("t")
    s = "a 😀　﻿\u0085b"
    assert one(spark, T.prompt_chars(t), t=s) == 7
    assert one(spark, T.solid_chars(t), t=s) == 4  # U+0085 is no white space here, U+3000 and U+FEFF are
    assert one(spark, T.utf16_units(t), t=s) == 8
    assert one(spark, T.numbered_cost(t, F.lit(12)), t="abc") == 7


def test_lines(spark):
    assert one(spark, T.lines(F.col("t")), t="  第一段。  \n\n第二段。\n\n\n第三段。\n   ") == ["第一段。", "第二段。", "第三段。"]
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\rc\n") == ["a", "b", "c"]
    assert one(spark, T.lines(F.col("t")), t="") == []


def test_keys(spark):
    assert one(spark, T.norm_text(F.col("t")), t=" A　b ") == "ab"
    assert one(spark, T.norm_text(F.col("t")), t=None) == ""
    assert one(spark, T.canonical_predicate(F.col("t")), t="Currently-At") == "current_location"
    assert one(spark, T.fact_key(F.col("k"), F.lit("S 1"), F.lit("位置"), F.lit(None).cast("string")), k="State") == "state:s1:current_location:"


def test_ids_and_names(spark):
    assert one(spark, T.padded_id("c_", F.lit(7))) == "c_007" and one(spark, T.padded_id("c_", F.lit(12345))) == "c_12345"
    once = T.scoped_id(F.lit("chunk_001"), F.col("t"))
    assert one(spark, once, t="char_001") == "chunk_001::char_001" and one(spark, T.scoped_id(F.lit("chunk_001"), once), t="char_001") == "chunk_001::char_001"
    assert one(spark, T.safe_filename(F.col("t")), t='a/b\\c:"d"|?*<>') == "a_b_c__d______"
    assert one(spark, T.default_title(F.col("t")), t="\n  " + "长" * 30) == "长" * 20
    assert one(spark, T.default_title(F.col("t"), F.lit("  ")), t=" ") == "未命名改编"
    assert one(spark, T.clip(F.col("t"), 4), t=" a  b\ncde ") == "a b…"
