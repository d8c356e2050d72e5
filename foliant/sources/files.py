"""Files in and out (S-01 .. S-03, S-07, S-08, S-15)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """S-01: (path, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx_text(data: bytes) -> str | None:
    """Raw text of a .docx: paragraphs, each followed by a blank line; tabs and
    line breaks kept.  None if it is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(f"{_W}p"):
        for e in p.iter():
            out.append({f"{_W}t": e.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(e.tag, ""))
        out.append("\n\n")
    return "".join(out)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """S-02: (path, text); a file that can't be read has a null text."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "text": [docx_text(bytes(b)) for b in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(task, "path string, text string")


def pasted(spark: SparkSession, *texts: str) -> DataFrame:
    """S-03."""
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def to_yaml(rows: DataFrame, key: str, value: str) -> DataFrame:
    """S-07: (key, yaml) of a column of JSON texts, keys in their order."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "yaml": [None if v is None else yaml.safe_dump(json.loads(v), allow_unicode=True, sort_keys=False) for v in pdf[value]]})

    return rows.select(key, value).mapInPandas(task, f"{key} {rows.schema[key].dataType.simpleString()}, yaml string")


def from_yaml(rows: DataFrame, key: str, value: str) -> DataFrame:
    """S-07: (key, json) to be validated by its schema; malformed gives null."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        def one(v):
            try:
                return None if v is None else json.dumps(yaml.safe_load(v), ensure_ascii=False)
            except (yaml.YAMLError, TypeError):
                return None

        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "json": [one(v) for v in pdf[value]]})

    return rows.select(key, value).mapInPandas(task, f"{key} {rows.schema[key].dataType.simpleString()}, json string")


def write_texts(rows: DataFrame, name: str, text: str, path: str) -> None:
    """S-08: one folder a name, with the text in it."""
    rows.select(name, text).write.partitionBy(name).mode("overwrite").text(path)


def write_reports(rows: DataFrame, path: str) -> None:
    """S-15."""
    rows.write.mode("overwrite").json(path)
