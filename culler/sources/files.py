"""Sources (S1, S3): whole source files and extracted-method JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHOD_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("code", T.StringType())])


def scan_files(spark: SparkSession, path: str, trailing_newline: bool = False) -> DataFrame:
    """One row per file, read whole as UTF-8: (path, content).  ``path`` is
    the file's own location (``_metadata.file_path``), or the ``path`` partition
    value when the files were written partitioned by it.  With
    ``trailing_newline`` one final newline added by a line-oriented writer is removed."""
    df = spark.read.text(path, wholetext=True)
    content = F.regexp_replace("value", r"\n\z", "") if trailing_newline else F.col("value")
    src = F.col("path") if "path" in df.columns else F.col("_metadata.file_path")
    return df.select(src.alias("path"), content.alias("content"))


def scan_methods_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S3: ``{name, code}`` records with a fixed schema (no inference).  Files
    holding one JSON array (the reference's format) need ``multiline=True``;
    JSON lines (our sink) do not."""
    schema = METHOD_SCHEMA
    r = spark.read.schema(schema)
    if multiline:
        r = r.option("multiLine", "true")
    df = r.json(path)
    return df
