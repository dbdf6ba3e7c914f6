"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed: a blob is the SHA-256 of its text. The ledger holds one row
per (blob, rule version) that was scanned, with its findings. A run scans only pairs that the ledger
lacks, appends them, and joins the findings back to all versions of all paths, so a text that thousands of
paths share is scanned once, and a second run over the same history scans nothing.

Rules (version 1), each leftmost, non-overlapping, on the whole text; a match that fails its length test is
dropped, and what it covers isn't tried again:
assign  a password-like name, ``:`` or ``=``, and a value of 6 or more characters
access  ``AKIA`` and upper-case letters or digits, 20 or more characters
hex     lower-case hexadecimal digits, 24 or more

Scale: the first pass hashes texts in the JVM and keeps (row, blob); one path stands for each unseen blob, and one
row of that path and text is scanned; texts move once, in the join on (path, blob) that fetches them and whose
partitions the grouping by (path, blob) uses again; scanning needs no state.
Joining the findings back is skewed on popular blobs and left to a sort-merge join whose inputs are plain
tables, which adaptive execution splits. The ledger is a Parquet folder in the shared folder: appending
commits whole files, and a run that fails leaves it as it was.

Defined cases: a null text is scanned as an empty one; null or equal paths and repeated rows each keep
their own result row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from culler.llm.common import prepare, written
from culler.session import ensure_checkpoint_dir

RULE_VERSION = 1
KINDS = ("assign", "access", "hex")
# The patterns of the three kinds. ASCII letters alone match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run of 20 (24) or more is the same as any run that passes the length test: both take whole runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6
#: Findings are broadcast up to this measured size.
BROADCAST_BYTES = 32 << 20

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version int, findings {FINDINGS}"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, _ARROW)], names=["blob", "findings"])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def new_ledger(spark: SparkSession) -> str:
    """The path of an empty ledger in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan_versions(versions: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """``versions``: path, text (one row per version of a path). Scans the blobs that ``ledger`` lacks for this
    rule version, appends them and returns path, blob, findings, one row per version."""
    spark = versions.sparkSession
    prepare(spark)
    # a path's key is never null: null paths have one of their own
    key = F.coalesce(F.concat(F.lit("p"), F.col("path").cast("string")), F.lit("n"))
    blob = blob_of(F.col("text"))
    addressed = written(versions.select("path", key.alias("key"), blob.alias("blob")), "secret-paths")
    seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version).select("blob")
    unseen = addressed.groupBy("blob").agg(F.min("key").alias("key")).join(seen, "blob", "left_anti")
    wanted = versions.select(key.alias("key"), blob.alias("blob"), "text").join(unseen, ["key", "blob"], "left_semi")
    # repeated rows of the chosen path meet in the join's own partitions: one of them is scanned
    todo = wanted.groupBy("key", "blob").agg(F.first("text").alias("text")).select("blob", "text")
    scanned = todo.mapInArrow(_scan, f"blob string, findings {FINDINGS}")
    scanned.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version)
    hits = known.filter(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    return addressed.join(written(hits, "secret-hits"), "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def span_string(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined in their order."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def _bounded(hits: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``hits``, to be broadcast if their rows, measured now, need no more than ``limit`` bytes."""
    size = hits.agg(F.sum(200 + 40 * F.size("__findings"))).first()[0] or 0
    return F.broadcast(hits) if size <= limit else hits


def redact(docs: DataFrame, ledger: str) -> DataFrame:
    """Replaces each secret by ``<kind>`` in the texts of ``docs`` (doc_id, text, further columns kept): the document
    stays, the secret goes. Texts without findings come back as they are. The findings (of the few texts that
    have any) are broadcast if they are measured to be small, else joined by blob."""
    prepare(docs.sparkSession)
    found = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    hits = found.filter(F.size("findings") > 0).select(F.col("blob").alias("__blob"), F.col("findings").alias("__findings"))
    hits = _bounded(written(hits.dropDuplicates(["__blob"]), "secret-redactions"))
    joined = docs.join(hits, blob_of(F.col("text")) == F.col("__blob"), "left")
    none = F.array().cast(FINDINGS)
    # spans may overlap (a value may be hexadecimal): of a span that starts inside an earlier one only the rest goes
    state = F.aggregate(
        F.coalesce("__findings", none),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, f: F.when(f["end"] <= s["at"], s).otherwise(F.struct(
            F.concat(s["out"], F.when(f["start"] >= s["at"], F.concat(
                F.substring(F.col("text"), s["at"] + 1, f["start"] - s["at"]), F.lit("<"), f["kind"], F.lit(">"))).otherwise(F.lit(""))).alias("out"),
            f["end"].alias("at"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text"))))
    text = F.when(F.col("__findings").isNull(), F.col("text")).otherwise(state)
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
