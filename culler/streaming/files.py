"""Incremental source form of S1: test files arriving in a folder are read whole
by Structured Streaming and every micro-batch runs the same extraction
(``foreachBatch``), appending the methods table partitioned by language.

The reference has no streaming operator; this is only the file scan (S1) fed
incrementally, with the same batch operators behind it.  Progress is kept in a
checkpoint under the shared ``spark.checkpoint.dir`` so a restarted job resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.operators import extract as X
from culler.session import ensure_checkpoint_dir


def watch_test_files(spark: SparkSession, src_dir: str, out_dir: str, trigger_once: bool = False,
                     checkpoint: str | None = None):
    """Start the stream; returns the StreamingQuery.  ``trigger_once`` processes
    what is there now and stops (availableNow)."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/culler-stream/{out_dir.strip('/').replace('/', '_')}"
    files = (spark.readStream.text(src_dir, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        f = batch.withColumn("suite", F.col("path"))
        methods = X.extract_methods(f).drop("header_text")
        methods.write.mode("append").partitionBy("language").parquet(out_dir)

    w = files.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
