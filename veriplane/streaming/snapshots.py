"""Snapshots as they arrive: a file stream that reports the changes against the run before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.operators.snapshots import snapshot_changes


def stream_changes(spark: SparkSession, inbox: str, schema: str, kept: str, out: str, checkpoint: str):
    """Start a query that takes runs of signal lines from ``inbox`` and appends their changes to ``out``.

    Each micro-batch holds whole runs. The latest run is kept in ``kept``, one folder per run, and compared with
    the runs of the batch; folders are overwritten, so a batch that is repeated after a failure gives the same state.
    """
    cols = ["run_no", "signal_id", "line_no", "reason_code", "confidence"]

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*cols).persist()
        runs = [r[0] for r in rows.select("run_no").distinct().orderBy("run_no").collect()]  # run numbers of one batch
        if runs:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
            there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
            before = spark.read.schema(rows.schema).parquet(kept).where(F.col("run_no") < runs[0]) if there else rows.limit(0)
            last = before.agg(F.max("run_no")).first()[0]
            known = before.where(F.col("run_no") == F.lit(last)) if last is not None else rows.limit(0)
            changes = snapshot_changes(known.unionByName(rows), "run_no", "signal_id", "line_no", ["reason_code"], {"confidence": 1e-9})
            changes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            rows.where(F.col("run_no") == runs[-1]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_no").parquet(kept)
        rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(inbox)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
