"""The log of expert submissions as a stream: the current status of each, however late its rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "row_id long, submission_id string, submitted_at timestamp, submitted_by string, source_file string, submission_type string, status string, comment string"
# The states of a submission.
OPEN, CLOSED = ("submitted", "needs_review", "extraction_failed"), ("approved", "rejected")


def read_log(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SCHEMA).json(folder)


def current_status(log: DataFrame) -> DataFrame:
    """(submission_id, status, row_id): the status of the latest row by time and id; repeated rows change nothing."""
    at = F.struct("submitted_at", "row_id")
    return log.where("submission_id is not null").groupBy("submission_id").agg(F.max_by("status", at).alias("status"), F.max_by("row_id", at).alias("row_id"))


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def arrivals(log: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Submissions by window of their time; rows later than ``delay`` behind the latest are left out."""
    return log.withWatermark("submitted_at", delay).groupBy(F.window("submitted_at", window).alias("w"), "submission_type").agg(F.count("*").alias("n")).select("w.start", "submission_type", "n")


def keep_status(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the latest row of each submission among the new rows of a batch to target, one folder a batch.

    No state is kept and nothing is rewritten: a batch that is repeated overwrites its own folder only, and ``read_status``
    takes the latest of all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = F.struct("submitted_at", "row_id")
        latest = batch.where("submission_id is not null").groupBy("submission_id").agg(F.max_by(F.struct("submitted_at", "row_id", "status"), at).alias("s"))
        latest.select("submission_id", "s.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def read_status(spark: SparkSession, target: str) -> DataFrame:
    """(submission_id, status, row_id) over all batches that keep_status has written to target."""
    return current_status(spark.read.parquet(target))


def set_status(spark: SparkSession, log: str, row_id: int, submission_id: str, status: str, at: str, note: str | None = None) -> None:
    """Append a row that moves one submission to ``status`` to the log; the rows before stay as they are."""
    if status not in (*OPEN, *CLOSED):
        raise ValueError(f"unknown status {status}")
    row = spark.createDataFrame([(row_id, submission_id, status, note)], "row_id long, submission_id string, status string, comment string")
    row.withColumn("submitted_at", F.lit(at).cast("timestamp")).write.mode("append").json(log)
