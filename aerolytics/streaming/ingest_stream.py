"""Structured Streaming: new recording files -> appended samples tables.

The file stream source finds new files (a file is never split across
micro-batches); ``foreachBatch`` takes the file names of the batch (at most
``max_files`` of them) and runs the batch ingest on exactly those files, so
line order and every per-flight decision see whole recordings. Each batch
overwrites its own ``batch_id=`` folder of every table, so a batch that is run
again after a failure replaces what it had written. Files of one name in
different batches have one flight_id in different ``batch_id`` partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerolytics.operators.ingest import ingest
from aerolytics.sources.recordings import decoded_path, read_recordings


def _write_batch(output_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        files = [r.path for r in batch.select(decoded_path(F.col("_metadata.file_path")).alias("path"))
                 .distinct().collect()]  # at most max_files
        if not files:
            return
        spark = batch.sparkSession
        rec = ingest(read_recordings(spark, files))
        for table in ("samples", "parameters", "flights", "issues"):
            getattr(rec, table).write.mode("overwrite").parquet(f"{output_dir}/{table}/batch_id={batch_id}")
    return run


def start_ingest_stream(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_location: str,
                        max_files: int = 100, available_now: bool = False) -> StreamingQuery:
    """Start the stream. ``available_now=True`` processes what is there and stops."""
    stream = (spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", max_files)
              .load(source_dir).select("value", "_metadata"))
    w = stream.writeStream.foreachBatch(_write_batch(output_dir)).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
