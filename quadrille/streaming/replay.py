"""The sliding window as a stream: a file for each period, the last few are live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators.replay import WINDOW


def replay(spark: SparkSession, path: str, schema: str, live_path: str, checkpoint: str, length: int = WINDOW, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Follow ``path``, one period file for each trigger, and keep the last ``length`` periods.

    A period is what one batch brings, whatever its calendar name: a late file is a new
    period. Live rows are kept in folders by batch under ``live_path``; dropping a period
    deletes its folder and rewrites nothing. A batch that is run again writes its own
    folder anew. ``after`` gets the live rows and the batch's number.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{live_path}/batch={number}")
        files = session._jvm.org.apache.hadoop.fs.Path(live_path)
        fs = files.getFileSystem(session._jsc.hadoopConfiguration())
        for status in fs.listStatus(files):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) <= number - length:
                fs.delete(status.getPath(), True)
        if after is not None:
            after(session.read.schema(f"{schema}, batch int").parquet(live_path), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def period_counts(stream: DataFrame, ts: str = "ts", watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows in each event-time window of a stream, late ones up to the watermark."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "cnt")
