"""The cleaning steps over arriving files, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.pipeline import run_pipeline


def read_stream(spark: SparkSession, path: str, like: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive under path, with the schema of the table at `like`."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(documents: DataFrame, out: str, checkpoint: str, steps: Iterable[str] = ("artefacts", "citations", "lines", "whitespace", "non_empty")) -> StreamingQuery:
    """Cleans arriving documents; every micro-batch is one folder of the output, written again if it is repeated."""

    def write(batch: DataFrame, epoch: int) -> None:
        run_pipeline(batch, steps).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, event_type, n, value): tumbling windows; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
