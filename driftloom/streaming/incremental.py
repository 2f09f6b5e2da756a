"""A growing folder of archived pages as a stream: each new page once, extracted as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.extract import extract
from ..plans.pipeline import pages_to_fetched

PAGES = "page_id long, url string, html string"


def new_pages(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Pages of new files whose route was not seen before. The state holds one hash for each route."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return pages.withColumn("route", F.xxhash64(U.route_key("url"))).dropDuplicates(["route"]).drop("route")


def start(pages: DataFrame, out: str, checkpoint: str):
    """Extract new pages into Parquet at `out`; runs until nothing new is there."""

    def batch(rows: DataFrame, number: int) -> None:
        extract(pages_to_fetched(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
