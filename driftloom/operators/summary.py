"""Aggregation of a run."""

from __future__ import annotations

from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SOURCES = ("seed", "llms", "sitemap", "nav", "crawl", "asset")
FAILURES = ("blocked", "empty", "extract", "fetch", "http", "not_found", "timeout", "too_large", "unsafe_url")
SNAPSHOT_VERSION = 1


def counts_by_source(records: DataFrame) -> DataFrame:
    """All sources with their number of rows, none left out."""
    spark = records.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(SOURCES)], "place int, source string")
    return every.join(records.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("place", "source", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_failure(records: DataFrame) -> DataFrame:
    """Failure kinds that occurred, with the place of the first."""
    return records.where("not ok").groupBy("failure_kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def run_counts(records: DataFrame) -> DataFrame:
    """One row: written, failed, low_quality, rows."""
    return records.agg(
        F.count_if(T.has_output()).alias("written"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok") & (F.col("confidence") < 0.6)).alias("low_quality"),
        F.count(F.lit(1)).alias("rows"),
    )


def max_reached(discovered: Column, most: Column, explicit: Column) -> Column:
    return F.when(explicit, discovered >= most).otherwise(discovered == most)


def run_status(written: Column, failed: Column, low: Column, reached: Column) -> Column:
    return F.when(written == 0, "failed").when((failed > 0) | (low > 0) | reached, "partial").otherwise("ok")


def rounded(value: float, digits: int) -> float:
    """Rounded by the binary value itself."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def errors(records: DataFrame) -> DataFrame:
    """`ord`, `url`, `error`, `kind` of each failure."""
    return records.where("not ok").select("ord", "url", "error", F.col("failure_kind").alias("kind"))


def run_summary(records: DataFrame, config, discovered: int, deduped: int, snapshot: tuple[str, int, int], elapsed_ms: float, listed: int | None = None) -> dict:
    """The run's summary, with the first `listed` errors (all if None: only for runs of one site)."""
    reached = max_reached(F.lit(discovered), F.lit(config.max), F.lit(config.max_explicit))
    counts = run_counts(records).withColumn("reached", reached).withColumn("status", run_status(F.col("written"), F.col("failed"), F.col("low_quality"), F.col("reached"))).first()
    kinds = {r.failure_kind: r.n for r in counts_by_failure(records).orderBy("first").collect()}
    failed = errors(records).orderBy("ord")
    failed = (failed if listed is None else failed.limit(listed)).drop("ord").collect()
    return {
        "status": counts.status,
        "seedUrl": config.seed_url,
        "outDir": config.out_dir,
        "dryRun": config.dry_run,
        "generatedAt": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "snapshotVersion": SNAPSHOT_VERSION,
        "rootHash": snapshot[0],
        "renderedFiles": snapshot[1],
        "renderedBytes": snapshot[2],
        "max": config.max,
        "maxAppliesTo": "all" if config.max_explicit else "non-llms",
        "maxReached": counts.reached,
        "discovered": discovered,
        "deduped": deduped,
        "written": counts.written,
        "failed": counts.failed,
        "lowQuality": counts.low_quality,
        "elapsedMs": rounded(elapsed_ms, 1),
        "pagesPerSecond": rounded(counts.written / max(elapsed_ms / 1000, 0.001), 2),
        "bySource": {r.source: r.n for r in counts_by_source(records).orderBy("place").collect()},
        "byFailureKind": kinds,
        "errors": [e.asDict() for e in failed],
    }
