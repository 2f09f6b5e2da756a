"""Runs: from archived or fetched pages to records, snapshot and summary."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import urls as U
from ..operators import dedup, extract, paths, render, snapshot, summary
from ..operators.scratch import settle, written
from ..sources import archive as A
from ..sources import fetching as R
from ..sources import sinks
from ..sources.http import origin_of, run_bounded
from .discover import Found, discover

BACKFILL = 8
_FETCHED = "ord long, url string, final_url string, status int, content_type string, body string, fetch_ms double, ok boolean, error string, failure_kind string, source string"


#: Errors that the summary of a run over a corpus lists; `RunResult.errors` has all.
LISTED = 10


class RunResult:
    """The records of a run, and its summary, made when it is asked for."""

    def __init__(self, records: DataFrame, summarise: Callable[[], dict]):
        self.records = records
        self._summarise = summarise

    @functools.cached_property
    def summary(self) -> dict:
        return self._summarise()

    @property
    def errors(self) -> DataFrame:
        return summary.errors(self.records)


def pages_to_fetched(pages: DataFrame, source: str = "crawl") -> DataFrame:
    """A table (page_id, url, html) as fetched rows; the id gives the order."""
    return pages.select(
        F.col("page_id").cast("long").alias("ord"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"), F.lit(0.0).alias("fetch_ms"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("failure_kind"), F.lit(source).alias("source"),
    )


def finish(records: DataFrame, most: int | None = None) -> DataFrame:
    """Paths and rewritten links of deduplicated records; only keys and paths are kept on the way."""
    named = records.select(*[c for c in records.columns if c != "markdown"])
    places = written(paths.assign_paths(named, most).select("ord", "output_path"))
    return written(paths.rewrite_links(records.drop("output_path").join(places, "ord").select(*records.columns)))


def snapshot_of(records: DataFrame) -> tuple[str, int, int]:
    files = records.where("ok and coalesce(output_path, '') <> ''").select(F.col("output_path").alias("path"), render.rendered().alias("body"))
    return snapshot.root(files)


def run_corpus(fetched: DataFrame, config: Config = Config(), mode: str = "routes", strict: bool = False) -> RunResult:
    """Everything after fetching, for any number of pages. `strict` as in `dom.tree`."""
    began = time.perf_counter()
    records = written(extract.extract(A.reject_non_pages(fetched), strict))
    kept = written(dedup.dedupe(records, mode))
    done = finish(kept, config.max if config.max_explicit else None)
    elapsed = (time.perf_counter() - began) * 1000

    def summarise() -> dict:
        attempted = records.count()
        return summary.run_summary(done, config, attempted, attempted - done.count(), snapshot_of(done), elapsed, LISTED)

    return RunResult(done, summarise)


def fetched_rows(spark: SparkSession, found: list[Found], first: int, fetch: Callable[[str], R.State], config: Config) -> DataFrame:
    """The found URLs with their answers: many at once, but few of one origin, in order."""
    states = run_bounded(found, lambda f: f.fetched or fetch(f.url), lambda f: origin_of(f.url), config.concurrency, config.per_origin)
    rows = []
    for i, (item, s) in enumerate(zip(found, states, strict=True), first):
        rows.append((i, item.url, s.at, s.status, s.content_type, s.body, 0.0, s.ok, s.error, s.failure_kind, item.source))
    return spark.createDataFrame(rows, _FETCHED)


def needs_backfill(config: Config, records: DataFrame, discovered: int) -> bool:
    if not config.max_explicit or config.page_only or discovered < config.max:
        return False
    facts = records.agg(F.count_if("ok").alias("good"), F.count_if(F.col("failure_kind") == "empty").alias("hollow")).first()
    return facts.good < config.max and facts.hollow > 0


def backfill_candidates(found: DataFrame, seen: DataFrame, most: int = BACKFILL) -> DataFrame:
    """The first rows (ord, url) whose candidate key is new, each key once."""
    keyed = found.withColumn("key", U.candidate_key("url")).join(seen.select(U.candidate_key("url").alias("key")).distinct(), "key", "left_anti")
    return keyed.groupBy("key").agg(F.min_by(F.struct(*found.columns), "ord").alias("row")).select("row.*").orderBy("ord").limit(most)


def archive_fetch(archive: DataFrame, config: Config) -> Callable[[str], R.State]:
    """Single lookups in an archive, for discovery's probes; answers are remembered."""
    held: dict[str, R.Response | None] = {}

    def answer(url: str) -> R.Response | None:
        if url not in held:
            row = archive.where(F.col("url") == url).first()
            held[url] = None if row is None else R.Response(row.status, dict(row.headers or {}), bytes(row.body or b""), tuple(row.set_cookies or ()))
        return held[url]

    return lambda url: A.fetch_one(answer, url, R.Limits(config.max_bytes))


def run_site(spark: SparkSession, config: Config, fetch: Callable[[str], R.State], note: Callable[[str], None] = lambda m: None) -> RunResult:
    """A whole run for one seed: discover, fetch, extract, deduplicate, backfill, write."""
    began = time.perf_counter()
    sinks.prepare_output(config.out_dir, config.clean, config.dry_run)
    note("discovering")
    found = discover(config, fetch)
    note(f"fetching {len(found)} pages")
    first = settle(extract.extract(A.reject_non_pages(fetched_rows(spark, found, 0, fetch, config))))
    kept = settle(dedup.dedupe(first, "sequential"))
    attempted, deduped = len(found), first.count() - kept.count()
    if needs_backfill(config, kept, len(found)):
        note("backfilling")
        more = discover(replace(config, max=config.max + BACKFILL), fetch)
        table = spark.createDataFrame([(i, f.url) for i, f in enumerate(more)], "ord long, url string")
        fresh = [more[r.ord] for r in backfill_candidates(table, spark.createDataFrame([(f.url,) for f in found], "url string")).collect()]
        if fresh:
            extra = extract.extract(A.reject_non_pages(fetched_rows(spark, fresh, len(found), fetch, config)))
            both = settle(kept.unionByName(extra))
            kept = settle(dedup.dedupe(both, "sequential"))
            attempted, deduped = attempted + len(fresh), deduped + both.count() - kept.count()
    done = finish(kept, config.max if config.max_explicit else None)
    snap = snapshot_of(done)
    if not config.dry_run:
        note("writing output")
        sinks.write_pages(done, config.out_dir).count()
    facts = summary.run_summary(done, config, attempted, deduped, snap, (time.perf_counter() - began) * 1000)
    if not config.dry_run:
        sinks.write_run_files(done, facts, config.out_dir)
        if config.agent_files:
            sinks.install_agent_files(facts)
    return RunResult(done, lambda: facts)
