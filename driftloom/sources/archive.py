"""Fetching from an archive table (url, status, headers, set_cookies, body) by joins.

The archive is dealt by URL once (`dealt`), one answer each. All wanted URLs go
forward together: each hop joins their present addresses with the dealt archive
and applies the fetching rules; URLs that are through leave. A hop moves only
the addresses that are still on their way, never the archive. Hops are bounded
by the limits on redirects and refreshes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import urls as U
from ..operators.scratch import settle
from . import fetching as R

ARCHIVE = "url string, status int, headers map<string,string>, set_cookies array<string>, body binary"
_STATE = (
    "ord long, source string, url string, at string, start string, redirects array<string>, fallbacks array<string>, refreshes array<string>, "
    "rounds int, done boolean, status int, content_type string, body string, ok boolean, error string, failure_kind string"
)
_TYPES = {"array<string>": pa.list_(pa.string()), "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(n, _TYPES[t]) for n, t in (x.split() for x in _STATE.split(", "))]
FETCHED = ("ord", "url", "final_url", "status", "content_type", "body", "fetch_ms", "ok", "error", "failure_kind", "source")


def archive_of_pages(pages: DataFrame) -> DataFrame:
    """A table (url, html) of pages as an archive of successful answers."""
    return pages.select(
        "url",
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.array().cast("array<string>").alias("set_cookies"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"),
    )


def dealt(archive: DataFrame) -> DataFrame:
    """`at`, `answer` for each URL of an archive, dealt by `at`.

    Of several answers the latest by the column `fetched_at` is taken, where the
    archive has one; then a success, the longer body, and the body itself decide.
    """
    parts = int(archive.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moment = F.col("fetched_at") if "fetched_at" in archive.columns else F.lit(None).cast("timestamp")
    order = F.struct(moment, F.col("status").between(200, 299), F.octet_length("body"), F.sha2("body", 256))
    rows = archive.withColumn("order", order).repartition(parts, "url")
    return settle(rows.groupBy(F.col("url").alias("at")).agg(F.max_by(F.struct("status", "headers", "body"), "order").alias("answer")))


def fetch(wanted: DataFrame, archive: DataFrame, max_bytes: int = 12 << 20, public_only: bool = True) -> DataFrame:
    """Rows FETCHED for the rows (ord, url, source) of `wanted`."""
    limits = R.Limits(max_bytes, public_only)
    answers = dealt(archive)
    none = F.array().cast("array<string>")
    state = wanted.select(
        F.col("ord").cast("long").alias("ord"), "source", "url", F.col("url").alias("at"), F.col("url").alias("start"), none.alias("redirects"), none.alias("fallbacks"), none.alias("refreshes"),
        F.lit(0).alias("rounds"), F.lit(False).alias("done"), F.lit(0).alias("status"), F.lit("").alias("content_type"), F.lit("").alias("body"), F.lit(False).alias("ok"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("failure_kind"),
    )

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            out = []
            for row in batch.to_pylist():
                answer, place, source = row.pop("answer"), row.pop("ord"), row.pop("source")
                here = R.State(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})
                got = None if answer is None else R.Response(answer["status"], dict(answer["headers"] or {}), answer["body"] or b"")
                out.append({"ord": place, "source": source, **asdict(R.advance(here, got, limits))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS))

    through = []
    for _ in range(R.REFRESHES * (R.REDIRECTS + 1)):
        state = settle(state.join(answers, "at", "left").mapInArrow(hop, _STATE))
        through.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
    done = through[0]
    for more in through[1:]:
        done = done.unionByName(more)
    done = done.select("ord", "url", F.col("at").alias("final_url"), "status", "content_type", "body", F.lit(0.0).alias("fetch_ms"), "ok", "error", "failure_kind", "source")
    return add_topics(done, answers)


@F.pandas_udf(StringType())
def _topic_url(body, base):
    import pandas as pd

    return pd.Series([R.topic_url(b, u) if b and "data-topic" in b.lower() else None for b, u in zip(body, base, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _with_topic(body, topic, base):
    import pandas as pd

    return pd.Series([R.with_topic(b, t.decode("utf-8", "replace"), u) if t else b for b, t, u in zip(body, topic, base, strict=True)], dtype=object)


def add_topics(fetched: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages that keep their text in a JSON file get it from the `dealt` archive; other pages do not move."""
    asked = fetched.withColumn("topic_url", F.when(F.col("ok") & F.col("content_type").contains("html"), _topic_url("body", "final_url")))
    topics = answers.where("answer.status between 200 and 299").select(F.col("at").alias("topic_url"), F.col("answer.body").alias("topic"))
    body = F.when(F.col("topic").isNotNull(), _with_topic("body", "topic", "final_url")).otherwise(F.col("body"))
    found = asked.where("topic_url is not null").join(topics, "topic_url", "left").withColumn("body", body).select(*FETCHED)
    return asked.where("topic_url is null").select(*FETCHED).unionByName(found)


def reject_non_pages(fetched: DataFrame) -> DataFrame:
    """Answers whose final URL is no page become failures."""
    bad = F.col("ok") & U.normalise_reference("final_url", F.lit(None).cast("string")).isNull()
    return (
        fetched.withColumn("error", F.when(bad, "redirected to a filtered non-page URL").otherwise(F.col("error")))
        .withColumn("failure_kind", F.when(bad, "blocked").otherwise(F.col("failure_kind")))
        .withColumn("ok", F.col("ok") & ~bad)
    )


def fetch_one(answers, url: str, limits: R.Limits) -> R.State:
    """Driver-side fetch of one URL by a lookup `answers(url) -> Response | None`, for discovery's few probes."""
    state = R.State.of(url)
    while not state.done:
        state = R.advance(state, answers(state.at), limits)
    if state.ok and (topic := R.topic_url(state.body, state.at)) and (answer := answers(topic)) and 200 <= answer.status <= 299:
        state = replace(state, body=R.with_topic(state.body, answer.body.decode("utf-8", "replace"), state.at))
    return state
