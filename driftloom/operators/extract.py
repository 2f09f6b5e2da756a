"""From fetched bodies to page records: classification, extraction, scoring.

One Arrow pass (`page_features`) reads the HTML; the decision tree, cleaning's
outcome, failures and scores are Column expressions over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions import urls as U
from ..functions.markdown_clean import clean_markdown
from ..functions.quality import quality
from ..functions.weburl import parse
from ..workers import small_batches
from . import dom

FEATURES = (
    "title string, canonical_href string, base_href string, main_markdown string, page_text string, metadata string, outline string, "
    "serialised string, anchors array<string>, nav array<string>, scripts array<string>, n_anchors int, body_chars int, fault string"
)
_TYPES = pa.struct(
    [(n, pa.list_(pa.string()) if n in ("anchors", "nav", "scripts") else pa.int32() if n in ("n_anchors", "body_chars") else pa.string()) for n in (x.split()[0] for x in FEATURES.split(", "))]
)

# Marks of structured texts, Markdown types, markup, app shells and challenges.
STRUCTURED_TYPE = r"(?i)json|ya?ml|xml|toml"
STRUCTURED_FILE = r"(?i)\.(?:json|ya?ml|xml|toml)$"
MARKDOWN_TYPE = r"(?i)markdown|mdx|text/plain"
MARKUP = rf"(?i)</?[a-z][A-Za-z0-9_:-]*(?:[{T.SPACE}]|>|/>)"
SHELL_MARKS = (
    r"(?i)__docusaurus|v-app-loading|enable javascript in your browser|zdWebClientConfig|catalog-app|react-target|app-root"
    r"|id=[\"']app[\"']|ohcglobal|__meteor_runtime_config__|raw\.githubusercontent\.com"
)
PLACEHOLDER_MARKS = r"(?i)catalog-app|react-target|app-root|ohcglobal|__meteor_runtime_config__|raw\.githubusercontent\.com"
APP_MARKS = r"(?i)zdWebClientConfig|catalog-app|react-target|app-root|ohcglobal|__meteor_runtime_config__"
SELECTOR_PATH = r"(?i)/select-language(?:[/?#]|$)"
SELECTOR_MARKS = r"(?i)path-select-language|ecl-splash-page__language|currentPath\":\"select-language"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
PLAIN_LINK = r"\[[^\]]+\]\([^)]+\)"


def has_markup(body: Column) -> Column:
    return body.rlike(MARKUP)


def is_structured(content_type: Column, final_url: Column, body: Column) -> Column:
    return content_type.rlike(STRUCTURED_TYPE) | (U.path(final_url).rlike(STRUCTURED_FILE) & ~has_markup(body))


def is_markdown(content_type: Column, body: Column) -> Column:
    return ~has_markup(body) | content_type.rlike(MARKDOWN_TYPE)


def body_class(content_type: Column, final_url: Column, body: Column) -> Column:
    """`text`, `markdown` or `html`."""
    return F.when(is_structured(content_type, final_url, body), "text").when(is_markdown(content_type, body), "markdown").otherwise("html")


def is_language_selector(final_url: Column, body: Column) -> Column:
    return final_url.rlike(SELECTOR_PATH) & body.rlike(SELECTOR_MARKS)


def is_challenge(markdown: Column, title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)client challenge") | markdown.rlike("(?i)required part of this site couldn.t load")


def empty_error(body: Column) -> Column:
    return F.when(body.rlike(SHELL_MARKS), "app shell without static text").otherwise("empty content")


def is_placeholder(markdown: Column, title: Column, body: Column) -> Column:
    """Content of a page whose text only scripts would fill in."""
    bare = T.strip(F.regexp_replace(markdown, rf"^#+[{T.SPACE}]*", ""))
    few = T.word_count(markdown)
    named = F.coalesce(title, F.lit("")) != ""
    untold = ((named & (bare == T.strip(title))) | ((few <= 2) & body.rlike(r"(?i)raw\.githubusercontent\.com|xhrPromise"))) & body.rlike(PLACEHOLDER_MARKS)
    search = markdown.rlike(rf"(?i)^[{T.SPACE}]*search[{T.SPACE}]*\z") & body.rlike(r"(?i)<input[^>]+type=[\"']search[\"']|placeholder=[\"']search[\"']|class=[\"'][^\"']*search") & body.rlike("(?i)__docusaurus")
    bare_app = title.isNotNull() & (few <= 8) & F.contains(markdown, title) & body.rlike(rf"(?i)<div[^>]+id=[\"']app[\"'][^>]*>[{T.SPACE}]*</div>")
    return F.coalesce(untold, F.lit(False)) | search | F.coalesce(bare_app, F.lit(False))


def is_degenerate(markdown: Column) -> Column:
    """Only links, only media, or little but both."""
    few, links = T.word_count(markdown), T.link_count(markdown)
    images = F.regexp_count(markdown, F.lit(IMAGE))
    no_media = F.regexp_replace(F.regexp_replace(markdown, IMAGE, ""), PLAIN_LINK, "")
    no_links = F.regexp_replace(markdown, PLAIN_LINK, "")
    blank = lambda c: F.regexp_replace(c, rf"[{T.SPACE}]+", "") == ""
    no_chrome = F.regexp_replace(no_media, r"[>#|/\\\-–—:]+", " ")
    return (
        ((links >= 2) & (few <= 8) & blank(no_links))
        | ((images > 0) & (few <= 6) & blank(no_media))
        | ((images + links >= 2) & (few <= 16) & (T.word_count(no_chrome) <= 2))
    )


def text_asset(final_url: Column, body: Column) -> Column:
    """A structured file as a titled fenced block."""
    fence = F.when(F.contains(body, F.lit("```")), "````").otherwise("```")
    return F.concat(F.lit("# "), U.path(final_url), F.lit("\n\n"), fence, U.fence_language(final_url), F.lit("\n"), T.strip(body), F.lit("\n"), fence)


def _features(html: str | None, strict: bool) -> dict | None:
    """The features of a page; one that cannot be read (nested too deep, say) gives its fault, not a failed task."""
    if html is None:
        return None
    try:
        return dom.features(html, strict)
    except Exception as fault:  # noqa: BLE001
        return {"main_markdown": "", "page_text": "", "anchors": [], "nav": [], "scripts": [], "fault": f"{type(fault).__name__}: {fault}"[:300]}


def page_features(fetched: DataFrame, body: str = "body", needed: Column | None = None, strict: bool = False) -> DataFrame:
    """Adds the struct `dom` of FEATURES; null where `needed` does not hold. `strict` as in `dom.tree`."""
    small_batches(fetched.sparkSession)
    kept, html = fetched.columns, "__html"
    while html in kept:
        html += "_"
    rows = fetched.withColumn(html, F.when(needed, F.col(body)) if needed is not None else F.col(body))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few pages at a time, as each may be large.
        for batch in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            at = batch.schema.get_field_index(html)
            found = [_features(x, strict) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(found, _TYPES)], names=[*kept, "dom"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fetched.schema), "dom struct<" + FEATURES.replace(" ", ":").replace(",:", ",") + ">"])
    return rows.mapInArrow(read, schema)


@F.pandas_udf(StringType())
def resolve_bare(href, base):
    """The absolute URL of a reference without query and fragment; null if it has none."""
    import pandas as pd

    out = []
    for h, b in zip(href, base, strict=True):
        url = parse(h, b) if h else None
        out.append(url.bare().href if url else None)
    return pd.Series(out, dtype=object)


def extract(fetched: DataFrame, strict: bool = False) -> DataFrame:
    """Page records of fetched rows (ord, url, final_url, status, content_type, body, fetch_ms, ok, error, failure_kind, source); other columns go. `strict` as in `dom.tree`."""
    fetched = fetched.select("ord", "url", "final_url", "status", "content_type", "body", "fetch_ms", "ok", "error", "failure_kind", "source")
    body, final, kind = F.coalesce("body", F.lit("")), F.col("final_url"), F.coalesce("content_type", F.lit(""))
    rows = fetched.withColumn("class", F.when(F.col("ok"), body_class(kind, final, body)))
    rows = page_features(rows, "body", F.col("class") == "html", strict)
    d = lambda name: F.col(f"dom.{name}")
    main, title = T.strip(d("main_markdown")), F.nullif(d("title"), F.lit(""))
    weak = quality(main, title)["confidence"] < 0.6
    rescued = is_degenerate(main) & (T.word_count(d("page_text")) > 20)
    bare = F.when((T.word_count(d("page_text")) < 40) & d("serialised").isNotNull(), d("serialised")).otherwise(
        F.coalesce(F.nullif(d("page_text"), F.lit("")), d("metadata"), F.lit(""))
    )
    bare = F.when(is_placeholder(bare, title, body), "").otherwise(bare)
    choice = (
        F.when(F.col("class") == "text", F.struct(text_asset(final, body).alias("md"), F.lit("text").alias("by")))
        .when(F.col("class") == "markdown", F.struct(T.strip(body).alias("md"), F.lit("markdown").alias("by")))
        .when(d("outline").isNotNull(), F.struct(d("outline").alias("md"), F.lit("fallback").alias("by")))
        .when(main == "", F.struct(bare.alias("md"), F.lit("fallback").alias("by")))
        .when(is_placeholder(main, title, body), F.struct(F.lit("").alias("md"), F.lit("fallback").alias("by")))
        .when(weak & d("serialised").isNotNull(), F.struct(d("serialised").alias("md"), F.lit("fallback").alias("by")))
        .when(rescued, F.struct(d("page_text").alias("md"), F.lit("fallback").alias("by")))
        .otherwise(F.struct(main.alias("md"), F.lit("html").alias("by")))
    )
    page_title = F.when(F.col("class") == "text", U.path(final)).when(F.col("class") == "markdown", T.markdown_title(body, U.path(final))).otherwise(title)
    rows = rows.withColumn("choice", choice).withColumn("title", page_title)
    rows = rows.withColumn("clean", F.when(F.col("ok"), clean_markdown(F.col("choice.md"))))
    rows = rows.withColumn("canonical_url", resolve_bare(d("canonical_href"), final))
    fails = (
        F.when(~F.col("ok"), F.struct(F.col("error").alias("error"), F.col("failure_kind").alias("kind")))
        .when(d("fault").isNotNull(), F.struct(d("fault").alias("error"), F.lit("extract").alias("kind")))
        .when(F.col("clean") == "", F.struct(empty_error(body).alias("error"), F.lit("empty").alias("kind")))
        .when(is_challenge(F.col("clean"), F.col("title")), F.struct(F.lit("blocked by client challenge").alias("error"), F.lit("blocked").alias("kind")))
        .when(is_language_selector(final, body), F.struct(F.lit("language selector without article content").alias("error"), F.lit("empty").alias("kind")))
    )
    rows = rows.withColumn("fail", fails).withColumn("score", quality(F.col("clean"), F.col("title")))
    return rows.select("ord", "url", "final_url", "status", "source", "fetch_ms", *record_columns())


def record_columns() -> list[Column]:
    good = F.col("fail").isNull()
    by = F.col("choice.by")
    capped = (by == "fallback") & (T.word_count("clean") < 20) & F.array_contains("score.reasons", "thin content")
    confidence = F.when(capped, F.least(F.col("score.confidence"), F.lit(0.55))).otherwise(F.col("score.confidence"))
    none = F.array().cast("array<string>")
    return [
        good.alias("ok"),
        F.when(good, F.col("canonical_url")).alias("canonical_url"),
        F.lit(None).cast("array<string>").alias("aliases"),
        F.when(good, F.col("title")).alias("title"),
        F.when(good, F.col("clean")).otherwise("").alias("markdown"),
        F.when(good, T.link_hrefs("clean")).otherwise(none).alias("links"),
        F.when(good, F.sha2(F.col("clean").cast("binary"), 256)).otherwise("").alias("content_hash"),
        F.when(good, by).otherwise("none").alias("extractor"),
        F.when(good, confidence).otherwise(0.0).alias("confidence"),
        F.when(good, F.col("score.reasons")).otherwise(none).alias("quality_reasons"),
        F.lit(None).cast("string").alias("output_path"),
        F.col("fail.error").alias("error"),
        F.col("fail.kind").alias("failure_kind"),
    ]


def looks_like_app(body: Column, features: Column) -> Column:
    """A page that scripts fill in: a known mark, or assets with little text and few links."""
    few = (F.size(features["scripts"]) > 0) & (features["body_chars"] < 500) & (features["n_anchors"] < 5)
    return body.rlike(APP_MARKS) | few
