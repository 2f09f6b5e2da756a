"""Page quality in hundredths: exact integer arithmetic, divided once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_START, SPACE, bound, length_utf16, link_count, text_column, word_count

LOW_QUALITY = 0.6


def quality(markdown: Column | str, title: Column | str) -> Column:
    """Struct (confidence, reasons) of a page. The text is measured once, then judged."""
    markdown = text_column(markdown)
    measures = F.struct(
        (F.coalesce(text_column(title), F.lit("")) != "").alias("titled"),
        word_count(markdown).alias("words"),
        link_count(markdown).alias("links"),
        markdown.rlike(rf"{LINE_START}#{{1,6}}[{SPACE}]").alias("headed"),
        F.regexp_count(markdown, F.lit("```")).alias("fences"),
        length_utf16(markdown).alias("size"),
        markdown.rlike("[.!?]").alias("ended"),
        markdown.rlike(rf"[.!?][{SPACE}]").alias("sentences"),
    )
    return bound(measures, _judged)


def _judged(m: Column) -> Column:
    titled, words, links, fences, size = m["titled"], m["words"], m["links"], m["fences"], m["size"]
    dense = links > F.greatest(F.lit(20.0), words / 8)
    odd = fences % 2 == 1
    thin = words < 40
    useful = (
        ((fences >= 2) & (words >= 12) & (size >= 160))
        | ((links >= 5) & (words >= 8) & (size >= 400))
        | ((links >= 1) & (words >= 14) & (size >= 170) & m["sentences"])
        | (titled & (words >= 10) & (size >= 80) & ((links > 0) | m["ended"]))
        | (titled & (words >= 24) & (size >= 180) & m["sentences"])
    )
    points = F.lit(100)
    for condition, cost in ((~titled, 15), (thin, 35), (~m["headed"], 10), (dense, 20), (odd, 10)):
        points = points - F.when(condition, cost).otherwise(0)
    points = F.greatest(F.when(useful, F.greatest(points, F.lit(65))).otherwise(points), F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(~titled, F.lit("missing title")),
            F.when(thin & ~useful, F.lit("thin content")),
            F.when(dense, F.lit("high link density")),
            F.when(odd, F.lit("unbalanced code fences")),
        )
    )
    return F.struct((points / F.lit(100.0)).alias("confidence"), reasons.alias("reasons"))


def low_quality(confidence: Column | str) -> Column:
    return text_column(confidence) < LOW_QUALITY
