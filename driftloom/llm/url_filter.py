"""URL filters by rules and a ratio of two character language models.

URLs that a rule accepts or rejects train two smoothed variable-order Markov
models of characters; other URLs are accepted if the log-likelihood difference
of the two, divided by the length, reaches a threshold. The threshold is
calibrated on those of the rules' URLs that a hash keeps out of the training (one
in HELD, copies together). Everything is DataFrame expressions.

Smoothing is Witten-Bell: p(c|context) mixes the context's counts with
p(c|shorter context). A model is a table of character sequences up to ORDER + 1
long; each row holds how much its longest context changes the log ratio against
the next shorter one, and each known context how much a character never
seen after it changes it, so the sum over a URL is the log ratio with the longest
known context at every character. The table keeps all sequences, so it grows
with the input. What a character adds depends only on its window, itself and the
ORDER characters before: distinct windows look their sequences up in a shuffled
join, then distinct texts look up their windows.

Defined results: a null URL or one without `://` has empty host and path; an
empty text after `://` scores 0; without URLs of both verdicts everything that
no rule judges is allowed; if the URLs kept out lack one verdict, those trained on
serve for the threshold too; a score equal to the threshold is accepted; URLs are
read whole; repeated rows are judged each; an empty table gives an empty result;
other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime as rt

#: (verdict, host and path) of each rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

ORDER = 4
#: Sequences up to this length are spread over so many parts where texts look them up.
HOT_LENGTH, SALTS = 3, 32
#: Characters that a text may hold besides those seen.
ALPHABET = 256
#: Log ratios are summed as integers of this many parts, so sums do not depend on their order.
PARTS = 1 << 20
#: Steps of the threshold between scores of -8 and 8.
BINS = 8192
#: One in so many of the rules' distinct URLs calibrates the threshold and does not train the models.
HELD = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(rest: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def fits(rule: str, host: Column, path: Column) -> Column:
    at = rule.index("/")
    return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, the longest fitting rule, its verdict, the text to model, and whether that calibrates."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", after_scheme(url).alias("rest"))
    rows = rows.select("page_id", "rest", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: len(x[1])):
        hit = fits(text, F.col("host"), F.col("path"))
        rule, verdict = F.when(hit, F.lit(text)).otherwise(rule), F.when(hit, F.lit(said)).otherwise(verdict)
    text = F.concat(F.lit("\n"), "rest")
    held = F.pmod(F.xxhash64(text), F.lit(HELD)) == 0
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), text.alias("text"), held.alias("held"))


def sequences(text: Column, order: int = ORDER) -> Column:
    """All runs of 1 to order + 1 characters, overlapping ones too."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in range(1, order + 2)])


def model(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """`seq`, `gain` (what the sequence adds to the log ratio of accepted to rejected), `context` (all but its last
    character) and `back` (what a character never seen after that context adds)."""
    texts = rows.where("said is not null").groupBy("text", (F.col("said") == "allow").alias("good")).agg(F.count(F.lit(1)).alias("times"))
    runs = texts.select(F.explode(sequences(F.col("text"), order)).alias("seq"), "good", "times")
    times = lambda hit: F.sum(F.when(hit, F.col("times")).otherwise(0))
    counts = runs.groupBy("seq").agg(times(F.col("good")).alias("a"), times(~F.col("good")).alias("r"))
    counts = rt.materialise(counts.withColumn("k", F.char_length("seq")), "sequences")
    flat = F.lit(1.0 / ALPHABET)
    done, shorter = None, None
    for k in range(1, order + 2):
        level = counts.where(F.col("k") == k).withColumn("context", F.substring("seq", 1, k - 1)).withColumn("suffix", F.substring("seq", 2, k - 1))
        inside = W.partitionBy("context")
        for c in "ar":
            level = level.withColumn(f"n{c}", F.sum(c).over(inside)).withColumn(f"t{c}", F.sum((F.col(c) > 0).cast("long")).over(inside))
        if shorter is None:
            level = level.withColumn("qa", flat).withColumn("qr", flat)
        else:
            level = level.join(shorter.select(F.col("seq").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "suffix")
        for c in "ar":
            novel = F.greatest(f"t{c}", F.lit(1))
            level = level.withColumn(f"p{c}", (F.col(c) + novel * F.col(f"q{c}")) / (F.col(f"n{c}") + novel))
        gain = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("qa") / F.col("qr"))
        escape = [F.log(F.greatest(f"t{c}", F.lit(1)) / (F.col(f"n{c}") + F.greatest(f"t{c}", F.lit(1)))) for c in "ar"]
        back = F.round((escape[0] - escape[1]) * PARTS).cast("long").alias("back")
        level = rt.materialise(level.select("seq", "pa", "pr", F.round(gain * PARTS).cast("long").alias("gain"), "context", back), "level")
        shorter = level
        done = level if done is None else done.unionByName(level)
    return done.select("seq", "gain", "context", "back")


def train(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """`seq` and `gain` of the model."""
    return model(rows, order).select("seq", "gain")


def lookups(known: DataFrame) -> DataFrame:
    """`seq`, `gain` where a character completes the sequence, `back` where one follows it.

    A character after a known context adds the context's back-off unless the longer
    sequence is known, so the back-off counts with the context and a known sequence's
    gain is lessened by it.
    """
    ends = known.select("seq", (F.col("gain") - F.col("back")).alias("gain"), F.lit(0).cast("long").alias("back"))
    contexts = known.select(F.col("context").alias("seq"), "back").distinct().select("seq", F.lit(0).cast("long").alias("gain"), "back")
    return ends.unionByName(contexts).groupBy("seq").agg(F.sum("gain").alias("gain"), F.sum("back").alias("back"))


def salted(runs: DataFrame, table: DataFrame) -> DataFrame:
    """`runs` joined with `table` on seq; rows of short sequences, which most texts hold, go to SALTS parts of a key."""
    parts = F.when(F.char_length("seq") <= HOT_LENGTH, F.lit(SALTS)).otherwise(F.lit(1))
    left = runs.withColumn("part", F.pmod(F.xxhash64("uid"), parts))
    right = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
    return left.join(right, ["seq", "part"])


def windows(text: Column, order: int = ORDER) -> Column:
    """For each character of a text that is not empty, itself and the `order` characters before, as far as there are any."""
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.char_length(text))), lambda k: F.substring(text, F.lit(1), k))
    return F.concat(heads, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1)))


def window_sums(found: DataFrame, table: DataFrame) -> DataFrame:
    """`window` and the log ratio `sum` of its last character: of each sequence that ends with it, and of each that leads to it."""
    text, size = F.col("window"), F.char_length("window")
    ends = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(F.substring(text, size - k + 1, k).alias("seq"), F.lit(True).alias("ends")))
    leads = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(F.substring(text, size - k, k).alias("seq"), F.lit(False).alias("ends")))
    runs = found.select(F.xxhash64("window").alias("uid"), "window", F.explode(F.concat(ends, leads)).alias("x")).select("uid", "window", "x.seq", "x.ends")
    return salted(runs, table).groupBy("window").agg(F.sum(F.when(F.col("ends"), F.col("gain")).otherwise(F.col("back"))).alias("sum"))


def scored(rows: DataFrame, known: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows with `score`: the log ratio of accepted to rejected for each character."""
    spark = rows.sparkSession
    table = rt.materialise(lookups(known), "lookups")
    distinct = rows.select("text").distinct()
    # An explicit number of tasks: a small table of texts still makes many windows.
    distinct = distinct.repartition(rt.tasks_for(spark, rows.count(), rt.ROWS_PER_TASK // 16), "text")
    texts = rt.materialise(rt.with_row_id(distinct, "uid"), "texts")
    places = texts.select("uid", F.explode(windows(F.col("text"), order)).alias("window"))
    sums = rt.materialise(window_sums(places.select("window").distinct(), table), "windows")
    gains = places.join(sums, "window").groupBy("uid").agg(F.sum("sum").alias("gain"))
    gains = texts.join(gains, "uid", "left").select("text", "gain")
    score = F.coalesce(F.col("gain"), F.lit(0)) / PARTS / F.char_length("text")
    return rows.join(gains, "text").withColumn("score", score).drop("gain", "text")


def threshold(rows: DataFrame) -> float:
    """The score that best parts the rules' URLs that calibrate: least sum of the two error rates, over BINS steps."""
    step = F.floor(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("score"))) * (BINS / 16)).cast("int")
    table = rows.where("said is not null").groupBy("held", step.alias("bin"), (F.col("said") == "allow").alias("good")).count().collect()
    for kept_out in (True, False):
        some = [r for r in table if r["held"] == kept_out]
        good = {r["bin"]: r["count"] for r in some if r["good"]}
        bad = {r["bin"]: r["count"] for r in some if not r["good"]}
        if good and bad:
            return _best_cut(good, bad)
    return float("-inf")


def _best_cut(good: dict[int, int], bad: dict[int, int]) -> float:
    n, m = sum(good.values()), sum(bad.values())
    lost, passed, best = 0, m, None
    for at in range(-BINS // 2, BINS // 2 + 2):
        error = lost / n + passed / m
        if best is None or error < best[0]:
            best = (error, at, at)
        elif error == best[0] and best[2] == at - 1:
            best = (error, best[1], at)
        lost, passed = lost + good.get(at, 0), passed - bad.get(at, 0)
    return (best[1] + best[2]) / 2 * 16 / BINS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and `held` (whether it calibrates) of each URL."""
    rows = rt.materialise(ruled(pages, rules), "urls")
    with rt.passing():
        found = rt.materialise(scored(rows, model(rows.where(~F.col("held")))), "scores")
    rt.discard(rows)
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold(found), "allow").otherwise("block"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "held")
