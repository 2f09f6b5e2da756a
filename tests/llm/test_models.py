import zlib
from itertools import combinations

import numpy as np

from driftloom.llm import language_id, packing, queries, sharding, toxicity, url_filter

WORDS = {"en": ["the", "water", "house", "thing", "which", "would"], "de": ["der", "wasser", "haus", "ding", "welche", "würde"]}


def field():
    rng = np.random.default_rng(0)
    return language_id.fit({k: [list(rng.choice(v, 48)) for _ in range(40)] for k, v in WORDS.items()})


def brute_marginals(e, transitions, start):
    from itertools import product

    t, n = e.shape
    prob = np.zeros((t, n))
    for path in product(range(n), repeat=t):
        w = np.exp(start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            prob[i, y] += w
    return prob / prob.sum(axis=1, keepdims=True)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    e, tr, st = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([5, 2, 1])
    got = language_id.marginals(e, lengths, tr, st)[0]
    for r, n in enumerate(lengths):
        assert np.allclose(got[r, :n], brute_marginals(e[r, :n], tr, st))


def test_code_switched_words():
    model = field()
    words = dict(language_id.label_words(model, "The water house würde der Wasser haus"))
    assert words["water"] == "en" and words["wasser"] == "de" and words["der"] == "de" and words["the"] == "en"
    assert language_id.label_words(model, "12 --") == []


def test_language_of_awkward_rows(docs, rows, none):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id}
    assert by[4] == by[5] == by[6] == by[11] == "und" and by[1] == "en"
    assert {r.doc_id: r.held_out for r in got if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows if i}
    assert language_id.identify(none).count() == 0


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_toxicity_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(300)]

    def text(toxic):
        return " ".join([*rng.choice(plain, 30), *(rng.choice(["vile", "foul", "rude"], 2) if toxic else [])])

    truth = rng.random(3000) < 0.1
    texts = [text(t) for t in truth]
    hashes = [toxicity.word_hashes(t) for t in texts]
    marked = [h for h, t in zip(hashes, truth, strict=True) if t][:100]
    model = toxicity.fit(marked, hashes, 0.1)
    fresh = [(text(t), t) for t in rng.random(1000) < 0.1]
    right = [(model.score(x) >= 0.5) == t for x, t in fresh]
    assert np.mean(right) > 0.98


def test_toxicity_of_awkward_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (2, 1, 0), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    nothing = labels.where("doc_id > 100")
    assert toxicity.score(docs, nothing).count() == len(rows)
    assert toxicity.score(none, nothing).count() == 0


def test_toxicity_on_table(spark, small):
    got = toxicity.score(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    both = got.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted for r in both if r.toxic == 0) == 0
    assert sum(r.predicted for r in both if r.toxic == 1 and not r.held_out) > 0


def test_risk_and_gradient_against_plain_versions():
    rng = np.random.default_rng(12)
    x, u = (np.c_[rng.integers(0, 2, (n, 5)), np.ones(n)].astype(float) for n in (20, 30))
    w, prior = rng.normal(size=6), 0.2
    loss = lambda g: 1 / (1 + np.exp(g))
    positive = prior * np.mean([loss(r @ w) for r in x])
    negative = np.mean([loss(-(r @ w)) for r in u]) - prior * np.mean([loss(-(r @ w)) for r in x])
    got = toxicity.risk(w, x, u, prior)
    assert abs(got[0] - positive) < 1e-12 and abs(got[1] - negative) < 1e-12
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        above, below = toxicity.risk(w + step, x, u, prior), toxicity.risk(w - step, x, u, prior)
        assert abs((above[0] - below[0]) / 2e-6 - got[2][k]) < 1e-8 and abs((above[1] - below[1]) / 2e-6 - got[3][k]) < 1e-8


def test_samples_are_bounded_by_rows(spark):
    """One id, 20,000 times, alone or with texts of its own, gives no more rows than the bound."""
    from pyspark.sql import functions as F

    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    own = spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    single = spark.range(10, 2010).select("id", F.concat(F.lit("single "), "id").alias("text"))
    everything = same.union(own).union(single)
    got = toxicity.sampled(everything, spark.range(1, 3).withColumnRenamed("id", "doc_id"), 300, 500).collect()
    assert {t: len({r.text for r in got if r.toxic == t}) for t in (0, 1)} == {0: 500, 1: 300} and len(got) == 800
    got = toxicity.sampled(same, spark.range(2).withColumnRenamed("id", "doc_id"), 500, 500).collect()
    assert sorted((r.toxic, r.text) for r in got) == [(0, "the same text"), (1, "the same text")]
    docs = same.union(single).withColumn("lang", F.lit("en"))
    model = language_id.learn(docs, 50)
    assert model.languages == ["en"] and language_id.learn(docs.limit(0)) is None


def test_results_do_not_depend_on_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(60)).union(docs.where("doc_id % 3 = 0"))
    for made in (lambda d: sharding.shard(d), lambda d: packing.pack(d, queries.ranks_path(), 4, 2048)):
        results = [sorted(map(tuple, made(docs.repartition(n)).collect()), key=repr) for n in (1, 3, 7)]
        assert results[0] == results[1] == results[2]


def cut_edges(rows, shards):
    """Pairs of equal texts on different shards, for labels of rows in order."""
    by = {}
    for (_, t), s in zip(rows, shards, strict=True):
        by.setdefault(t, []).append(s)
    return sum(len(x) * (len(x) - 1) // 2 - sum(x.count(s) * (x.count(s) - 1) // 2 for s in set(x)) for x in by.values())


def plain_propagation(rows, shards, rounds=8):
    """Label propagation in plain Python: one hub at a time moves to its commonest shard with room."""
    quota = -(-len(rows) // shards)
    label = [zlib.crc32(f"{i}".encode()) % shards for i in range(len(rows))]
    loads, by = [label.count(s) for s in range(shards)], {}
    for i, (_, t) in enumerate(rows):
        by.setdefault(t, []).append(i)
    for _ in range(rounds):
        for members in by.values():
            for s in sorted(range(shards), key=lambda s: -sum(label[i] == s for i in members)):
                if loads[s] + sum(label[i] != s for i in members) <= quota * 1.25:
                    for i in members:
                        loads[label[i]] -= 1
                        loads[s] += 1
                        label[i] = s
                    break
    return label


def test_sharding_cuts_no_more_than_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"group {g}") for i, g in enumerate(rng.zipf(1.6, 900) % 200)]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    start = [zlib.crc32(f"{i}".encode()) % 8 for i in range(len(rows))]
    mine, plain = cut_edges(rows, [got[i] for i, _ in rows]), cut_edges(rows, plain_propagation(rows, 8))
    assert mine <= plain < cut_edges(rows, start)


def test_packing_counts_long_texts_exactly(spark):
    rows = [(1, "a b " * 50_000), (2, "a b " * 50_000 + "c"), (3, "x"), (4, None)]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.ranks_path(), buckets=4).collect()}
    assert got[1].n_tokens > 65_536 and all(r.padding == 0 for r in got.values())



def padding(lengths, counts, cuts):
    return sum((min(c for c in cuts if c >= x) - x) * k for x, k in zip(lengths, counts, strict=True))


def test_boundaries_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        d = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(60, d, replace=False)).astype(np.int64)
        counts = rng.integers(1, 20, d).astype(np.int64)
        for k in range(1, 5):
            cuts = packing.boundaries(lengths, counts, k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in combinations(lengths[:-1].tolist(), min(m, d - 1)))
            assert len(cuts) <= k and cuts[-1] == lengths[-1] and padding(lengths, counts, cuts) == best
    assert packing.boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_packing_of_awkward_rows(docs, rows, none):
    got = packing.pack(docs, queries.ranks_path(), buckets=3, budget=64).collect()
    assert len(got) == len(rows) and all(r.padding >= 0 for r in got)
    held = {}
    for r in got:
        held.setdefault((r.bucket, r.batch), []).append(r)
    for members in held.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_tokens <= 64
    assert packing.pack(none, queries.ranks_path()).count() == 0


def test_sharding_is_even_and_keeps_groups(spark, docs, rows, none):
    got = sharding.shard(docs, 4).collect()
    counts = np.bincount([r.shard for r in got], minlength=4)
    assert len(got) == len(rows) and counts.max() - counts.min() <= 1
    assert sharding.shard(none).count() == 0
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        if r.doc_id:
            assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())


def test_sharding_on_groups(spark):
    rows = [(i, f"single {i}") for i in range(600)] + [(1000 + 10 * g + j, f"group {g}") for g in range(60) for j in range(4)] + [(5000 + i, "hot") for i in range(420)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16)
    text = dict(rows)
    shards, slots = {}, {}
    for r in got.collect():
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in slots.values()]
    assert len(slots) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("group")) == 0


def test_hubs_ranked_in_pieces_lose_no_row(spark):
    """A third of all rows are copies; hubs above ten rows are ranked in pieces, with the same sizes in any layout."""
    rows = [(i, f"single {i}") for i in range(500)] + [(1000 + i, "hot") for i in range(400)] + [(2000 + i, f"warm {i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(k), 16, most=10).collect()) for k in (1, 5)]
    assert found[0] == found[1] and [d for d, _, _ in found[0]] == [d for d, _ in rows]
    for s in range(16):
        slots = sorted(slot for _, shard, slot in found[0] if shard == s)
        assert slots == list(range(75))


def test_pieces_keep_the_order_of_cells(spark):
    """Hubs stay together through pieces, so a quota cuts few of them."""
    rows = [(f"h{h}".encode(), 100 * h + i, 0) for h in range(12) for i in range(40)]
    state = spark.createDataFrame([(*r, r[1]) for r in rows], "hub binary, key long, shard int, node long")
    kept = sharding._fitted(state, [240], len(rows), most=8).groupBy("hub").count().collect()
    assert sum(r["count"] for r in kept) == 240
    assert sum(r["count"] == 40 for r in kept) >= 4


def test_sharding_when_all_are_linked(spark):
    rows = [(10 * g + j, f"group {g}") for g in range(50) for j in range(5)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert counts.max() - counts.min() <= 1 and len(got) == 250
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id // 10, set()).add(r.shard)
    assert sum(len(s) == 1 for s in shards.values()) >= 30


def brute_rule(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = ["http://A.Example.com/en/7?x#y", "https://com/en/", "ftp://notcom/en/", "https://x.net/de/?q", "http://example.net/de/81", None, "", "no scheme", "a://b://c/d", "http://x.org?/es/", "http://x.org/es/#", "http://h\n.com/en/\n?", "http://ÀB.com/fr/" + "long/" * 3000]


def test_url_rules_by_definition(spark, small):
    urls = URLS + [r.url for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    frame = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.judge(frame).collect():
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert url_filter.judge(frame.limit(0)).count() == 0


def brute_gains(labelled, order):
    """Witten-Bell probabilities by recursion over plain counts."""
    counts = {}
    for text, good in labelled:
        for k in range(1, order + 2):
            for i in range(len(text) - k + 1):
                counts.setdefault(text[i : i + k], [0, 0])[0 if good else 1] += 1

    def prob(seq, m):
        if not seq:
            return 1 / url_filter.ALPHABET
        same = [v[m] for s, v in counts.items() if len(s) == len(seq) and s[:-1] == seq[:-1]]
        novel = max(1, sum(v > 0 for v in same))
        return (counts[seq][m] + novel * prob(seq[1:], m)) / (sum(same) + novel)

    ratio = lambda s: np.log(prob(s, 0) / prob(s, 1))
    return {s: ratio(s) - (ratio(s[1:]) if s else 0) for s in counts}


def test_character_models_against_recursion(spark):
    urls = ["http://example.com/en/71", "http://example.com/en/12", "http://a.net/de/5", "http://b.org/es/a"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.ruled(frame)
    got = {r.seq: r.gain / url_filter.PARTS for r in url_filter.train(rows, 2).collect()}
    want = brute_gains([(r.text, r.said == "allow") for r in rows.collect()], 2)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-5 for s in got)


def test_all_sequences_are_kept(spark):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x5E00, 40))) for _ in range(400)]
    frame = spark.createDataFrame([(i, f"http://a.{('org/es/', 'net/de/')[i % 2]}{w}") for i, w in enumerate(words)], "page_id long, url string")
    rows = url_filter.ruled(frame)
    texts = [r.text for r in rows.collect()]
    want = {t[i : i + k] for t in texts for k in range(1, url_filter.ORDER + 2) for i in range(len(t) - k + 1)}
    got = {r.seq for r in url_filter.train(rows).collect()}
    assert len(want) > 50_000 and got == want


def test_scores_against_recursion(spark):
    ruled = ["http://example.com/en/71", "http://example.com/en/12", "http://a.net/de/5", "http://b.org/es/a"] + ["http://c.com/en/eee"] * 9
    urls = [*ruled, "http://x.net/fr/zz", "http://example.com/eq/", "ftp://\u00e9\u00e9e/en/5?x", "none", "", "http://c.com/enx"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.rt.materialise(url_filter.ruled(frame), "urls")
    texts = {r.page_id: r.text for r in rows.collect()}
    counts = {}
    for r in rows.where("said is not null").collect():
        for k in range(1, url_filter.ORDER + 2):
            for i in range(len(r.text) - k + 1):
                counts.setdefault(r.text[i : i + k], [0, 0])[r.said != "allow"] += 1

    def prob(seq, m):
        if not seq:
            return 1 / url_filter.ALPHABET
        same = [v[m] for s, v in counts.items() if len(s) == len(seq) and s[:-1] == seq[:-1]]
        if not same:
            return prob(seq[1:], m)
        novel = max(1, sum(v > 0 for v in same))
        return (counts.get(seq, [0, 0])[m] + novel * prob(seq[1:], m)) / (sum(same) + novel)

    for r in url_filter.scored(rows, url_filter.model(rows)).collect():
        text = texts[r.page_id]
        parts = [text[max(0, i - url_filter.ORDER) : i + 1] for i in range(len(text))]
        want = sum(np.log(prob(s, 0) / prob(s, 1)) for s in parts) / len(text)
        assert abs(r.score - want) < 1e-4, text
