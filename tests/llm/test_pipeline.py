import hashlib

import duckdb
import numpy as np
from test_similar import brute_heads
from test_text import brute_measure

import corpus_pipeline
from driftloom.llm import bpe, quality, queries, secret_scan


def test_stages_against_brute_force(spark, small):
    """Each stage on what plain Python says of its input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    good = corpus_pipeline.quality_rules(spark, docs, small)
    kept = {r.doc_id: r.text or "" for r in good.collect()}
    measures = {i: brute_measure(t) for i, t in rows.items()}
    failed = {i for i, m in measures.items() if m[0] < 20 or 100 * m[4] > 30 * m[0]}
    assert not failed & kept.keys() and good.columns == docs.columns
    assert {r.doc_id for r in quality.judge(docs).where("kept").collect()} == kept.keys()

    single = corpus_pipeline.exact_copies(spark, good, small)
    firsts = {}
    for i, t in kept.items():
        digest = hashlib.sha256(t.translate(dict.fromkeys(map(ord, " \t\n\v\f\r"))).encode()).digest()
        firsts[digest] = min(firsts.get(digest, (0, i)), (-len(t), i))
    left = {r.doc_id: r.text or "" for r in single.collect()}
    assert left.keys() == {i for _, i in firsts.values()}

    far = corpus_pipeline.near_copies(spark, single, small)
    order = sorted(left)
    heads = {order[k] for k in brute_heads([left[i] for i in order])}
    assert {r.doc_id for r in far.collect()} == heads

    masked = corpus_pipeline.secrets(spark, far, small)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == docs.columns and texts.keys() == heads
    assert not any(secret_scan.base_spans(t) for t in texts.values())
    assert all(texts[i] == rows[i] for i in heads if not secret_scan.find(rows[i])[1])

    made = bpe.tokenizer(queries.ranks_path(), __import__("public_tokenizers").PATTERN)
    batches = corpus_pipeline.batches(spark, masked, small).collect()
    assert {(r.doc_id, r.n_tokens) for r in batches} == {(i, len(made.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {(r.doc_id, r.n_tokens, r.bucket, r.batch, r.slot) for r in corpus_pipeline.run(spark, small).collect()} == {(r.doc_id, r.n_tokens, r.bucket, r.batch, r.slot) for r in batches}


def test_stages_hand_on_clashing_columns(spark):
    """Every stage keeps columns named like the engine's own, whatever their values and kinds."""
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choice(words, 60)) + "." for _ in range(6)]
    names = ["__dl_uid", "__DL_uid_", "__dl_metrics", "__dl_text", "__dl_head", "__dl_rank", "node", "key", "a`b", "c.d"]
    kinds = ", ".join(f"`{n.replace('`', '``')}` {'string' if n.startswith('__') else 'long'}" for n in names)
    rows = [(i, t, *("same" if n.startswith("__") else 7 for n in names)) for i, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {kinds}").repartition(3)
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", *names] and all(tuple(r) == want[r.doc_id] for r in got)
    assert sorted(r.doc_id for r in got) == list(range(6))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 6


def test_sql_of_queries(spark, small):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, small)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda t: sorted((tuple(r) for r in t), key=repr)
        mine = rows(got.select(*columns).collect())
        theirs = rows(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall())
        assert mine == theirs, name
