import hashlib
import re

import numpy as np
import pytest

from driftloom.llm import exact_dedup as X
from driftloom.llm import simhash as S
from driftloom.llm.graph import components


def keys_of(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**64, (n, 4), np.uint64)


def test_cuckoo_insert_find_delete_resize():
    index, keys = X.CuckooIndex(16), keys_of(5000)
    for at in range(0, 5000, 700):
        index.insert(keys[at : at + 700])
    assert index.resizes > 0 and len(index) == 5000
    slot, ref, _ = index.find(keys)
    assert (slot >= 0).all() and (index.keys[ref] == keys).all()
    assert (index.find(keys_of(5000, 1))[0] < 0).all()
    assert index.delete(keys[:2500]).all() and not index.delete(keys[:2500]).any()
    assert (index.find(keys[:2500])[0] < 0).all() and (index.find(keys[2500:])[0] >= 0).all()
    index.insert(keys[:100])
    assert len(index) == 2600 and (index.find(keys[:100])[0] >= 0).all()


def test_filter_hit_is_verified_against_the_stored_key():
    index = X.CuckooIndex()
    key = keys_of(1)
    twin = key.copy()
    twin[0, 3] ^= np.uint64(1)  # same bucket and tag, other content
    index.insert(key)
    slot, _, refuted = index.find(twin)
    assert slot[0] == -1 and refuted >= 1


def brute_exact(rows):
    groups = {}
    for n, (i, t, *_) in enumerate(rows):
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for key, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            out.append((None if m[1] else m[2], keep, len(members), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_against_brute_force(docs, rows, none):
    got = X.mark_copies(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(rows)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert X.mark_copies(none).count() == 0


def test_drop_copies_keeps_columns_and_one_row_each(docs, none):
    left = X.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == X.mark_copies(docs).where("kept").count()
    assert X.drop_copies(none).count() == 0


def test_exact_on_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = X.mark_copies(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(rows)


def test_live_index(spark, docs):
    one = docs.where("doc_id in (1, 7, 8)")
    index = X.LiveIndex(spark).insert(one)
    known = {r.doc_id: r.known for r in index.probe(docs.where("doc_id is not null")).collect()}
    assert known[1] and known[2] and known[3] and known[7] and not known[9] and not known[4]
    index.delete(docs.where("doc_id = 8"))
    assert {r.known for r in index.probe(docs.where("doc_id = 7")).collect()} == {True}
    index.delete(docs.where("doc_id in (1, 7)"))
    assert not index.probe(docs).where("known").count()


def test_fingerprint_by_definition():
    import xxhash

    text = "A b  c\nd E f".encode()
    words = ["a", "b", "c", "d", "e", "f"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    got = S.fingerprints([text, b"", b"x y", b" "])
    assert got[0] == want and got[1] == got[3] == 0 and got[2] == xxhash.xxh64_intdigest("x y", 42)


def near(rng, n):
    """Fingerprints in clusters, at distances around the bound."""
    seeds = rng.integers(0, 2**64, n // 8, np.uint64)
    out = np.repeat(seeds, 8)
    for i in range(len(out)):
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            out[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(out)


def test_embedding_is_a_lower_bound_and_cells_miss_no_link():
    prints = near(np.random.default_rng(3), 400)
    packed = S.embed(prints)
    counts = np.stack([(packed >> np.uint64(i)) & np.uint64(3) for i in range(0, 64, 2)], 1).astype(int)
    assert (counts.sum(1) == np.bitwise_count(prints)).all()
    keys, owners = S.cells(prints)
    assert len(np.unique(keys)) > len(prints) and len(set(zip(keys.tolist(), owners.tolist(), strict=True))) == len(keys)
    held = {}
    for k, o in zip(keys.tolist(), owners.tolist(), strict=True):
        held.setdefault(k, set()).add(o)
    together = {(a, b) for x in held.values() for a in x for b in x if a < b}
    for a in range(len(prints)):
        far = np.bitwise_count(prints[a] ^ prints[a + 1 :])
        assert (np.abs(counts[a] - counts[a + 1 :]).sum(1) <= far).all()
        for b in np.flatnonzero(far <= S.MAX_BITS) + a + 1:
            assert (a, int(b)) in together


def brute_components(prints):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(prints[a] ^ prints[a + 1 :]) <= S.MAX_BITS) + a + 1:
            x, y = find(a), find(int(b))
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_components_of_links_against_brute_force(spark, block):
    prints = near(np.random.default_rng(5), 600)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(S.link_edges(frame, len(prints), block)).collect()}
    want = brute_components(prints)
    signed = prints.view(np.int64).tolist()
    mine = [roots.get(x, x) for x in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_large_cells_are_handed_on_whole():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(np.repeat(rng.permutation(40), rng.integers(1, 60, 40))).astype(np.int64)
    prints = np.arange(len(keys), dtype=np.int64)
    cut = [pa.record_batch([pa.array(keys[a : a + 13]), pa.array(prints[a : a + 13])], names=["cell", "fp"]) for a in range(0, len(keys), 13)]
    rows = pa.Table.from_batches(list(S._links(iter(cut), 20))).to_pylist()
    given = [(r["cell"], r["a"]) for r in rows if r["cell"] is not None]
    large = {k for k in keys.tolist() if (keys == k).sum() > 20}
    assert sorted(given) == [(k, p) for k, p in zip(keys.tolist(), prints.tolist(), strict=True) if k in large] and large
    for r in rows:
        if r["cell"] is None:
            assert keys[r["a"]] == keys[r["b"]] and keys[r["a"]] not in large


def test_long_cells_use_the_forest():
    rng = np.random.default_rng(9)
    base = np.uint64(rng.integers(0, 2**63))
    prints = np.unique([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(32, 64) for b in range(32, 64)])
    edges = S.forest(prints)
    assert len(edges) == len(prints) - 1
    a, b = S.links_in_cells(np.zeros(len(prints), np.int64), prints)
    assert len(a) == len(prints) - 1 and (np.bitwise_count(a ^ b) <= S.MAX_BITS).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == 100 and len(roots) == 43


def test_near_copies_of_awkward_rows(docs, rows, none):
    got = S.near_copies(docs).collect()
    assert len(got) == len(rows)
    empty = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert empty == {4}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert S.near_copies(none).count() == 0


def test_near_copies_on_table(spark, small):
    got = S.near_copies(spark.read.parquet(f"{small}/documents.parquet")).collect()
    prints = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
    want, first = brute_components(prints), {}
    for r, w in zip(got, want, strict=True):
        first[w] = min(first.get(w, r.doc_id), r.doc_id)
    assert all(r.component_id == first[w] for r, w in zip(got, want, strict=True))


def test_a_third_of_all_rows_in_one_group(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    base = " ".join(rng.choice(words, 300))
    near = [" ".join([*base.split(), *rng.choice(words, 1)]) for _ in range(300)]
    rows = [(i, base + " " * (i % 3)) for i in range(2000)] + [(5000 + i, t) for i, t in enumerate(near)] + [(9000 + i, " ".join(rng.choice(words, 50))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = {r.doc_id: r for r in X.mark_copies(docs).collect()}
    assert len(got) == len(rows) and all(got[i].group_size == 2000 and got[i].keep_id == 2 for i in range(2000)) and sum(got[i].kept for i in range(2000)) == 1
    found = S.near_copies(docs).collect()
    prints = np.array([int(r.fingerprint, 16) for r in found], np.uint64)
    distinct, where = np.unique(prints, return_inverse=True)
    label = np.array(brute_components(distinct))[where]
    first = {}
    for r, c in zip(found, label, strict=True):
        first[c] = min(first.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == first[c] for r, c in zip(found, label, strict=True))


def test_ranks_are_gapless(spark):
    from pyspark.sql import functions as F

    from driftloom.llm import runtime as rt

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"))
    got = rt.ranked(rows, ["g"], [F.col("id")], 5000, "at").groupBy("g").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()
    assert all(r["at"] == list(range(len(r["at"]))) for r in got) and sum(len(r["at"]) for r in got) == 5000
    whole = rt.ranked(rows, [], [F.col("id")], 5000, "at").select("at").collect()
    assert sorted(r["at"] for r in whole) == list(range(5000))
