import numpy as np

import corpus_pipeline
from driftloom.llm import similar as S


def changed(rng, words, times):
    out = list(words)
    for at in rng.choice(len(out), times, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def brute_heads(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if root[i] == i}


def test_stage_keeps_what_brute_force_keeps(spark):
    """Short texts with few changed words, a chain, and a group too large for one pair at a time."""
    rng = np.random.default_rng(3)
    texts = []
    for n in (30, 60, 120, 400):
        for _ in range(12):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts += [" ".join(base)] + [" ".join(changed(rng, base, k)) for k in (1, max(1, n // 100), max(2, n // 45))]
    base = [f"g{x}" for x in range(200)]
    texts += [" ".join(changed(rng, base, 1)) for _ in range(60)]
    chain = [f"c{x}" for x in range(100)]
    for step in range(12):
        texts.append(" ".join(chain))
        chain[step * 8] = f"d{step}"
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, "").collect()}
    assert got == brute_heads(texts)


def test_blocks_of_one_cell_lose_no_link(spark):
    """With a single cell for all, cut into blocks, every pair that matters is still compared."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(15):
        base = [f"w{x}" for x in rng.integers(0, 5000, 50)]
        texts += [" ".join(base), " ".join(changed(rng, base, 1))]
    rows = spark.createDataFrame(list(enumerate(texts)), "__dl_uid long, text string")
    distinct = spark.createDataFrame([(i, 46, [7], i) for i in range(len(texts))], "node long, size long, cells array<long>, uid long")
    S.rt.prepare(spark)
    for limits in ({}, {"block": 8}, {"block_bytes": 4096}):
        edges = S.link_edges(distinct, rows, 5, 0.8, **limits)
        assert {tuple(sorted(e)) for e in edges.collect()} == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_counts_are_a_lower_bound_and_forests_span():
    rng = np.random.default_rng(7)
    sets = []
    for n in (1, 3, 9, 20, 200):
        base = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        for k in range(12):
            part = base.copy()
            part[: min(n, k)] = rng.integers(0, 1 << 63, min(n, k), np.uint64)
            sets.append(np.unique(part))
    sets.append(np.zeros(0, np.uint64))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            away = len(sets[i]) + len(sets[j]) - 2 * both
            assert np.abs(S.embed(sets[i]) - S.embed(sets[j])).sum() <= away
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    edges = S.forest(sets)
    assert links > len(edges) == len(sets) - len({find(i) for i in range(len(sets))})
    assert all(find(a) == find(b) for a, b in edges)


def test_awkward_rows(spark, docs, none):
    left = S.drop_near_copies(docs)
    assert left.columns == docs.columns and S.drop_near_copies(none).count() == 0
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 10, 11, 3, 4, 7, 9]


def planted(rng, shared, only, other):
    """Two sets of random hashes with so many in common."""
    made = rng.integers(0, 1 << 63, shared + only + other, np.uint64) * np.uint64(2) + rng.integers(0, 2, shared + only + other, np.uint64)
    return made[: shared + only], np.concatenate([made[:shared], made[shared + only :]])


def test_fingerprint_by_definition():
    found, _ = planted(np.random.default_rng(8), 300, 0, 0)
    for n in (0, 1, 4, 300):
        want = []
        for times, plus in zip(S._TIMES[:, 0].tolist(), S._PLUS[:, 0].tolist(), strict=True):
            ones = [0] * 64
            for x in found[:n].tolist():
                x = (x * times + plus) % (1 << 64)
                x ^= x >> 32
                x = x * 0x9E3779B97F4A7C15 % (1 << 64)
                x ^= x >> 29
                ones = [c + (x >> b & 1) for b, c in enumerate(ones)]
            want.append(sum(1 << b for b, c in enumerate(ones) if 2 * c > n))
        assert S.fingerprint(found[:n]).tolist() == want


def test_pairs_at_the_least_similarity_meet_in_the_popcount_grid():
    """Pairs at 0.8 share a cell and pass the Hamming check; strangers pass it never."""
    rng = np.random.default_rng(9)
    for shared, only, other in ((4, 0, 1), (8, 0, 2), (16, 2, 2), (40, 5, 5), (160, 0, 40), (800, 100, 100)):
        lost = 0
        for _ in range(200):
            pair = planted(rng, shared, only, other)
            prints, sizes = np.stack([S.fingerprint(x) for x in pair]), np.array([len(x) for x in pair])
            tables = np.arange(S.TABLES * (3 if sizes.max() <= S.FEW else 1))
            met = S.cells(prints, sizes, tables)
            lost += not ((met[0] == met[1]).any() and S._away(prints[0, : S.HEAD], prints[1, : S.HEAD]) <= S.BITS)
        assert lost == 0
    far = np.stack([S.fingerprint(planted(rng, 100, 0, 0)[0]) for _ in range(200)])[:, : S.HEAD]
    assert S.close_heads(far) == []


def test_candidates_span_the_links_of_all_cells(spark):
    """Also where cells are cut into blocks and where parts are not held whole."""
    rng = np.random.default_rng(10)
    sets = [x for _ in range(8) for x in planted(rng, 90, 5, 5)]
    base, _ = planted(rng, 60, 0, 0)
    sets += [np.concatenate([base, planted(rng, 2, 0, 0)[0]]) for _ in range(30)]
    prints = [S.fingerprint(x) for x in sets]
    names = [int(x[:1].view(np.int64)[0]) for x in prints]
    S.rt.prepare(spark)
    frame = spark.createDataFrame([(bytearray(x.tobytes()), len(s)) for x, s in zip(prints, sets, strict=True)], "print binary, size long")
    for limits in ({}, {"block": 7}, {"limit": 20}):
        group = {x: {x} for x in names}
        edges = S.candidate_edges(frame, len(sets), **limits).collect()
        assert len(edges) < 2 * len(sets)
        for a, b in edges:
            both = group[a] | group[b]
            group |= dict.fromkeys(both, both)
        want = [*(names[i // 2 * 2 :][:2] for i in range(16)), *[names[16:]] * 30]
        assert [group[x] for x in names] == [set(x) for x in want]


def test_tables_do_not_join_a_group_anew(spark, monkeypatch):
    """Rows handed on grow with the members, not with members times tables, and no link is lost."""
    rng = np.random.default_rng(11)
    base, _ = planted(rng, 200, 0, 0)
    sets = [np.concatenate([base, planted(rng, 15, 0, 0)[0]]) for _ in range(120)] + [planted(rng, 200, 0, 0)[0] for _ in range(40)]
    prints = [S.fingerprint(x) for x in sets]
    names = [int(x[:1].view(np.int64)[0]) for x in prints]
    S.rt.prepare(spark)
    frame = spark.createDataFrame([(bytearray(x.tobytes()), len(s)) for x, s in zip(prints, sets, strict=True)], "print binary, size long")
    write, made = S.rt.materialise, []

    def counted(df, tag):
        out = write(df, tag)
        if tag in ("close", "pieces"):
            made.append(out.count())
        return out

    monkeypatch.setattr(S.rt, "materialise", counted)
    edges = S.candidate_edges(frame, len(sets)).collect()
    group = set(names[:120])
    assert len(edges) == len(group) - 1 > 100 and {x for e in edges for x in e} == group
    assert sum(made) < 12 * 120


def test_members_of_known_components_are_joined_from_the_start():
    """Only links between roots are given, whatever the size of the cell, and some leads tell what they join."""
    rng = np.random.default_rng(12)
    base, _ = planted(rng, 200, 0, 0)
    near = [S.fingerprint(np.concatenate([base, planted(rng, 4, 0, 0)[0]])) for _ in range(20)]
    heads = np.stack([*near, *(S.fingerprint(planted(rng, 200, 0, 0)[0]) for _ in range(5))])[:, : S.HEAD]
    roots = np.r_[np.full(10, 3), np.full(10, 5), 6, 6, 7, 8, 9]
    for n in (25, 24):
        assert [sorted(roots[[a, b]].tolist()) for a, b in S.close_heads(heads[:n], roots[:n])] == [[3, 5]]
    edges, after = S._grow(heads, np.arange(25), 1)
    assert {b for _, b in edges} == set(range(1, 20)) and after.tolist() == [0] * 20 + list(range(20, 25))
    keys = np.repeat(np.arange(5), 5)
    a, b = S.close_in_cells(keys, heads, roots)
    assert not len(a) and not len(b)
    a, b = S.close_in_cells(keys[:8] * 0, heads[6:14], roots[6:14])
    assert len(a) and set(zip(roots[6:14][a].tolist(), roots[6:14][b].tolist(), strict=True)) == {(3, 5)}


def test_blocks_of_cells_that_leads_do_not_join(spark):
    """One comparison first, then pairs of blocks: a chain, a group and strangers in cells above the block."""
    rng = np.random.default_rng(13)
    base, _ = planted(rng, 60, 0, 0)
    sets = [np.concatenate([base, planted(rng, 2, 0, 0)[0]]) for _ in range(30)]
    chain, more = planted(rng, 100, 0, 60)[0], planted(rng, 60, 0, 0)[0]
    sets += [np.concatenate([chain[4 * k :], more[: 4 * k]]) for k in range(15)]
    sets += [planted(rng, 62, 0, 0)[0] for _ in range(20)]
    prints = [S.fingerprint(x) for x in sets]
    names = [int(x[:1].view(np.int64)[0]) for x in prints]
    S.rt.prepare(spark)
    frame = spark.createDataFrame([(bytearray(x.tobytes()), len(s)) for x, s in zip(prints, sets, strict=True)], "print binary, size long")
    for limits in ({"block": 2, "leads": 1}, {"block": 7, "leads": 0}, {"block": 3}):
        group = {x: {x} for x in names}
        for a, b in S.candidate_edges(frame, len(sets), **limits).collect():
            both = group[a] | group[b]
            group |= dict.fromkeys(both, both)
        assert [group[x] for x in names] == [*[set(names[:30])] * 30, *[set(names[30:45])] * 15, *({x} for x in names[45:])]
