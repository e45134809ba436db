import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelume.llm import exact, simhash, textkit
from tests.llm.corpus import ODD, edited, frame, prose, random_rng, vocabulary


def near_corpus(groups=25, alone=150):
    rng = random_rng(3)
    words = vocabulary(rng, 1500)
    rows, planted = [], []
    for g in range(groups):
        base = prose(rng, words, rng.randint(60, 400))
        ids = []
        for _ in range(rng.randint(2, 5)):
            ids.append(len(rows))
            rows.append((len(rows), edited(rng, words, base, 0.03) if ids[1:] or g % 2 else base, "en", "s"))
        planted.append(ids)
    for _ in range(alone):
        rows.append((len(rows), prose(rng, words, rng.randint(20, 400)), "en", "s"))
    return rows, planted


# --- exact ----------------------------------------------------------------


def test_perfect_hash_is_minimal_and_checked():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint64).reshape(-1, 4)
    slot, sizes, flat = exact.build(digests)
    assert sorted(slot) == list(range(3000))
    assert (exact.lookup(digests, sizes, flat) == slot).all()
    others = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)), np.uint64).reshape(-1, 4)
    got = exact.lookup(others, sizes, flat)
    kept = np.empty_like(digests)
    kept[slot] = digests
    assert not (kept[got[got >= 0]] == others[got >= 0]).all(axis=1).any()
    assert exact.build(digests[:0])[1] == []


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_matches_brute_force(spark, share):
    rng = random_rng(5)
    rows = [(i, f"text {rng.randint(0, 60)}", "en", "s") for i in range(200)] + ODD
    got = exact.exact_duplicates(frame(spark, rows, clash=True), share).collect()
    least = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            least[t] = min(i, least.get(t, i))
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.winner_doc_id) for r in got if r.doc_id is not None) == sorted((i, i if t is None else least[t]) for i, t, *_ in rows if i is not None)
    assert sum(r.keep for r in got) == len({t for _, t, *_ in rows if t is not None}) + sum(t is None for _, t, *_ in rows)


def test_exact_drop_keeps_rows_as_they_are(spark):
    rows = [(1, "a", "en", "s"), (1, "a", "en", "s"), (2, "a", "de", "t"), (3, None, None, None), (4, None, None, None), (None, "b", "en", "s"), (7, "b", "en", "s")]
    df = frame(spark, rows, clash=True)
    out = exact.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 7]


def test_exact_empty(spark):
    df = frame(spark, [])
    assert exact.exact_duplicates(df).count() == 0
    assert exact.drop_exact_duplicates(df).columns == df.columns


# --- near -----------------------------------------------------------------


def test_golay_segments_within_two_bits_share_an_index():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 2000)
    a, n = simhash.golay_indices(v)
    assert set(np.unique(n)) <= {1, 6, 7}
    for _ in range(60):
        i, j = rng.integers(0, 23, 2)
        b, _ = simhash.golay_indices(v ^ (1 << i) ^ (1 << j if i != j else 0))
        assert ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any((1, 2)).all()


def test_link_finds_every_pair_of_small_and_large_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    for dense in (4, 1000):
        monkeypatch.setattr(simhash, "DENSE", dense)
        base = rng.integers(-(1 << 62), 1 << 62, (6, 2))
        check = base[rng.integers(0, 6, 120)] ^ (1 << rng.integers(0, 62, (120, 1)))
        node, key = np.arange(120) * 10, rng.integers(0, 3, 120)
        a, b = simhash.link(key, node, check, np.arange(120), 5)
        up = {int(x): int(x) for x in node}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in zip(a, b):
            up[root(int(x))] = root(int(y))
        exp = {int(x): int(x) for x in node}

        def eroot(x):
            while exp[x] != x:
                x = exp[x]
            return x

        for i in range(120):
            for j in range(i):
                if key[i] == key[j] and np.bitwise_count((check[i] ^ check[j]).view(np.uint64)).sum() <= 5:
                    exp[eroot(int(node[i]))] = eroot(int(node[j]))
        same = lambda f: {(i, j) for i in range(120) for j in range(i) if f(int(node[i])) == f(int(node[j]))}
        assert same(root) == same(eroot)


def test_near_duplicates_are_found_and_others_left(spark):
    rows, planted = near_corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows, clash=True)).collect()}
    found = sum(len({got[i].keeper_doc_id for i in ids}) == 1 for ids in planted)
    assert found >= 0.9 * len(planted)
    grouped = {i for ids in planted for i in ids}
    assert all(r.keep and r.keeper_doc_id == i for i, r in got.items() if i not in grouped)
    for r in got.values():
        assert got[r.keeper_doc_id].keep and r.keep == (r.keeper_doc_id == r.doc_id)


def test_near_search_recall_against_brute_force(spark):
    rows, _ = near_corpus(60, 300)
    df = frame(spark, rows)
    means = simhash.language_means(df)
    seg, chk, n = simhash.fingerprint(pa.array([r[1] for r in rows]), means)
    bits = sum(np.bitwise_count(seg[:, None, i] ^ seg[None, :, i]) for i in range(4)).astype(int)
    dist = np.bitwise_count((chk[:, None, :] ^ chk[None, :, :]).view(np.uint64)).sum(2)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if dist[i, j] <= simhash.MAX_DISTANCE and n[i] >= simhash.MIN_WORDS]
    idx = [simhash.golay_indices(seg[:, k])[0] for k in range(4)]
    share = sum(((x[:, :, None, None] == x.T[None, None, :, :].transpose(0, 1, 3, 2)) & (x >= 0)[:, :, None, None]).any((1, 3)).astype(int) for x in idx)
    assert all(share[i, j] >= 2 for i, j in pairs if bits[i, j] <= 8)
    assert np.mean([share[i, j] >= 2 for i, j in pairs]) >= 0.9
    got = {r.doc_id: r.keeper_doc_id for r in simhash.near_duplicates(df).collect()}
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9


def test_near_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    assert sum(r.keep for r in got) == len(ODD) - 2
    assert all(r.keeper_doc_id == 903 for r in got if r.doc_id in (903, 904))
    assert all(r.keep for r in got if r.doc_id in (None, 900, 901, 902, 905, 906))
    out = simhash.drop_near_duplicates(frame(spark, ODD, clash=True))
    assert out.count() == len(ODD) - 2 and out.columns == frame(spark, ODD, clash=True).columns


def test_near_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(1, None, None, None)])).collect()[0].keep


def test_components_match_union_find(spark):
    from pagelume.llm.graph import components

    rng = random_rng(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for a, b in edges:
        if a != b:
            groups[root(a)] |= {a, b}
    assert got == {x: min(g) for g in groups.values() for x in g}


# --- words ----------------------------------------------------------------


def test_words_and_shingles_match_plain_python():
    import re

    texts = ["Hello, World foo_1", "", None, "foo hello", "a-b c", "é É x", "  tail "]
    seen = {}
    for _, h, off, size in textkit.words(pa.array(texts), chunk_bytes=8):
        for r in range(len(off) - 1):
            seen[len(seen)] = h[off[r] : off[r + 1]].tolist()
        assert len(size) == len(h)
    names = {}
    for i, t in enumerate(texts):
        plain = re.findall(r"\w+", (t or "").lower())
        assert len(plain) == len(seen[i])
        for w, x in zip(plain, seen[i]):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    for _, h, off, _ in textkit.words(pa.array(["a b c d", "a b", "b c d", ""])):
        g, goff = textkit.shingles(h, off, 3)
        assert np.diff(goff).tolist() == [2, 1, 1, 0] and g[1] == g[3]


def test_bit_votes_match_plain_sums():
    h = np.random.default_rng(2).integers(0, 1 << 63, 900).astype(np.uint64)
    off = np.array([0, 0, 600, 601, 900, 900])
    got = textkit.bit_votes(h, off, 20)
    bits = np.unpackbits(textkit.mix64(h + np.uint64(0x51ED270B)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :20].astype(int)
    assert (got == [(2 * bits[a:b] - 1).sum(0) for a, b in zip(off[:-1], off[1:])]).all()
    w = np.random.default_rng(3).integers(1, 9, 900).astype(np.uint64)
    got = textkit.bit_votes(h, off, 20, w, 8)
    assert (got == [((2 * bits[a:b] - 1) * w[a:b, None].astype(int)).sum(0) for a, b in zip(off[:-1], off[1:])]).all()


def test_sum_of_votes_spreads_over_partitions(spark):
    rows, _ = near_corpus(2, 30)
    df = frame(spark, rows)
    a, b = simhash.language_means(df), simhash.language_means(df.repartition(3, F.col("doc_id")))
    assert np.allclose(a, b)
