"""Whole results of op1, op10 and the pipeline against brute force on small corpora."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pagelume.llm import mixing, packing, quality, simhash
from tests.llm.corpus import ODD, edited, frame, prose, random_rng, vocabulary
from tests.llm.test_packing_and_pipeline import check_windows
from tests.llm.test_text_ops import with_duckdb


def groups_of(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_keepers(spark, rows):
    """Row number of the document that stands for each row: all pairs compared."""
    means = simhash.language_means(frame(spark, rows))
    texts = pa.array([r[1] for r in rows], pa.string())
    seg, chk, words = simhash.fingerprint(texts, means)
    sets = [[set(x[x >= 0]) for x in simhash.golay_indices(seg[:, k])[0]] for k in range(simhash.SEGMENTS)]
    short = []
    for _, h, off, _ in simhash.textkit.words(texts):
        v, w = simhash.variants(h, off)
        short += [set(zip(a, b)) if a is not None else set() for a, b in zip(v, w)]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if words[i] and words[j]:
                near = np.bitwise_count((chk[i] ^ chk[j]).view(np.uint64)).sum() <= simhash.MAX_DISTANCE
                keyed = sum(bool(s[i] & s[j]) for s in sets) >= 2
                if (chk[i] == chk[j]).all() or near and keyed or short[i] & short[j]:
                    links.append((i, j))
    group = groups_of(len(rows), links)
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    first = {g: min(ids, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g, ids in members.items()}
    return [first[g] for g in group]


def corpus(seed, groups=20, alone=60):
    rng = random_rng(seed)
    words = vocabulary(rng, 1200)
    rows = []
    for _ in range(groups):
        base = prose(rng, words, rng.choice([12, 15, 16, 17, 60, 300]))
        rows += [(len(rows) + k, edited(rng, words, base, rng.choice([0.0, 0.02, 0.05])), "en", "s") for k in range(rng.randint(1, 5))]
    rows += [(len(rows) + k, prose(rng, words, rng.randint(1, 200)), "de", "t") for k in range(alone)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    for seed in (61, 62):
        rows = corpus(seed)
        want = brute_keepers(spark, rows)
        got = {r.doc_id: (r.keeper_doc_id, r.keep) for r in simhash.near_duplicates(frame(spark, rows, clash=True)).collect()}
        assert got == {r[0]: (rows[k][0], k == i) for (i, r), k in zip(enumerate(rows), want)}
        assert len(set(want)) < len(rows)


def brute_windows(rows, window, k):
    """All pairs of classes compared, paths walked block by block, windows filled."""
    s, words = packing.sketch(pa.array([r[1] for r in rows], pa.string()))
    node: dict = {}
    of = [node.setdefault(x.tobytes(), i) if n else None for i, (x, n) in enumerate(zip(s, words))]
    names = sorted(set(of) - {None})
    edges = []
    for a in names:
        sims = sorted((-int((s[a] == s[b]).sum()), b) for b in names if b != a and (s[a] == s[b]).any())
        edges += [(a, b, -x) for x, b in sims[:k]]
    root = groups_of(len(rows), [e[:2] for e in edges])
    place: dict = {}
    for block in sorted({root[x] for x in names}):
        inside = [x for x in names if root[x] == block]
        for x in packing.walk(inside, [e for e in edges if root[e[0]] == block]):
            place[x] = len(place)
    seen: Counter = Counter()
    order = []
    for i, n in enumerate(of):
        if n is not None:
            seen[n, rows[i][0]] += 1
            order.append((seen[n, rows[i][0]], place[n], i))
    out, at = [], 0
    for _, _, i in sorted(order):
        done = 0
        while done < words[i]:
            take = min(int(words[i]) - done, window - at % window)
            out.append((at // window, at % window, rows[i][0], done, take))
            at, done = at + take, done + take
    return out


def families(seed, n_groups, each, share):
    """Groups of relatives; all rows share passages with others, so that components have buckets of many rows."""
    rng = random_rng(seed)
    words = vocabulary(rng, 1500)
    passages = [prose(rng, words, 60) for _ in range(3)]
    rows = []
    for _ in range(n_groups):
        own = prose(rng, words, 120) + " " + " ".join(rng.sample(passages, 2))
        rows += [(len(rows) + k, edited(rng, words, own, share), "en", "s") for k in range(each)]
    return rows


def test_neighbours_in_large_buckets_equal_brute_force(spark, monkeypatch):
    """Every one of the k best partners, ties by name, however many classes share a component."""
    for seed, n_groups, each, share, dense, k in ((74, 24, 5, 0.03, 16, 3), (75, 1, 90, 0.01, 24, 8)):
        s, _ = packing.sketch(pa.array([r[1] for r in families(seed, n_groups, each, share)]))
        s = np.unique(s, axis=0)
        sim = (s[:, None, :] == s[None, :, :]).sum(axis=2)
        assert max(Counter((c, x) for c in range(packing.COMPONENTS) for x in s[:, c].tolist()).values()) > 2 * dense
        partners = [sorted((b for b in range(len(s)) if b != a and sim[a, b]), key=lambda b: (-sim[a, b], b)) for a in range(len(s))]
        classes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(s)], "node bigint, sketch binary")
        monkeypatch.setattr(packing, "DENSE", dense)
        got = sorted(tuple(r) for r in packing.neighbours(classes, k).collect())
        assert got == sorted((a, b, int(sim[a, b])) for a, bs in enumerate(partners) for b in bs[:k])


def test_windows_equal_brute_force(spark):
    rng = random_rng(71)
    for seed, k in ((72, 8), (73, 2)):
        rows = corpus(seed, 25, 20) + ODD
        rows += [rng.choice(rows) for _ in range(30)]
        got = packing.pack(frame(spark, rows, clash=True).coalesce(1), window=150, k=k).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_windows(rows, 150, k), key=repr)


def test_packing_stage_with_large_buckets_equals_brute_force(spark, monkeypatch):
    import corpus_pipeline

    rows = families(77, 18, 5, 0.03)
    monkeypatch.setattr(packing, "DENSE", 16)
    stage = dict(corpus_pipeline.STAGES)["packing"]
    got = stage(spark, frame(spark, rows, clash=True).coalesce(1), "").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_windows(rows, packing.WINDOW, packing.NEIGHBOURS), key=repr)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random_rng(81)
    rows = [(i, "the of and " + t, lang, rng.choice("aab")) for i, t, lang, _ in corpus(82)]
    rows += [(1000 + i, rng.choice(rows)[1], "en", "c") for i in range(10)]
    rows += [(2000, "w### " * 50, "en", "a"), (2001, None, "en", "a"), (2002, "", None, None), (2003, "a | b | c |", "en", "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    judged, names = with_duckdb(quality.rules_sql(), documents=table)
    good = {r[names.index("doc_id")] for r in judged if r[names.index("keep")]}
    left = [r for r in rows if r[0] in good]
    first: dict = {}
    for r in left:
        first.setdefault(r[1], r)
    left = sorted(first.values())
    keepers = brute_keepers(spark, left)
    left = [r for i, r in enumerate(left) if keepers[i] == i]
    table = pa.table({"doc_id": pa.array([r[0] for r in left], pa.int64()), "text": pa.array([r[1] for r in left]), "source": pa.array([r[3] for r in left], pa.string())})
    mixed, _ = with_duckdb(mixing.mix_sql(columns="doc_id"), documents=table)
    text = {r[0]: r[1] for r in left}
    want = [(i, text[i], None, None) for (i,) in mixed]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(left) < len(good) < len(rows)
    assert check_windows(want, got, packing.WINDOW) <= 1
