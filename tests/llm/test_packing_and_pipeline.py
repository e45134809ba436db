import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pagelume.llm import packing
from tests.llm.corpus import ODD, edited, frame, noting, prose, random_rng, vocabulary

#: A word as textkit defines it: everything beyond ASCII belongs to words.
WORD = "[0-9a-z_\x80-\U0010ffff]+"


def related(n_groups=40, seed=11):
    rng = random_rng(seed)
    words = vocabulary(rng, 800)
    rows = []
    for g in range(n_groups):
        base = prose(rng, words, rng.randint(80, 300))
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), edited(rng, words, base, rng.choice([0.01, 0.03, 0.06])), "en", "s"))
    return rows


def shingle_sets(rows):
    out = []
    for r in rows:
        w = re.findall(WORD, (r[1] or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def sketches_of(spark, rows):
    s, n = packing.sketch(pa.array([r[1] for r in rows], pa.string()))
    return spark.createDataFrame([(i, r[0], int(n[i]), s[i].tobytes()) for i, r in enumerate(rows) if n[i]], "uid bigint, doc_id bigint, n bigint, sketch binary")


def classes_of(spark, rows):
    return packing.classes_of(sketches_of(spark, rows))


def of_rows(rows, edges):
    """Edges between classes as edges between rows: members of one class are neighbours, and all have the partners of their class."""
    s, _ = packing.sketch(pa.array([r[1] for r in rows], pa.string()))
    members = defaultdict(list)
    for i, x in enumerate(s):
        members[x.tobytes()].append(i)
    of = {ids[0]: ids for ids in members.values()}
    inner = [(a, b, packing.COMPONENTS) for ids in of.values() for a in ids for b in ids if a != b]
    return inner + [(i, b, sim) for a, b, sim in edges for i in of[a]]


def recall(rows, edges, k):
    """Share of each row's k best partners by true overlap that the graph has, counting ties as equal."""
    sets = shingle_sets(rows)
    got = defaultdict(set)
    for a, b, _ in edges:
        got[a].add(b)
    hit = total = 0
    for i, s in enumerate(sets):
        sim = sorted(((len(s & t) / len(s | t), j) for j, t in enumerate(sets) if j != i and s & t), reverse=True)
        sim = [x for x in sim if x[0] >= 0.2][:k]
        if sim:
            floor = sim[-1][0] - 0.15
            total += len(sim)
            hit += min(len(sim), sum(len(s & sets[j]) / len(s | sets[j]) >= floor for j in got[i]))
    return hit / total


def test_neighbours_recall_against_brute_force(spark):
    rows = related()
    edges = [tuple(r) for r in packing.neighbours(classes_of(spark, rows), 4).collect()]
    assert recall(rows, edges, 4) >= 0.9
    assert max(Counter(a for a, _, _ in edges).values()) <= 4


def test_buckets_above_the_bound_keep_recall(spark, monkeypatch):
    """All rows share components, in buckets of several times the bound."""
    rng = random_rng(2)
    words = vocabulary(rng, 800)
    base = prose(rng, words, 200)
    rows = [(i, edited(rng, words, base, 0.02), "en", "s") for i in range(150)]
    monkeypatch.setattr(packing, "DENSE", 32)
    edges = [tuple(r) for r in packing.neighbours(classes_of(spark, rows), 4).collect()]
    assert recall(rows, of_rows(rows, edges), 4) >= 0.9


def test_groups_within_a_bucket_above_the_bound_keep_recall(spark, monkeypatch):
    """Groups of relatives that all share one passage with each other: the hot bucket holds every row."""
    rng = random_rng(12)
    words = vocabulary(rng, 2000)
    passage = prose(rng, words, 60)
    rows = []
    for _ in range(60):
        own = prose(rng, words, 150)
        for _ in range(5):
            rows.append((len(rows), passage + " " + edited(rng, words, own, 0.03), "en", "s"))
    monkeypatch.setattr(packing, "DENSE", 32)
    edges = [tuple(r) for r in packing.neighbours(classes_of(spark, rows), 4).collect()]
    assert recall(rows, of_rows(rows, edges), 4) >= 0.9


def test_walk_is_greedy_and_starts_low():
    edges = [(1, 2, 5), (2, 3, 9), (3, 4, 1), (2, 4, 7)]
    assert packing.walk([1, 2, 3, 4, 5], edges) == [5, 1, 2, 3, 4]
    assert packing.walk([3, 1, 2], []) == [1, 2, 3]
    assert sorted(packing.walk(list(range(50)), [(i, (i * 7) % 50, i) for i in range(50)])) == list(range(50))


def check_windows(rows, got, window):
    """Every word of every row once, windows filled from the start without gaps."""
    count = Counter()
    for i, t, *_ in rows:
        n = len(re.findall(WORD, (t or "").lower()))
        if n:
            count[i] += n
    placed = Counter()
    by_window = defaultdict(list)
    for r in got:
        placed[r.doc_id] += r.n_words
        by_window[r.window_id].append((r["at"], r.n_words))
        assert r.n_words > 0 and r.start >= 0
    assert placed == count
    short = 0
    for parts in by_window.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= window
        short += end < window
    return short


def test_windows_hold_every_word_once(spark):
    rows = related() + ODD
    got = packing.pack(frame(spark, rows, clash=True), window=256).collect()
    assert check_windows(rows, got, 256) <= 1
    near = Counter()
    for r in got:
        near[r.window_id] += 1
    assert max(near.values()) > 1


def test_related_documents_share_windows(spark):
    rows = related(30, 5)
    sets = shingle_sets(rows)
    by_window = defaultdict(set)
    for r in packing.pack(frame(spark, rows), window=600).collect():
        by_window[r.window_id].add(r.doc_id)
    together = {(a, b) for ids in by_window.values() for a in ids for b in ids if a < b}
    close = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j])]
    far = len(together) / (len(rows) * (len(rows) - 1) / 2)
    assert np.mean([p in together for p in close]) > 3 * far


def test_copies_go_to_later_passes(spark):
    rows = [r for r in related(10, 3) for _ in range(3)]
    got = packing.pack(frame(spark, rows), window=400).collect()
    assert check_windows(rows, got, 400) <= 1
    per = Counter((r.window_id, r.doc_id) for r in got if r.start == 0)
    assert np.mean([n == 1 for n in per.values()]) > 0.9


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCUMENTS", 3)
    rows = related(12, 7)
    assert check_windows(rows, packing.pack(frame(spark, rows), window=200).collect(), 200) <= 1


def chained(n_groups=60, each=5):
    """Groups of documents with half of their words in common, chained by passages that each group shares with some others."""
    rng = random_rng(31)
    words = vocabulary(rng, 3000)
    passages = [prose(rng, words, 50) for _ in range(n_groups)]
    rows = []
    for g in range(n_groups):
        base = " ".join([prose(rng, words, 200), *rng.sample(passages, 4)])
        for _ in range(each):
            rows.append((len(rows), base + " " + prose(rng, words, 160), "en", "s"))
    return rows, [i // each for i in range(len(rows))]


def test_top_neighbours_stay_adjacent_in_a_block_far_above_the_bound(spark, monkeypatch):
    rows, group = chained()
    edges = packing.neighbours(classes_of(spark, rows))
    assert packing.components(edges).groupBy("root").count().agg({"count": "max"}).first()[0] > 150
    monkeypatch.setattr(packing, "BLOCK_DOCUMENTS", 20)
    got = sorted(packing.pack(frame(spark, rows), window=300).collect(), key=lambda r: (r.window_id, r["at"]))
    order = list(dict.fromkeys(r.doc_id for r in got))
    beside = [group[a] == group[b] for a, b in zip(order, order[1:])]
    near = [any(beside[max(0, i - 1) : i + 1]) for i in range(len(order))]
    assert np.mean(near) >= 0.95


def test_units_contract_the_strongest_edges_in_rounds_and_in_order(spark, monkeypatch):
    rows, group = chained()
    edges = packing.neighbours(classes_of(spark, rows)).cache()
    sizes = spark.createDataFrame([(i, 1) for i in range(len(rows))], "node bigint, size bigint")
    top = {}
    for e in edges.collect():
        top[e.a] = max(top.get(e.a, (0, 0)), (e.sim, -e.b))
    for local in (10**6, 200, 0):
        monkeypatch.setattr(packing, "LOCAL_EDGES", local)
        unit = {r.node: r.unit for r in packing.units(sizes, edges, 20).collect()}
        assert sorted(unit) == list(range(len(rows)))
        assert max(Counter(unit.values()).values()) <= 20
        assert np.mean([unit[a] == unit[-b] for a, (_, b) in top.items()]) >= 0.95
    heavy = spark.createDataFrame([(1, 30), (2, 1), (3, 1)], "node bigint, size bigint")
    pairs = spark.createDataFrame([(1, 2, 9), (2, 3, 4)], "a bigint, b bigint, sim int")
    unit = {r.node: r.unit for r in packing.units(heavy, pairs, 20).collect()}
    assert unit[2] == unit[3] != unit[1]


def test_pack_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [(1, None, None, None), (2, "", "en", "s")])).count() == 0


def test_packing_takes_texts_in_batches_bounded_by_bytes(spark, tmp_path, monkeypatch):
    rng = random_rng(8)
    text = prose(rng, vocabulary(rng), 60_000)
    rows = [(i, text, "en", "s") for i in range(60)]
    monkeypatch.setattr(packing, "_sketches", noting(packing._sketches, tmp_path))
    got = packing.pack(frame(spark, rows).coalesce(1)).collect()
    assert check_windows(rows, got, packing.WINDOW) <= 2
    size, count = zip(*(map(int, x.read_text().split()) for x in tmp_path.iterdir()))
    assert sum(count) == 60 and max(size) < (8 << 20)


# --- pipeline -------------------------------------------------------------


def stages(spark, docs):
    import corpus_pipeline

    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], ""))
    return out


def test_stages_take_effect_in_order(spark):
    import corpus_pipeline

    rng = random_rng(21)
    words = vocabulary(rng, 700)
    clean = [(i, "the of and " + prose(rng, words, rng.randint(30, 200)), "en", "ab"[i % 2]) for i in range(40)]
    copies = [(100 + i, clean[i][1], "en", "a") for i in range(5)]
    near = [(200 + i, edited(rng, words, clean[i][1], 0.01), "en", "a") for i in range(10, 20)]
    junk = [(300, "", "en", "a"), (301, None, "en", "a"), (302, "w### " * 50, "en", "a")]
    docs = frame(spark, clean + copies + near + junk, clash=True)
    _, rules, exact, fuzzy, mixed, packed = stages(spark, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    assert ids(rules) == sorted(r[0] for r in clean + copies + near)
    assert ids(exact) == sorted(r[0] for r in clean + [n for n in near if n[1] != clean[n[0] - 200][1]])
    kept = ids(fuzzy)
    assert set(range(40)) <= set(kept) and len(kept) <= 42
    for df in (rules, exact, fuzzy, mixed):
        assert df.columns == docs.columns
    n = Counter(ids(mixed))
    assert set(n) <= set(kept)
    text = dict((r[0], r[1]) for r in clean + near)
    rows = [(i, text[i]) for i, c in n.items() for _ in range(c)]
    check_windows([(i, t, None, None) for i, t in rows], packed.collect(), packing.WINDOW)


def test_stages_on_odd_and_empty_tables(spark):
    for rows in (ODD, [], [(None, None, None, None)]):
        out = stages(spark, frame(spark, rows, clash=True))
        assert out[-1].columns == ["window_id", "at", "doc_id", "start", "n_words"]
        out[-1].collect()


def test_run_is_the_chain_of_its_stages(spark, tmp_path):
    import corpus_pipeline

    frame(spark, related(15, 4)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = stages(spark, spark.read.parquet(str(tmp_path / "documents.parquet")))[-1]
    key = lambda r: repr(r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_only_the_entry_guards_the_import():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{i}_" for i in range(1, 11)} == {m.group() for n in names if (m := re.match(r"op\d+_", n))}
    assert "pipeline" in names and set(e.oracle_sql()) <= names
