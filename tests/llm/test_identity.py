"""Results don't depend on how a table is split, on the type of its ids, or on when it is read again."""

import re

import pytest

from pagelume.llm import exact, lines, packing, pii, runindex, simhash, warc
from pagelume.llm.storage import cleared, so_far, written
from tests.llm.corpus import edited, frame, prose, random_rng, vocabulary

FILES = 6


def rows_with_copies(seed=41):
    rng = random_rng(seed)
    words = vocabulary(rng, 900)
    shared = [f"line number {i} of many sites" for i in range(6)]
    rows = []
    for g in range(40):
        base = prose(rng, words, rng.randint(60, 200)) + "\n" + rng.choice(shared)
        rows += [(2 * g, base, "en", f"s{g % 7}"), (2 * g + 1, base if g % 2 else edited(rng, words, base, 0.01), "en", f"s{(g + 1) % 7}")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def split(spark, tmp_path):
    """Give a table of several files whose splits change after the operator was called; then the settings go back."""
    rows = rows_with_copies()
    path = str(tmp_path / "documents")
    frame(spark, rows).repartition(FILES).write.parquet(path)
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(values):
        for n, v in values.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)

    put({"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "0"})
    yield rows, spark.read.parquet(path), lambda: put({"spark.sql.files.minPartitionNum": str(FILES), "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4m"})
    put(before)


def texts_of(df):
    return sorted(r.text for r in df.collect())


def test_exact_dedup_after_other_splits(split):
    rows, docs, change = split
    want = sorted({t for _, t, *_ in rows})
    out = exact.drop_exact_duplicates(docs)
    change()
    assert texts_of(out) == want
    assert texts_of(exact.drop_exact_duplicates(docs.repartition(8))) == want


def test_near_dedup_after_other_splits(split, spark):
    rows, docs, change = split
    keep = sorted(r.doc_id for r in simhash.near_duplicates(frame(spark, rows)).collect() if r.keep)
    out = simhash.drop_near_duplicates(docs)
    again = simhash.near_duplicates(docs)
    change()
    assert sorted(r.doc_id for r in out.collect()) == keep == sorted(r.doc_id for r in again.collect() if r.keep)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs.repartition(8)).collect()) == keep


def test_lines_and_passages_after_other_splits(split, spark):
    rows, docs, change = split
    plain = frame(spark, rows)
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(lines.remove_shared_lines(plain)), key(runindex.repeated_passages(plain))
    out = lines.remove_shared_lines(docs), runindex.repeated_passages(docs)
    change()
    assert tuple(map(key, out)) == want
    mixed = docs.repartition(8)
    assert (key(lines.remove_shared_lines(mixed)), key(runindex.repeated_passages(mixed))) == want


def test_archive_and_windows_after_other_splits(split, spark):
    rows, docs, change = split
    records = docs.select("doc_id", docs.text.cast("binary").alias("record"))
    archive = warc.store(records)
    packed = packing.pack(docs, window=200)
    change()
    assert sorted(bytes(r.record).decode() for r in warc.rebuild(archive).collect()) == sorted(t for _, t, *_ in rows)
    words = {i: len(re.findall("[0-9a-z_\x80-\U0010ffff]+", t.lower())) for i, t, *_ in rows}
    got: dict = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == words


def test_ids_of_any_type(spark):
    rows = [(f"d{i:03d}", t, "en", s) for i, t, _, s in rows_with_copies(43)] + [(None, "write to jo.doe@mail.example.com", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    ids = sorted(r[0] for r in rows if r[0])
    least = {}
    for i, t, *_ in rows:
        if i:
            least[t] = min(i, least.get(t, i))
    for share in (0.0, 0.4, 1.0):
        got = {r.doc_id: r.winner_doc_id for r in exact.exact_duplicates(docs, share).collect()}
        assert {i: got[i] for i in ids} == {i: least[t] for i, t, *_ in rows if i}
    near = simhash.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in near if r.doc_id) == ids and sum(r.keep for r in near) < len(set(least)) + 1
    assert {r.doc_id for r in packing.pack(docs).collect()} == {r[0] for r in rows}
    assert {r.doc_id for r in runindex.repeated_passages(docs).collect()} <= set(ids)
    assert [r.doc_id for r in pii.private_data(docs).collect()] == [None]
    assert {r.doc_id for r in lines.remove_shared_lines(docs).collect()} == {r[0] for r in rows}


def test_short_texts_match_with_one_word_left_out_or_changed(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [words[:15], words[:14], words[:7] + ["other"] + words[8:15], words[:16], words[5:20], words[:5], ["w9", *words[1:5]], words[:9], words[1:9]]
    got = {r.doc_id: r.keeper_doc_id for r in simhash.near_duplicates(frame(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(9)] == [0, 0, 0, 0, 4, 5, 6, 7, 8]


def test_languages_beyond_the_bound_share_a_mean(spark):
    rng = random_rng(5)
    words = vocabulary(rng)
    rows = [(i, prose(rng, words, 40), f"l{i % 9}", "s") for i in range(90)]
    docs = frame(spark, rows)
    assert simhash.language_means(docs, 4).shape == (5, simhash.SEARCH_BITS) and simhash.language_means(docs, 9).shape[0] == 9
    one = simhash.language_means(docs.withColumn("lang", docs.lang.substr(1, 1)), 9)
    assert one.shape == (1, simhash.SEARCH_BITS)


def test_hot_minimizers_mark_what_shards_mark(spark, monkeypatch):
    rng = random_rng(51)
    words = vocabulary(rng, 300)
    passage, short = prose(rng, words, 70), prose(rng, words, 30)
    rows = []
    for i in range(40):
        middle = passage if i % 2 else short + " " + prose(rng, words, 5)
        rows.append((i, " ".join([prose(rng, words, rng.randint(0, 80)), middle, prose(rng, words, rng.randint(0, 80))]), "en", "s"))
    rows.append((99, rows[0][1], "en", "s"))
    want = sorted(map(tuple, runindex.repeated_passages(frame(spark, rows)).collect()))
    monkeypatch.setattr(runindex, "HOT_OCCURRENCES", 3)
    assert sorted(map(tuple, runindex.repeated_passages(frame(spark, rows)).collect())) == want and want


def test_passes_rank_repeated_rows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(u, 1 if u % 3 else None, 10, u % 2) for u in range(120)] + [(200, 5, 3, 9)]
    got = packing._passes(spark.createDataFrame(rows, "uid bigint, doc_id bigint, n bigint, node bigint")).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.node, r.doc_id), []).append(r.copy)
    assert len(got) == 121 and all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values()) and len(by) == 5


def test_classes_above_the_bound_are_parted(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCUMENTS", 20)
    rows = [(i, "the same words in every one of these many rows", "en", "s") for i in range(150)]
    got = packing.pack(frame(spark, rows), window=64).collect()
    assert sum(r.n_words for r in got) == 150 * 10 and len({r.doc_id for r in got}) == 150


def test_tables_that_nothing_needs_are_cleared(spark):
    mark = so_far()
    a, b = written(spark.range(5), "a"), written(spark.range(7), "b")
    cleared(spark, mark, b)
    assert b.count() == 7 and so_far() == mark + 1
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()
