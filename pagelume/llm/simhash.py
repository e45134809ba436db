"""Operator 10: near duplicates by SimHash fingerprints and Golay-code fuzzy keys.

Each document gets two SimHash fingerprints: 92 *search* bits over its words,
taken about the mean of its language so that function words don't make
strangers alike, and 128 *check* bits over its 3-word shingles.  The search
bits are four segments of 23, the length of the perfect binary Golay code.  A
segment is decoded together with its 23 one-bit neighbours, which gives one to
seven codeword indices; two segments at distance 2 or less always share one.
By the pigeonhole principle, of 8 errors over four segments at most two
segments hold 3 or more, so two documents within 8 search bits share the
indices of two segments.  Each pair of segments is a key; documents that share
a key are verified on their check bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.llm import textkit
from pagelume.llm.buckets import runs
from pagelume.llm.graph import components
from pagelume.llm.storage import dropped, kind_of, numbered, row_id, written

SEGMENTS = 4
SEGMENT_BITS = 23
SEARCH_BITS = SEGMENTS * SEGMENT_BITS
CHECK_BITS = 128
SHINGLE = 3
#: Most check bits in which near duplicates differ.
MAX_DISTANCE = 34
#: Shorter documents have too few shingles for fingerprints and are compared word by word.
MIN_WORDS = 16
#: From so many words on, short documents match others with one word left out or changed; shorter ones only the same words.
VARIANT_WORDS = 10
#: Languages of the most words whose means are kept apart; all others have one mean together.
LANGUAGES = 512

_GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= _GENERATOR << (i - 11)
    return v


_LOW = np.array([_remainder(i) for i in range(1 << 11)], np.int64)
_HIGH = np.array([_remainder(i << 11) for i in range(1 << 12)], np.int64)
_ERROR = np.zeros(1 << 11, np.int64)
for _weight in range(4):
    for _bits in combinations(range(SEGMENT_BITS), _weight):
        _e = sum(1 << i for i in _bits)
        _ERROR[_LOW[_e & 2047] ^ _HIGH[_e >> 11]] = _e


def golay_decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within 3 bits of each 23-bit number."""
    return (v ^ _ERROR[_LOW[v & 2047] ^ _HIGH[v >> 11]]) >> 11


def golay_indices(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each number and its one-bit neighbours: (n x 7, -1 where fewer; how many)."""
    near = np.sort(golay_decode(v[:, None] ^ np.concatenate([[0], 1 << np.arange(SEGMENT_BITS)])), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    out = np.full((len(v), 7), -1, np.int64)
    row, _ = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[new]] = near[new]
    return out, new.sum(axis=1)


# --- fingerprints ---------------------------------------------------------


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for row, h, off, _ in textkit.words(batch.column("text")):
            n = np.diff(off)
            votes = textkit.bit_votes(h, off, SEARCH_BITS)
            part = langs[row : row + len(n)]
            for lang in set(part):
                m = part == lang if lang is not None else np.array([x is None for x in part])
                total = sums.setdefault(lang, np.zeros(SEARCH_BITS + 1, np.int64))
                total[:-1] += votes[m].sum(axis=0)
                total[-1] += n[m].sum()
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "s": pa.array([list(map(int, v)) for v in sums.values()], pa.list_(pa.int64()))}
        )


def language_means(docs: DataFrame, languages: int = LANGUAGES) -> np.ndarray:
    """Mean search vote per word over all documents: a row for each of ``languages`` languages and one for all others together."""
    part = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_language_sums, "lang string, s array<bigint>")
    names = [f"s{i}" for i in range(SEARCH_BITS + 1)]
    sums = written(part.groupBy("lang").agg(*[F.sum(F.col("s")[i]).alias(c) for i, c in enumerate(names)]), "language-sums")
    most = sums.filter(f"s{SEARCH_BITS} > 0").orderBy(F.desc(f"s{SEARCH_BITS}"), "lang").limit(languages).collect()
    every = sums.agg(*[F.sum(c).alias(c) for c in names]).first()
    dropped(sums)
    if not most:
        return np.zeros((1, SEARCH_BITS))
    own = np.array([list(r)[1:] for r in most], float)
    rest = np.array(list(every), float) - own.sum(axis=0)
    a = np.vstack([own, rest]) if rest[-1] > 0 else own
    return a[:, :-1] / a[:, -1:]


_FOLDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25))


def variants(h: np.ndarray, off: np.ndarray) -> tuple[list, list]:
    """Two hashes of each row's word list, and of it with one word left out, for rows of VARIANT_WORDS to MIN_WORDS words; None for others.

    Two lists share a hash of both kinds if they are equal, one has a word more
    than the other, or one word differs.
    """
    n = np.diff(off)
    out: tuple[list, list] = ([None] * len(n), [None] * len(n))
    rows = np.flatnonzero((n >= VARIANT_WORDS) & (n <= MIN_WORDS))
    if not len(rows):
        return out
    inside = np.arange(MIN_WORDS) < n[rows, None]
    word = h[np.minimum(off[rows][:, None] + np.arange(MIN_WORDS), len(h) - 1)]
    left_out = np.arange(MIN_WORDS + 1)  # the last leaves out none
    valid = (left_out < n[rows, None]) | (left_out == MIN_WORDS)
    for column, fold in zip(out, _FOLDS):
        acc = np.zeros(valid.shape, np.uint64)
        for i in range(MIN_WORDS):
            acc = np.where(inside[:, i : i + 1] & (left_out != i), acc * fold + word[:, i : i + 1], acc)
        acc = textkit.mix64(acc).view(np.int64)
        for k, r in enumerate(rows):
            column[r] = acc[k, valid[k]]
    return out


def fingerprint(col: pa.Array, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments n x 4 int64, check bits n x 2 int64, words per row)."""
    norm = np.linalg.norm(means, axis=1)
    norm[norm == 0] = 1
    place = (1 << np.arange(SEGMENT_BITS)).astype(np.int64)
    seg, chk, cnt = [], [], []
    for _, h, off, _ in textkit.words(col):
        n = np.diff(off)
        votes = textkit.bit_votes(h, off, SEARCH_BITS) / np.maximum(n, 1)[:, None]
        near = np.argmax(votes @ (means.T / norm), axis=1)
        s = (votes - means[near] > 0).reshape(len(n), SEGMENTS, SEGMENT_BITS) @ place
        g, goff = textkit.shingles(h, off, SHINGLE)
        c = np.packbits(textkit.bit_votes(g, goff, CHECK_BITS) > 0, axis=1).view(np.int64).reshape(-1, 2)
        short = np.flatnonzero(n < MIN_WORDS)
        if len(short):
            c = c.copy()
            for r in short:
                one = textkit._fold(h[off[r] : off[r + 1]])
                k = textkit.mix64(np.array([one + np.uint64(i) for i in range(6)], np.uint64))
                s[r] = (k[:4] & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)
                c[r] = k[4:].view(np.int64)
        seg.append(s)
        chk.append(c)
        cnt.append(n)
    if not seg:
        return np.zeros((0, SEGMENTS), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    return np.concatenate(seg), np.concatenate(chk), np.concatenate(cnt)


def fingerprints(rows: DataFrame, means: np.ndarray) -> DataFrame:
    """(uid, doc_id, s0..s3, c0, c1, v, w) of every row (uid, doc_id, text), written once; without words the numbers are null, v and w without variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, c, n = fingerprint(batch.column("text"), means)
            none = n == 0
            short: tuple[list, list] = ([], [])
            for _, h, off, _ in textkit.words(batch.column("text")):
                for x, y in zip(short, variants(h, off)):
                    x += y
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id")] + [pa.array(x, mask=none) for x in (*s.T, *c.T)] + [pa.array(x, pa.list_(pa.int64())) for x in short],
                names=["uid", "doc_id", *(f"s{i}" for i in range(SEGMENTS)), "c0", "c1", "v", "w"],
            )

    kinds = f"uid bigint, doc_id {kind_of(rows, 'doc_id')}, " + ", ".join(f"{c} bigint" for c in ("s0", "s1", "s2", "s3", "c0", "c1")) + ", v array<bigint>, w array<bigint>"
    return written(rows.select("uid", "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds), "fingerprints")


# --- search and verification ----------------------------------------------

KEYS_AT_ONCE = 4000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each node: a row per pair of segments and index of the first, with all indices of the second packed in two numbers."""
    for whole in batches:
        for at in range(0, whole.num_rows, KEYS_AT_ONCE):
            batch = whole.slice(at, KEYS_AT_ONCE)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            c0, c1 = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c0", "c1"))
            ind, cnt = zip(*(golay_indices(batch.column(f"s{i}").to_numpy(zero_copy_only=False)) for i in range(SEGMENTS)))
            packed = []
            for x, n in zip(ind, cnt):
                y = np.maximum(x, 0)
                low = sum(y[:, t] << (12 * t) for t in range(5))
                packed.append((low, y[:, 5] | (y[:, 6] << 12) | (n.astype(np.int64) << 24)))
            key, row, low, high = [], [], [], []
            for p, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
                r, t = np.nonzero(ind[i] >= 0)
                key.append((p << 12) + ind[i][r, t])
                row.append(r)
                low.append(packed[j][0][r])
                high.append(packed[j][1][r])
            r = np.concatenate(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key).astype(np.int32))] + [pa.array(x) for x in (node[r], c0[r], c1[r], np.concatenate(low), np.concatenate(high))],
                names=["k", "node", "c0", "c1", "low", "high"],
            )


def _unpacked(k: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(full keys, row of each) of rows made by ``_keys``."""
    n = high >> 24
    row = np.repeat(np.arange(len(k)), n)
    t = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    index = np.where(t < 5, low[row] >> (12 * np.minimum(t, 4)), high[row] >> (12 * np.maximum(t - 5, 0))) & 4095
    return (k[row].astype(np.int64) << 12) + index, row


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of a signed number the bits of its absolute value would count


DENSE = 512


class _Forest:
    """Union-find over the nodes of one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while not np.array_equal(s := self.up[r], r):
            r = s
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Merge; the pairs that joined two trees."""
        a, b = self.roots(a), self.roots(b)
        apart = a != b
        if not apart.any():
            return []
        pairs = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0)
        up, made = self.up, []
        for x, y in pairs.tolist():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                made.append((int(x), int(y)))
        return made


def link(key: np.ndarray, node: np.ndarray, check: np.ndarray, row: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span, within each key's bucket, all pairs of nodes within ``limit`` check bits.

    Entry i puts node[row[i]], with its check bits, into the bucket key[i].

    Buckets up to DENSE rows are compared pair by pair, all at once by shifts.
    Larger ones go pivot by pivot: a pivot is compared with the whole bucket
    and takes its matches along, so pairs within one pivot's reach need no
    comparing of their own; members of different clusters are still compared
    until their clusters meet or all pairs are done, so no pair is lost.
    """
    order = np.argsort(key, kind="stable")
    names, ids = np.unique(node, return_inverse=True)
    key, check, ids = key[order], check[row[order]], ids[row[order]]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    of = np.repeat(size, size)
    end = np.repeat(begin + size, size)
    forest = _Forest(len(names))
    out_a, out_b = [], []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in forest.join(a, b):
            out_a.append(x)
            out_b.append(y)

    small = np.flatnonzero((of > 1) & (of <= DENSE))
    shift = 1
    while len(small):
        small = small[small + shift < end[small]]
        for at in range(0, len(small), 1 << 20):
            i = small[at : at + (1 << 20)]
            hit = _distance(check[i], check[i + shift]) <= limit
            if hit.any():
                add(ids[i[hit]], ids[i[hit] + shift])
        shift += 1
    for b in np.flatnonzero(size > DENSE):
        s, n = begin[b], size[b]
        cs, us = check[s : s + n], ids[s : s + n]
        group = np.full(n, -1)
        pivots = []
        while (left := np.flatnonzero(group < 0)).size:
            p = left[0]
            hit = np.flatnonzero(_distance(cs, cs[p]) <= limit)
            add(np.full(len(hit), us[p]), us[hit])
            group[hit[group[hit] < 0]] = len(pivots)
            group[p] = len(pivots)
            pivots.append(p)
        for g in range(len(pivots)):
            mine = np.flatnonzero(group == g)
            rest = np.flatnonzero(group > g)
            for m in mine:
                if not len(rest):
                    break
                apart = forest.roots(us[pivots]) != forest.roots(us[m : m + 1])[0]
                rest = rest[apart[group[rest]]]
                hit = rest[_distance(cs[rest], cs[m]) <= limit]
                if len(hit):
                    add(np.full(len(hit), us[m]), us[hit])
    return names[np.array(out_a, np.int64)] if out_a else np.zeros(0, np.int64), names[np.array(out_b, np.int64)] if out_b else np.zeros(0, np.int64)


def near_edges(fp: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) over classes of equal check bits; a class is named by its least uid.

    Classes of short texts are linked to the least of those that share a
    variant, all others by their fuzzy keys.
    """
    classes = fp.groupBy("c0", "c1").agg(F.min(F.struct("uid", "s0", "s1", "s2", "s3", "v", "w")).alias("x"))
    listed = classes.filter("x.v is not null").select(F.col("x.uid").alias("a"), F.inline(F.arrays_zip("x.v", "x.w")))
    listed = written(listed.toDF("a", "v", "w"), "variants")
    meet = listed.groupBy("v", "w").agg(F.min("a").alias("b"), F.max("a").alias("most")).filter("b < most").drop("most")
    short = listed.join(meet, ["v", "w"]).filter("a != b").select("a", "b")
    nodes = classes.select(F.col("x.uid").alias("node"), *[f"x.s{i}" for i in range(SEGMENTS)], "c0", "c1")
    keys = nodes.mapInArrow(_keys, "k int, node bigint, c0 bigint, c1 bigint, low bigint, high bigint")
    parts = int(fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "k"):
            k, node, c0, c1, low, high = (x.to_numpy() for x in table.columns)
            key, row = _unpacked(k, low, high)
            a, b = link(key, node, np.stack([c0, c1], axis=1), row, max_distance)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return keys.repartition(2 * parts, "k").sortWithinPartitions("k").mapInArrow(run, "a bigint, b bigint").union(short)


def near_groups(fp: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(uid, doc_id, keeper_uid, keeper_doc_id) of every row of a table of ``fingerprints``.

    Classes of equal check bits and groups are reduced by partial aggregation
    and joined back, so copies of one text never meet in one task.
    """
    texts = fp.filter("c0 is not null")
    roots = components(near_edges(texts, max_distance))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("first")
    classes = texts.groupBy("c0", "c1").agg(F.min("uid").alias("node"), least)
    classes = written(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    keepers = classes.groupBy("root").agg(F.min("first").alias("k"))
    named = classes.join(keepers, "root").select("c0", "c1", F.col("k.uid").alias("keeper_uid"), F.col("k.doc_id").alias("keeper_doc_id"))
    labelled = texts.select("uid", "doc_id", "c0", "c1").join(written(named, "keepers"), ["c0", "c1"]).drop("c0", "c1")
    alone = fp.filter("c0 is null").select("uid", "doc_id", F.col("uid").alias("keeper_uid"), F.col("doc_id").alias("keeper_doc_id"))
    return labelled.union(alone)


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, keeper_doc_id, keep): every row of ``docs``, with the document that stands for its group.

    Groups are the connected components of verified pairs; the least doc_id (of
    any type that has an order) stays, nulls come last, then the order of rows,
    so of repeated rows one stays.  Rows without words (null, empty, only
    punctuation) are compared with nothing and stay.  Texts of under MIN_WORDS
    words match those with the same words but for one left out or changed.
    Whole texts count, whatever their length.
    """
    rows = docs.select(row_id().alias("uid"), "doc_id", "text")
    groups = near_groups(fingerprints(rows, language_means(docs)), max_distance)
    return groups.select("doc_id", "keeper_doc_id", (F.col("keeper_uid") == F.col("uid")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they were.

    The rows are written once with their numbers and read from there ever after.
    """
    rows = numbered(docs)
    fp = fingerprints(rows.select("uid", "r.doc_id", "r.text"), language_means(rows.select("r.lang", "r.text")))
    gone = written(near_groups(fp, max_distance).filter("keeper_uid != uid").select("uid"), "gone")
    return rows.join(gone, "uid", "left_anti").select("r.*")
