"""Operator 6: passages that occur more than once, by a run-length text index.

Two occurrences of the same ``min_words`` words pick the same minimizer, so
only stretches around minimizers that occur twice can hold a repeat; they are
cut out and brought together by minimizer.  Over the stretches of each shard a
suffix array is built and reduced to its run-length form: the runs of the
Burrows-Wheeler transform, with the text position and the length of the match
with its neighbour sampled at the ends of runs.  Between samples these lengths
fall by one per word, so the matching statistics of every position (the
longest match that starts there and occurs elsewhere) are streamed from the
samples alone.  Positions whose match is long enough are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelume.llm import textkit
from pagelume.llm.storage import dropped, row_id, written, written_by_batches

#: Words of the shortest passage that is marked.
MIN_WORDS = 50
#: Words of a minimizer.
GRAM = 8
#: Distinct stretches in a shard, at most on average.
SHARD_PIECES = 10_000
#: Pieces whose words a task remembers to have given.
GIVEN = 1 << 18
#: Occurrences from which a minimizer's windows are counted by their hashes instead of meeting in a shard.
HOT_OCCURRENCES = 50_000


# --- minimizers -----------------------------------------------------------


def minimizers(h: np.ndarray, off: np.ndarray, length: int, q: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``h``, hashes) of the least q-gram, the leftmost of equals, of every window of ``length`` words of a row."""
    m = len(h) - q + 1
    windows = len(h) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for i in range(q):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
    g = textkit.mix64(g)
    least = (g & ~np.uint64((1 << 28) - 1)) | np.arange(m, dtype=np.uint64)
    span, have = length - q + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    begin = np.repeat(off[:-1], np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    whole = np.arange(windows) + length <= end[:windows]
    at = np.unique((least[:windows][whole] & np.uint64((1 << 28) - 1)).astype(np.int64))
    del begin
    return at, g[at].view(np.int64)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for row, h, off, _ in textkit.words(batch.column("text")):
                at, g = minimizers(h, off, length)
                r = np.searchsorted(off, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(uid[row + r]), pa.array((at - off[r]).astype(np.int64))], names=["g", "uid", "pos"])

    return run


PIECES = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("words", pa.binary())])


def windows_around(words: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, two hashes) of all windows of ``length`` words that hold one of the minimizers at ``pos``."""
    n = len(words) - length + 1
    starts = np.unique((pos[:, None] - np.arange(length - GRAM + 1)).ravel())
    starts = starts[(starts >= 0) & (starts < n)]
    out = []
    for fold in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)):
        acc = np.zeros(max(n, 0), np.uint64)
        for i in range(length):
            acc = acc * fold + words[i : i + len(acc)]
        out.append(textkit.mix64(acc[starts]).view(np.int64))
    return starts, out[0], out[1]


def _pieces(length: int):
    """Stretches around the repeated minimizers of each document, joined where they overlap within a shard, with two hashes of their words.

    A copy of what a task has given in the same shard goes without its words.
    Minimizers of shard -1 give a row for each window around them instead, without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            lists = batch.column("anchors")
            aoff, flat = lists.offsets.to_numpy(), lists.flatten()
            shard, pos = flat.field("shard").to_numpy(zero_copy_only=False), flat.field("pos").to_numpy(zero_copy_only=False)
            aoff = aoff - aoff[0]
            for row, h, off, _ in textkit.words(batch.column("text")):
                w = (h >> np.uint64(32)).astype(np.uint32)
                out: dict = {k: [] for k in PIECES.names}
                for r in range(len(off) - 1):
                    a = slice(aoff[row + r], aoff[row + r + 1])
                    if a.start == a.stop:
                        continue
                    hot = shard[a] < 0
                    if hot.any():
                        at, x, y = windows_around(h[off[r] : off[r + 1]], pos[a][hot], length)
                        out["shard"] += [-1] * len(at)
                        out["uid"] += [int(uid[row + r])] * len(at)
                        for k, v in (("start", at), ("p", x), ("q", y)):
                            out[k] += v.tolist()
                        out["words"] += [None] * len(at)
                    order = np.lexsort((pos[a][~hot], shard[a][~hot]))
                    sh, p = shard[a][~hot][order], pos[a][~hot][order]
                    if not len(p):
                        continue
                    lo, hi = np.maximum(p - (length - GRAM), 0), np.minimum(p + length, off[r + 1] - off[r])
                    new = np.ones(len(p), bool)
                    new[1:] = (sh[1:] != sh[:-1]) | (lo[1:] > hi[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(p)) - 1
                    for f, e in zip(first, last):
                        raw = w[off[r] + lo[f] : off[r] + hi[e]].tobytes()
                        digest = xxhash.xxh3_128_intdigest(raw)
                        out["shard"].append(int(sh[f]))
                        out["uid"].append(int(uid[row + r]))
                        out["start"].append(int(lo[f]))
                        out["p"].append((digest >> 64) - (1 << 63))
                        out["q"].append((digest & (1 << 64) - 1) - (1 << 63))
                        known = (int(sh[f]), digest) in given
                        out["words"].append(None if known else raw)
                        if not known:
                            if len(given) >= GIVEN:
                                given.clear()
                            given.add((int(sh[f]), digest))
                yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    return run


# --- the index ------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until they are distinct."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, k, n = [rank.astype(np.int32)], 1, len(text)
    while n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        k *= 2
    return levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j have in common from their starts."""
    n = len(levels[0])
    i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[level][i[inside]] == levels[level][j[inside]]
        step = np.where(same, 1 << level, 0)
        i, j, out = i + step, j + step, out + step
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of ``text`` with samples at the ends of its runs."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        levels = suffix_ranks(text)
        sa = np.empty(n, np.int64)
        sa[levels[-1]] = np.arange(n)
        bwt = np.where(sa > 0, levels[0][sa - 1].astype(np.int64), -1)
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        tail = np.append(head[1:], True)[:n]
        self.n = n
        self.runs = bwt[head]
        self.lengths = np.diff(np.append(np.flatnonzero(head), n))
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
        self.before = self._sample(sa, levels, heads, -1)
        self.after = self._sample(sa, levels, tails, 1)

    @staticmethod
    def _sample(sa: np.ndarray, levels: list[np.ndarray], ranks: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(text positions in order, words in common with the next suffix in direction ``step``)."""
        inside = (ranks + step >= 0) & (ranks + step < len(sa))
        length = np.zeros(len(ranks), np.int64)
        length[inside] = common(levels, sa[ranks[inside]], sa[ranks[inside] + step])
        order = np.argsort(sa[ranks])
        return sa[ranks][order], length[order]

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match with another position."""
        at = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for position, length in (self.before, self.after):
            if len(position):
                s = np.searchsorted(position, at, "right") - 1
                best = np.maximum(best, length[s] - (at - position[s]))
        return best


def repeats(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each of the distinct texts, which words lie in a run of ``length`` or more that occurs elsewhere."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    whole = np.empty(begin[-1], np.int64)
    for b, t in zip(begin, texts):
        whole[b : b + len(t)] = t
    whole[begin[1:] - 1] = (1 << 40) + np.arange(len(texts))
    ms = RunIndex(whole).matching_statistics()
    delta = np.zeros(len(whole) + 1, np.int64)
    hit = np.flatnonzero(ms >= length)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + ms[hit], -1)
    marked = np.cumsum(delta[:-1]) > 0
    return [marked[b : b + n] for b, n in zip(begin, sizes)]


def _mark_shard(length: int):
    """(shard, p, q, s, e): what is marked in each distinct piece of a shard; ``copies`` says how often it occurs."""

    def run(table: pa.Table) -> pa.Table:
        texts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("words").to_pylist()]
        copies = table.column("copies").to_numpy()
        begins, ends, of = [], [], []
        for i, (t, c, m) in enumerate(zip(texts, copies, repeats(texts, length))):
            if c > 1 and len(t) >= length:
                m = np.ones(len(t), bool)
            edge = np.diff(np.concatenate([[0], m.view(np.int8), [0]]))
            begins.append(np.flatnonzero(edge == 1))
            ends.append(np.flatnonzero(edge == -1))
            of.append(np.full(len(begins[-1]), i))
        row = pa.array(np.concatenate(of) if of else np.zeros(0, np.int64))
        marked = {k: table.column(k).take(row) for k in ("shard", "p", "q")}
        for k, v in (("s", begins), ("e", ends)):
            marked[k] = pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))
        return pa.table(marked)

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the stretches of every row of ``docs`` that occur elsewhere.

    A word is in a stretch if it lies in ``min_words`` or more words in a row
    that occur at another place too, in another row or the same; repeated rows
    and copies therefore mark each other.  Words are compared in lower case,
    without what separates them.  Rows of fewer words (null, empty) have no
    stretches; texts are read whole.  The end is exclusive.

    The rows are written once with their numbers.  Each task gives the words of
    equal pieces once, and pieces go to their shard once, where copies are
    counted before its index is built.  The occurrences of a minimizer of more than
    HOT_OCCURRENCES never meet: all windows around them are counted by a hash
    of 128 bits, which marks the same words.
    """
    base = written(docs.select(row_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text")), "rows")
    anchors = written_by_batches(base.select("uid", "text").mapInArrow(_anchors(min_words), "g bigint, uid bigint, pos bigint"), "anchors")
    often = written(anchors.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-minimizers")
    total = often.agg(F.sum(F.when(F.col("n") <= HOT_OCCURRENCES, F.col("n")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_PIECES))
    shard = F.when(F.col("n") > HOT_OCCURRENCES, -1).otherwise(F.pmod(F.xxhash64("g"), F.lit(shards))).cast("int").alias("shard")
    per = anchors.join(often, "g").groupBy("uid").agg(F.collect_list(F.struct(shard, "pos")).alias("anchors"))
    kinds = "shard int, uid bigint, start bigint, p bigint, q bigint, words binary"
    pieces = written_by_batches(base.select("uid", "text").join(per, "uid").mapInArrow(_pieces(min_words), kinds), "pieces")
    dropped(anchors)
    shared = pieces.filter("shard >= 0").repartition("shard")
    distinct = shared.groupBy("shard", "p", "q").agg(F.count("*").alias("copies"), F.first("words", ignorenulls=True).alias("words"))
    marks = written(distinct.groupBy("shard").applyInArrow(_mark_shard(min_words), "shard int, p bigint, q bigint, s bigint, e bigint"), "marks")
    placed = pieces.filter("shard >= 0").drop("words").join(marks, ["shard", "p", "q"]).select("uid", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    hot = pieces.filter("shard < 0").select("uid", "start", "p", "q")
    twice = hot.groupBy("p", "q").count().filter("count > 1")
    placed = placed.union(hot.join(twice, ["p", "q"]).select("uid", "start", F.col("start") + min_words))
    order = Window.partitionBy("uid").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = placed.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("uid", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return base.select("uid", "doc_id").join(merged, "uid").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
