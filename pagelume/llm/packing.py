"""Operator 1: packing related documents into training windows.

Documents get MinHash sketches of their 5-word shingles.  Documents that share
a sketch component are candidates; the nearest-neighbour graph links each to
those it shares most components with.  Within each connected block, paths
start at the unvisited document of the lowest degree and go on to the most
similar unvisited neighbour; windows are filled along the paths, one after
another, so only the last window of a group of blocks can be short.  Blocks are
formed by contracting the strongest edges first, up to a number of documents,
so that only the weakest edges of a larger block are cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelume.llm import textkit
from pagelume.llm.buckets import runs, spans
from pagelume.llm.graph import components
from pagelume.llm.storage import dropped, kind_of, row_id, written, written_by_batches

SHINGLE = 5
COMPONENTS = 16
#: Neighbours of a document in the graph.
NEIGHBOURS = 8
#: Words in a window.
WINDOW = 2048
#: Words packed by one group of blocks.
GROUP_WORDS = 2_000_000
#: Documents in a block; connected ones beyond it are parted at their weakest edges.
BLOCK_DOCUMENTS = 20_000
#: Edges between units that one task contracts in order; more are contracted in rounds first.
LOCAL_EDGES = 500_000
#: Rows of a bucket that are compared all with all; larger ones are parted.
DENSE = 512

_MULTIPLIERS = (textkit.mix64(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


def sketch(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x COMPONENTS uint32, words per row); rows without words have a sketch of ones."""
    out, cnt = [], []
    for _, h, off, _ in textkit.words(col):
        g, goff = textkit.shingles(h, off, SHINGLE)
        full = np.flatnonzero(np.diff(goff) > 0)
        s = np.full((len(off) - 1, COMPONENTS), 0xFFFFFFFF, np.uint32)
        if len(full):
            for i, m in enumerate(_MULTIPLIERS):
                s[full, i] = np.minimum.reduceat(g * m, goff[full]) >> np.uint64(32)
        out.append(s)
        cnt.append(np.diff(off))
    if not out:
        return np.zeros((0, COMPONENTS), np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(cnt)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, n = sketch(batch.column("text"))
        keep = pa.array(n > 0)
        raw = np.ascontiguousarray(s).tobytes()
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COMPONENTS), len(s), [None, pa.py_buffer(raw)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(n.astype(np.int64)), rows], names=["uid", "doc_id", "n", "sketch"]).filter(keep)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COMPONENTS)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s = _matrix(pa.chunked_array([batch.column("sketch")])).astype(np.int64)
        key = (np.arange(COMPONENTS, dtype=np.int64) << 32) + s
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), COMPONENTS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], names=["k", "node"])


def _compare(node: np.ndarray, s: np.ndarray, k: int, out: list) -> None:
    """Append (a, b, equal components) arrays with the k best partners of each row."""
    n = len(node)
    if n < 2:
        return
    sim = (s[:, None, :] == s[None, :, :]).sum(axis=2, dtype=np.int32)
    me = np.arange(n)
    sim[me, me] = -1
    m = min(k, n - 1)
    score = me - sim * n
    best = np.argpartition(score, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(score, axis=1)[:, :m]
    out.append((np.repeat(node, m), node[best.ravel()], np.take_along_axis(sim, best, axis=1).ravel()))


def _best(out: list, k: int) -> pa.Table | None:
    """(a, b, sim) of the k best partners of each row in what ``_compare`` appended."""
    if not out:
        return None
    a, b, sim = (np.concatenate(x) for x in zip(*out))
    best = np.lexsort((b, -sim.astype(np.int64), a))
    a, b, sim = a[best], b[best], sim[best]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, sim = a[new], b[new], sim[new]
    begin, end = spans(a)
    first = np.arange(len(a)) - np.repeat(begin, end - begin) < k
    return pa.table({"a": a[first], "b": b[first], "sim": sim[first].astype(np.int32)})


def _in_buckets(k: int):
    """Partners within each bucket (k, node, sketch), all with all; the batches are sorted by k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "k", 1 << 16):
            key, node, s = table.column("k").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("sketch"))
            out: list = []
            for x, y in zip(*spans(key)):
                _compare(node[x:y], s[x:y], k, out)
            found = _best(out, k)
            if found:
                yield from found.to_batches(max_chunksize=1 << 16)

    return run


def _with_heads(k: int):
    """Partners of each row (node, sketch) among the ``heads`` of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("heads")
            count, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            me = np.repeat(np.arange(batch.num_rows), count)
            a, b = batch.column("node").to_numpy(zero_copy_only=False)[me], flat.field("node").to_numpy(zero_copy_only=False)
            sim = (_matrix(pa.chunked_array([batch.column("sketch")]))[me] == _matrix(pa.chunked_array([flat.field("sketch")]))).sum(axis=1, dtype=np.int32)
            other = a != b
            found = _best([(a[other], b[other], sim[other])], k)
            yield from found.to_batches(max_chunksize=1 << 16)

    return run


PAIRS = "a bigint, b bigint, sim int"
KIDS = "parent bigint, k bigint, node bigint, sketch binary, hot int, reach int, tau int"


def _kids(depth: int):
    """The buckets into which those of ``depth`` components (id, last, node, sketch, hot, tau) part by one more, a later one.

    ``hot`` are the components whose buckets on level 1 are large, ``reach``
    the number of components that a row can share with others below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            last, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "hot"))
            c = np.arange(COMPONENTS)
            may = ((hot[:, None] >> c) & 1 == 1) & (c > last[:, None])
            after = may.sum(axis=1)[:, None] - may.cumsum(axis=1)
            row, c = np.nonzero(may)
            s = _matrix(pa.chunked_array([batch.column("sketch")])).astype(np.int64)
            kids = {x: batch.column(x).take(pa.array(row)) for x in ("node", "sketch", "hot", "tau")}
            kids |= {"parent": batch.column("id").take(pa.array(row)), "k": pa.array((c << 32) + s[row, c]), "reach": pa.array((depth + 1 + after[row, c]).astype(np.int32))}
            names = [x.split()[0] for x in KIDS.split(", ")]
            yield from pa.table({x: kids[x] for x in names}).to_batches(max_chunksize=1 << 14)

    return run


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """The k best partners of each a; ties go to the lower name."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return near.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _all_with_all(buckets: DataFrame, k: int) -> DataFrame:
    """Partners within buckets (k, node, sketch) of up to DENSE rows."""
    return buckets.select("k", "node", "sketch").repartition("k").sortWithinPartitions("k", "node").mapInArrow(_in_buckets(k), PAIRS)


def _in_large(members: DataFrame, won: DataFrame, k: int) -> DataFrame:
    """The k best of ``won`` and of what ``members`` (id, last, node, sketch) of buckets above DENSE have in common.

    A bucket holds the classes that agree on some components.  Let a class and
    one of its k best partners agree on the components T, all of them with
    large buckets (or they have met in a small one), and follow T from bucket
    to bucket in order of the components.  If one on this way is of DENSE
    classes at most, they meet there.  Else they are both in the bucket of T;
    as all in it are partners as good as this one or better, and ties go to the
    lower name, it is one of the k + 1 lowest names there, its heads.  So heads
    on every level and all with all in small buckets find every partner, and no
    large bucket meets in a task.  A class goes on only where it can still share
    as many components with another as with its k-th partner so far, or where
    one that can do so may need it.
    """
    bits = members.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1, last)")).alias("hot"))
    now, depth, met = written(members.join(bits, "node"), "large-buckets"), 1, None
    while True:
        order = F.row_number().over(Window.partitionBy("id").orderBy("node"))
        heads = now.select("id", "node", "sketch").withColumn("at", order).filter(F.col("at") <= k + 1).groupBy("id").agg(F.collect_list(F.struct("node", "sketch")).alias("heads"))
        pairs = now.join(heads, "id").select("node", "sketch", "heads").mapInArrow(_with_heads(k), PAIRS)
        before, won = won, written(_ranked(won.union(pairs if met is None else pairs.union(met)), k), "partners")
        dropped(before)
        tau = won.groupBy("a").agg(F.count("*").alias("have"), F.min("sim").alias("tau")).filter(F.col("have") == k).select(F.col("a").alias("node"), "tau")
        rows = now.join(tau, "node", "left").withColumn("tau", F.coalesce("tau", F.lit(1))).select("id", "last", "node", "sketch", "hot", "tau")
        kids = written(rows.mapInArrow(_kids(depth), KIDS), "parted-buckets")
        need = F.min(F.when(F.col("reach") >= F.col("tau"), F.col("tau")))
        sizes = kids.groupBy("parent", "k").agg(F.count("*").alias("m"), need.alias("need")).filter("m > 1 and need is not null")
        sizes = written(sizes.withColumn("id", row_id()), "parted-sizes")
        held = kids.join(sizes, ["parent", "k"]).filter("reach >= need")
        met = _all_with_all(held.filter(F.col("m") <= DENSE).select(F.col("id").alias("k"), "node", "sketch"), k)
        now = held.filter(F.col("m") > DENSE).select("id", F.shiftright("k", 32).cast("int").alias("last"), "node", "sketch", "hot")
        if sizes.filter(F.col("m") > DENSE).isEmpty():
            return _ranked(won.union(met), k)
        now, depth = written(now, "large-buckets"), depth + 1


def neighbours(classes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, sim): for every class (node, sketch) of equal sketches its k nearest others, by components they share.

    Classes that share a component meet in its bucket.  Buckets of up to DENSE
    classes are compared all with all.  Larger ones are parted by further
    components until what is left is small, see ``_in_large``; no partner is
    lost.  Ties go to the lower name.
    """
    slots = written(classes.select("node", "sketch").mapInArrow(_slots, "k bigint, node bigint"), "slots")
    sizes = written(slots.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1"), "slot-sizes")
    held = slots.join(sizes, "k").join(classes.select("node", "sketch"), "node")
    near = _all_with_all(held.filter(F.col("m") <= DENSE), k)
    if sizes.filter(F.col("m") > DENSE).isEmpty():
        return _ranked(near, k)
    near = written(_ranked(near, k), "partners")
    members = written(held.filter(F.col("m") > DENSE).select(F.col("k").alias("id"), F.shiftright("k", 32).cast("int").alias("last"), "node", "sketch"), "large-buckets")
    large = written(members.select(F.col("node").alias("a")).distinct(), "large-nodes")
    won = written(near.join(large, "a", "left_semi"), "partners")
    return near.join(large, "a", "left_anti").union(_in_large(members, won, k))


def _in_order(bound: int):
    """Contract edges (a, b, sim, na, nb) one by one, the strongest first, where both ends have ``bound`` documents at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        a, b, sim, na, nb = (table.column(c).to_numpy() for c in ("a", "b", "sim", "na", "nb"))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sizes = np.zeros(len(names), np.int64)
        sizes[at] = np.concatenate([na, nb])
        tie = textkit.mix64(a.astype(np.uint64) ^ textkit.mix64(b.astype(np.uint64)))
        order = np.lexsort((b, a, tie, -sim.astype(np.int64)))
        size, up = sizes.tolist(), list(range(len(names)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(at[: len(a)][order].tolist(), at[len(a) :][order].tolist()):
            x, y = top(x), top(y)
            if x != y and size[x] + size[y] <= bound:
                if size[x] < size[y]:
                    x, y = y, x
                up[y] = x
                size[x] += size[y]
        roots = names[[top(x) for x in range(len(names))]]
        yield from pa.table({"node": names, "root": roots}).to_batches(max_chunksize=1 << 16)

    return run


def _round(fit: DataFrame, bound: int, n: int) -> DataFrame:
    """(node, root) of one round: pairs that are each other's strongest, and what is next to them while it fits."""
    both = fit.union(fit.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", F.col("nb").alias("na"), F.col("na").alias("nb")))
    tie = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(n))
    pick = written(both.groupBy("a", "na").agg(F.max(F.struct("sim", tie.alias("tie"), "b", "nb")).alias("m")).select("a", "na", "m.*"), "picks")
    back = pick.select(F.col("a").alias("b"), F.col("b").alias("back"))
    pair = pick.join(back, "b").filter("back = a").select(F.col("a").alias("node"), F.least("a", "b").alias("root"), (F.col("na") + F.col("nb")).alias("total"))
    after = pick.join(pair.withColumnRenamed("node", "b"), "b").join(pair.select(F.col("node").alias("a")), "a", "left_anti")
    run = F.sum("na").over(Window.partitionBy("root").orderBy(F.desc("sim"), F.desc("tie"), "a").rowsBetween(Window.unboundedPreceding, 0))
    after = after.withColumn("run", run).filter(F.col("total") + F.col("run") <= bound)
    link = written(pair.select("node", "root").union(after.select(F.col("a").alias("node"), "root")), "links")
    dropped(pick)
    return link


def units(sizes: DataFrame, edges: DataFrame, bound: int) -> DataFrame:
    """(node, unit) of every row of ``sizes`` (node, size): connected units of ``bound`` documents at most.

    Edges (a, b, sim) are contracted from the strongest down; one is cut only
    where its ends have grown beyond the bound together, so nodes joined by
    stronger edges are together already.  A node over the bound stays alone.
    """
    key = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = edges.filter("a != b").groupBy(*key).agg(F.max("sim").alias("sim"))
    size, links = sizes.select("node", "size"), []
    while True:
        na, nb = (size.select(F.col("node").alias(c), F.col("size").alias("n" + c)) for c in ("a", "b"))
        fit = written(now.join(na, "a").join(nb, "b").filter(F.col("na") + F.col("nb") <= bound).select("a", "b", "sim", "na", "nb"), "fitting")
        if fit.count() <= LOCAL_EDGES:
            break
        link = _round(fit, bound, len(links))
        links.append(link)
        moved = size.join(link, "node", "left").groupBy(F.coalesce("root", "node").alias("node")).agg(F.sum("size").alias("size"))
        size = written(moved, "sizes")
        ends = fit.select("a", "b", "sim")
        for c in ("a", "b"):
            ends = ends.join(link.select(F.col("node").alias(c), F.col("root").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        now = ends.filter("a != b").groupBy(*key).agg(F.max("sim").alias("sim"))
    links.append(written(fit.repartition(1).mapInArrow(_in_order(bound), "node bigint, root bigint"), "links"))
    out = sizes.select("node", F.col("node").alias("unit"))
    for link in links:
        out = out.join(link.withColumnRenamed("node", "unit"), "unit", "left").select("node", F.coalesce("root", "unit").alias("unit"))
    return out


def walk(nodes: list[int], edges: list[tuple[int, int, int]]) -> list[int]:
    """Order of ``nodes`` along greedy paths over undirected ``edges`` (a, b, sim).

    A path starts at the unvisited node of the lowest degree (then the lowest
    name) and steps to the most similar unvisited neighbour (then the one of
    the lowest degree, then name) until there is none.
    """
    near: dict[int, dict[int, int]] = {n: {} for n in nodes}
    for a, b, sim in edges:
        if a in near and b in near and a != b:
            near[a][b] = near[b][a] = sim
    starts = [(len(x), n) for n, x in near.items()]
    heapq.heapify(starts)
    seen: set[int] = set()
    out = []
    while starts:
        _, n = heapq.heappop(starts)
        while n is not None and n not in seen:
            seen.add(n)
            out.append(n)
            ahead = [(-sim, len(near[m]), m) for m, sim in near[n].items() if m not in seen]
            n = min(ahead)[2] if ahead else None
    return out


def _pack(window: int):
    def run(docs: pa.Table, edges: pa.Table) -> pa.Table:
        group = docs.column("grp")[0].as_py() if docs.num_rows else 0
        node, block, copy = (docs.column(c).to_numpy() for c in ("node", "block", "copy"))
        uid, n = docs.column("uid").to_numpy(), docs.column("n").to_numpy()
        names = np.unique(node)
        home = dict(zip(node.tolist(), block.tolist()))
        links = [e for e in zip(*(edges.column(c).to_pylist() for c in ("a", "b", "sim"))) if home.get(e[0]) == home.get(e[1])]
        place: dict[int, int] = {}
        by_block: dict[int, list[int]] = {}
        for x in names.tolist():
            by_block.setdefault(home[x], []).append(x)
        inside: dict[int, list] = {}
        for e in links:
            inside.setdefault(home[e[0]], []).append(e)
        for b in sorted(by_block):
            for x in walk(by_block[b], inside.get(b, [])):
                place[x] = len(place)
        at = np.array([place[x] for x in node.tolist()], np.int64)
        order = np.lexsort((uid, at, copy))
        n = n[order]
        end = np.cumsum(n)
        begin = end - n
        first, last = begin // window, (end - 1) // window
        pieces = last - first + 1
        row = np.repeat(np.arange(len(n)), pieces)
        win = np.repeat(first, pieces) + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi = np.maximum(begin[row], win * window), np.minimum(end[row], (win + 1) * window)
        doc_id = docs.column("doc_id").take(pa.array(order[row]))
        return pa.table(
            {
                "window_id": pa.array((np.int64(group) << 32) + win),
                "at": pa.array(lo - win * window),
                "doc_id": doc_id,
                "start": pa.array(lo - begin[row]),
                "n_words": pa.array(hi - lo),
            }
        )

    return run


def classes_of(sketches: DataFrame) -> DataFrame:
    """(node, sketch, size) of the classes of equal sketches, named by their least uid; written once."""
    return written(sketches.groupBy("sketch").agg(F.min("uid").alias("node"), F.count("*").alias("size")), "classes")


def _members(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, doc_id, n, node): every row with its class, where a class over half a block is parted in classes of its own by uid."""
    rows = sketches.join(classes, "sketch").select("uid", "doc_id", "n", "node", "size")
    part = F.pmod(F.xxhash64("uid"), F.ceil(2 * F.col("size") / BLOCK_DOCUMENTS))
    rows = written(rows.select("uid", "doc_id", "n", "node", F.when(F.col("size") > BLOCK_DOCUMENTS // 2, part).alias("part")), "members")
    named = written(rows.filter("part is not null").groupBy("node", "part").agg(F.min("uid").alias("own")), "parts")
    return rows.join(named, ["node", "part"], "left").select("uid", "doc_id", "n", F.coalesce("own", "node").alias("node"))


#: Repeated rows that are ranked in one task.
RANKED = 10_000


def _passes(rows: DataFrame) -> DataFrame:
    """``rows`` with copy, the rank of a row by uid among those of its node and doc_id, without a task for a whole group."""
    many = written(rows.groupBy("node", "doc_id").agg(F.count("*").alias("m")).filter("m > 1"), "repeated")
    same = (F.col("r.node") == F.col("m.node")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id"))
    once = rows.alias("r").join(many.alias("m"), same, "left_anti").withColumn("copy", F.lit(1).cast("bigint"))
    chunk = F.pmod(F.xxhash64("uid"), F.ceil(F.col("m.m") / RANKED)).alias("chunk")
    rest = written(rows.alias("r").join(many.alias("m"), same).select("r.*", chunk), "repeated-rows")
    counts = rest.groupBy("node", "doc_id", "chunk").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("node", "doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select("node", "doc_id", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("node", "doc_id", "chunk").orderBy("uid"))
    ranked = rest.withColumn("inside", inside)
    key = (F.col("r.node") == F.col("o.node")) & F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.chunk") == F.col("o.chunk"))
    both = ranked.alias("r").join(offset.alias("o"), key)
    return once.union(both.select(*[f"r.{c}" for c in rows.columns], (F.col("before") + F.col("inside")).alias("copy")))


def pack(docs: DataFrame, window: int = WINDOW, k: int = NEIGHBOURS) -> DataFrame:
    """(window_id, at, doc_id, start, n_words): windows of ``window`` words, filled with parts of documents.

    A row puts n_words words of a document, from its word ``start``, at word
    ``at`` of a window.  Every word of every row is placed once; a document
    longer than a window goes on in the next.  Rows without words (null, empty,
    only punctuation) aren't placed.  Repeated rows of a doc_id (of any type)
    and sketch are laid out in passes of their own over the same paths, so that
    copies don't share a window needlessly; null doc_ids are placed like
    others.  An empty table gives no windows.
    """
    base = docs.select(row_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = kind_of(docs, "doc_id")
    sketches = written_by_batches(base.mapInArrow(_sketches, f"uid bigint, doc_id {kind}, n bigint, sketch binary"), "sketches")
    classes = classes_of(sketches)
    edges = written(neighbours(classes, k), "neighbours")
    roots = components(edges)
    words = sketches.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-words // GROUP_WORDS))
    rows = written(_members(sketches, classes), "rows")
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"))
    nodes = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    over = written(nodes.groupBy("root").agg(F.sum("size").alias("total")).filter(F.col("total") > BLOCK_DOCUMENTS).select("root"), "large-roots")
    large = written(nodes.join(over, "root", "left_semi").select("node", "size"), "large")
    unit = units(large, edges.join(large.select(F.col("node").alias("a")), "a", "left_semi"), BLOCK_DOCUMENTS)
    block = F.coalesce("unit", "root")
    home = written(nodes.join(unit, "node", "left").select("node", block.alias("block"), F.pmod(F.xxhash64(block), F.lit(groups)).cast("int").alias("grp")), "homes")
    rows = _passes(rows).join(home, "node")
    of = home.select(F.col("node").alias("a"), F.col("grp").alias("g"), "block")
    inner = edges.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("block").alias("other")), "b").filter("block = other").select("g", "a", "b", "sim")
    kinds = f"window_id bigint, at bigint, doc_id {kind}, start bigint, n_words bigint"
    return rows.groupBy("grp").cogroup(inner.groupBy("g")).applyInArrow(_pack(window), kinds)
