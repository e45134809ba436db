"""Operator 3: exact duplicates against a minimal perfect hash of earlier digests.

Documents arrive in order of doc_id.  The earlier part of the table is history:
its distinct SHA-256 digests are cut into buckets, and each bucket gets a
minimal perfect hash (levels of collision-free bits, ranked) whose slots hold
the full digest and the winner's locator.  The distinct digests of the rest are
looked up; a slot answers only if all 32 bytes agree, so a nonmember that
hashes to some slot is never taken for a repeat.  Nonmembers are grouped among
themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pagelume.llm.storage import kind_of, numbered, row_id, written
from pagelume.llm.textkit import mix64

#: Digests in a bucket, on average.
BUCKET_DIGESTS = 50_000
#: Bits a level spends per digest that reaches it.
GAMMA = 2.0


def _hashes(digests: np.ndarray, level: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return mix64(digests[:, level % 4] ^ mix64(digests[:, (level + 1) % 4] + seed))


def build(digests: np.ndarray, gamma: float = GAMMA) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Minimal perfect hash of distinct digests (n x 4 uint64): (slot of each, bits per level, all bits)."""
    left = np.arange(len(digests))
    level, sizes, bits = 0, [], []
    at = np.zeros(len(digests), np.int64)
    base = 0
    while len(left):
        m = max(64, int(len(left) * gamma))
        pos = (_hashes(digests[left], level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(pos, minlength=m) == 1
        won = alone[pos]
        at[left[won]] = base + pos[won]
        bits.append(alone)
        sizes.append(m)
        base += m
        left = left[~won]
        level += 1
        if level > 400:
            raise ValueError("digests aren't distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - 1
    return rank[at], sizes, flat


def lookup(digests: np.ndarray, sizes: list[int], flat: np.ndarray) -> np.ndarray:
    """Slot to compare for each digest; -1 where no level has a bit for it."""
    rank = np.cumsum(flat) - 1
    slot = np.full(len(digests), -1, np.int64)
    left, base = np.arange(len(digests)), 0
    for level, m in enumerate(sizes):
        if not len(left):
            break
        pos = base + (_hashes(digests[left], level) % np.uint64(m)).astype(np.int64)
        hit = flat[pos]
        slot[left[hit]] = rank[pos[hit]]
        left = left[~hit]
        base += m
    return slot


def _as_words(col: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as n x 4 numbers, straight from the buffer."""
    a = col.cast(pa.binary()).combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    if not len(a):
        return np.zeros((0, 4), np.uint64)
    return np.frombuffer(a.buffers()[2], np.uint64, 4 * len(a), np.frombuffer(a.buffers()[1], np.int32)[a.offset]).reshape(-1, 4)


def _build_bucket(table: pa.Table) -> pa.Table:
    digests = _as_words(table.column("digest"))
    slot, sizes, flat = build(digests)
    order = np.argsort(slot)
    ids = table.column("doc_id").take(pa.array(order)).combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "size": pa.array([len(digests)], pa.int64()),
            "bits": pa.array([sizes], pa.list_(pa.int64())),
            "levels": pa.array([np.packbits(flat).tobytes()]),
            "digests": pa.array([digests[order].tobytes()]),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "uids": pa.array([table.column("uid").to_numpy()[order].astype(np.int64).tobytes()]),
        }
    )


def _lookup_bucket(new: pa.Table, index: pa.Table) -> pa.Table:
    """Of each new digest the winner in its slot, if all bytes agree, else itself."""
    n = new.num_rows
    ids, uids = new.column("doc_id").combine_chunks(), new.column("uid").to_numpy().copy()
    member = np.zeros(n, bool)
    if n and index.num_rows:
        row = index.slice(0, 1)
        digests, kept = _as_words(new.column("digest")), np.frombuffer(row.column("digests")[0].as_py(), np.uint64).reshape(-1, 4)
        sizes = row.column("bits")[0].as_py()
        flat = np.unpackbits(np.frombuffer(row.column("levels")[0].as_py(), np.uint8))[: sum(sizes)].astype(bool)
        slot = lookup(digests, sizes, flat)
        member = slot >= 0
        member[member] = (kept[slot[member]] == digests[member]).all(axis=1)
        winners = row.column("doc_ids")[0].values.take(pa.array(np.where(member, slot, 0)))
        ids = pc.if_else(pa.array(member), winners, ids)
        uids[member] = np.frombuffer(row.column("uids")[0].as_py(), np.int64)[slot[member]]
    return pa.table({"digest": new.column("digest").cast(pa.binary()), "winner_doc_id": ids, "winner_uid": pa.array(uids, pa.int64()), "in_history": pa.array(member)})


def _order_key(df: DataFrame) -> Column:
    """A number that never falls as doc_id grows: the id itself, or the first bytes of one that isn't a number."""
    if isinstance(df.schema["doc_id"].dataType, NumericType):
        return F.col("doc_id").cast("double")
    head = F.rpad(F.hex(F.substring(F.col("doc_id").cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, doc_id, digest) of rows that have uid, doc_id and the text."""
    return docs.select("uid", "doc_id", F.unhex(F.sha2(F.col(text).cast("string"), 256)).alias("digest"))


def _first(rows: DataFrame, buckets: int) -> DataFrame:
    """Winner of each distinct digest: least doc_id, nulls last, then the order of rows."""
    least = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("w"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    return least.select(bucket.alias("bucket"), "digest", F.col("w.doc_id").alias("doc_id"), F.col("w.uid").alias("uid"))


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the distinct digests of ``rows`` (uid, doc_id, digest), written once."""
    block = f"bucket int, size bigint, bits array<bigint>, levels binary, digests binary, doc_ids array<{kind_of(rows, 'doc_id')}>, uids binary"
    return written(_first(rows, buckets).groupBy("bucket").applyInArrow(_build_bucket, block), "mph")


def winners(rows: DataFrame, history_share: float = 0.5) -> DataFrame:
    """(uid, doc_id, winner_uid, winner_doc_id) of every row of a written table (uid, doc_id, digest); a row without digest is its own winner."""
    keyed = rows.withColumn("at", _order_key(rows))
    low, high, n = keyed.agg(F.min("at"), F.max("at"), F.count("*")).first()
    edge = (low + (high - low) * history_share) if low is not None else 0.0
    texts = keyed.filter("digest is not null")
    earlier = F.coalesce(F.col("at") <= F.lit(float(edge)), F.lit(False))
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    index = build_index(texts.filter(earlier), buckets)
    new = _first(texts.filter(~earlier), buckets)
    kinds = f"digest binary, winner_doc_id {kind_of(rows, 'doc_id')}, winner_uid bigint, in_history boolean"
    found = new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_lookup_bucket, kinds)
    old = _first(texts.filter(earlier), buckets).select("digest", F.col("doc_id").alias("winner_doc_id"), F.col("uid").alias("winner_uid"))
    of_old = texts.filter(earlier).drop("at").join(old, "digest")
    of_new = texts.filter(~earlier).drop("at").join(found.drop("in_history"), "digest")
    first = of_old.union(of_new)
    none = rows.filter("digest is null").select("digest", "uid", "doc_id", F.col("doc_id").alias("winner_doc_id"), F.col("uid").alias("winner_uid"))
    return first.union(none).select("uid", "doc_id", "winner_uid", "winner_doc_id")


def exact_duplicates(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """(doc_id, winner_doc_id, keep) of every row of ``docs``.

    Texts are equal if their bytes are.  The winner has the least doc_id (of
    any type that has an order); nulls come last, then the order of rows, so of
    repeated rows one stays.  An empty text is a text like any other; a null
    text equals nothing and stays.  ``history_share`` is the part of the doc_id
    range that counts as history; any value gives the same result.
    """
    rows = written(_digests(docs.select(row_id().alias("uid"), "doc_id", "text")), "digests")
    return winners(rows, history_share).select("doc_id", "winner_doc_id", (F.col("uid") == F.col("winner_uid")).alias("keep"))


def drop_exact_duplicates(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """``docs`` with one row per distinct text, all columns as they were.

    The rows are written once with their numbers, so what is decided of a
    number is decided of the same row however the table is split later.
    """
    rows = numbered(docs)
    digests = written(_digests(rows.select("uid", "r.doc_id", "r.text")), "digests")
    gone = written(winners(digests, history_share).filter("uid != winner_uid").select("uid"), "gone")
    return rows.join(gone, "uid", "left_anti").select("r.*")


def duplicates_sql(table: str = "documents") -> str:
    """The same as DuckDB SQL, for distinct doc_ids."""
    return (
        "select doc_id, case when text is null then doc_id else min(doc_id) over (partition by text) end as winner_doc_id, "
        f"text is null or doc_id = min(doc_id) over (partition by text) as keep from {table}"
    )
