"""Rows brought together by key, a bounded number of them in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that ``runs`` gives at once, if no key alone has more.
RUN_ROWS = 1 << 18


def spans(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each run of equal keys."""
    if not len(sorted_key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    return begin, np.append(begin[1:], len(sorted_key))


def runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = RUN_ROWS) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], "left"))
        if held and n >= rows:
            before = held[-1].column(key)[-1].as_py()
            cut = int(np.searchsorted(k, before, "right"))
            if cut < len(k):
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held, n = [batch.slice(last)], batch.num_rows - last
                continue
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
