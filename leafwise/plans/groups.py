"""Groups of rows inside an Arrow task."""

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for executors without this package


def runs_of(batches, keys: list[str]):
    """``(key, table)`` for each run of rows with equal keys, whatever batches they lie in.

    Rows come sorted by the keys, which are numbers. One group is held at a time.
    """
    open_key, open_parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for begin, end in zip(edges, edges[1:]):
            if open_parts and names[begin] != open_key:
                yield open_key, pa.Table.from_batches(open_parts)
                open_parts = []
            open_key = names[begin]
            open_parts.append(batch.slice(begin, end - begin))
    if open_parts:
        yield open_key, pa.Table.from_batches(open_parts)


def ranges(begins, ends):
    """All numbers of the ranges ``[begin, end)``, one range after the other, and the range of each."""
    sizes = ends - begins
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes), owner


def giving_back(rows):
    """``rows``, after which the task gives freed memory back to the system, as its worker stays for others."""
    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)
