"""Small helpers that run inside tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def kept(key: tuple, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks.

    Task functions travel by value, so their module globals live as long as one task only; the
    ``sys`` module lives as long as the worker. One object is kept at a time: workers outlive
    queries, and tables of steps that are done would add up.
    """
    store = sys.__dict__.setdefault("_swathe_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return what the worker's earlier tasks have freed to the system; otherwise its allocators keep
    it beside what this task and the executor's other processes need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000
           ) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each.

    A single longer value is a batch of its own. Bounds what a task holds besides its input.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def filesystem(uri: str):
    """File system and path of a folder or file on shared storage, as tasks see it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def seekable(uri: str):
    """A file for random access; memory-mapped where the storage is mounted."""
    from pyarrow import fs

    files, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else (
        files.open_input_file(path))
