"""Arrow row mappers over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioframe.shipping import ship
from folioframe.storage import discard, shared_dir, staged

__all__ = ["Words", "discard", "held", "map_rows", "shared_dir", "staged", "sub_batches", "sub_ranges"]

#: Texts handled at once inside a mapper; bounds a worker's memory with long documents.
BATCH_CHARS = 4_000_000

_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks of one kind: tables, models, word memories.

    Workers are reused; what another kind of task has left is dropped first.
    """
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


class Words(dict):
    """A memory of words that starts afresh beyond ``limit`` bytes of words and entries."""

    #: Bytes of a dict entry and a string's or a value's head, about.
    ENTRY = 160

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.used = limit, 0

    def cost(self, words) -> int:
        return self.ENTRY * len(words) + sum(map(len, words))

    def full(self, words) -> bool:
        """Whether the memory must start afresh to take these words too."""
        return self.used + self.cost(words) > self.limit

    def missing(self, words) -> list:
        """Those of ``words`` (all different) to learn; all of them if the memory starts afresh."""
        new = [w for w in words if w not in self]
        if self.full(new):
            self.clear()
            new = list(words)
        self.used += self.cost(new)
        return new

    def clear(self) -> None:
        super().clear()
        self.used = 0


def sub_ranges(batch: pa.RecordBatch, text_col: int, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Slices ``[lo, hi)`` of a record batch whose texts hold about ``limit`` bytes at most."""
    lo, n = 0, batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    while lo < n:
        hi, size = lo, 0
        while hi < n and (hi == lo or size + sizes[hi] <= limit):
            size += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def sub_batches(batch: pa.RecordBatch, text_col: int, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """The same slices with their texts; null texts are empty."""
    for lo, hi in sub_ranges(batch, text_col, limit):
        yield lo, hi, [t or "" for t in batch.column(text_col).slice(lo, hi - lo).to_pylist()]


def map_rows(
    df: DataFrame,
    text_col: int,
    out_fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    keep: list[str] | None = None,
    where: Callable[[list[pa.Array]], pa.Array] | None = None,
) -> DataFrame:
    """Append columns computed from the whole texts of column number ``text_col``.

    ``make()`` runs once in a task and returns the batch function, so models and caches
    live as long as the task. ``keep`` names the input columns that go through; with
    ``where`` (new arrays to a boolean array) rows go by it and no column is appended.
    """
    ship(df.sparkSession)
    schema = df.schema
    names = df.columns if keep is None else keep
    index = [df.columns.index(c) for c in names]
    fields = [schema.fields[i] for i in index]
    out = T.StructType(fields + ([] if where else out_fields))
    out_names = out.names

    def run(batches):
        fn = make()
        for batch in batches:
            for lo, hi, texts in sub_batches(batch, text_col):
                part = batch.slice(lo, hi - lo)
                new = fn(texts)
                arrays = [part.column(i) for i in index]
                if where:
                    rb = pa.RecordBatch.from_arrays(arrays, names=out_names).filter(where(new))
                else:
                    rb = pa.RecordBatch.from_arrays(arrays + new, names=out_names)
                if rb.num_rows:
                    yield rb

    return df.mapInArrow(run, out)
