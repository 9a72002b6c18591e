"""Words of many texts at once, in Arrow buffers and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that are worked on at once; what is made of them takes some thirty times as much.
GROUP_BYTES = 4 << 20


def grouped(batches: Iterator[pa.RecordBatch], column: str, least: int = GROUP_BYTES) -> Iterator[dict[str, pa.Array]]:
    """The batches' columns, joined until the named one has about so many bytes."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def joined():
        table = pa.Table.from_batches(waiting)
        return {c: pa.concat_arrays(table[c].chunks) for c in table.column_names}

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column(column).nbytes
        if size >= least:
            yield joined()
            waiting, size = [], 0
            pa.default_memory_pool().release_unused()
    if waiting:
        yield joined()
        pa.default_memory_pool().release_unused()


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte of the texts (none null) replaced by its entry in the table."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    new = bytes(memoryview(data)[at[0] : at[-1]]).translate(table) if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(new))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between blanks, and whose text each is of."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.binary_length(words).to_numpy() > 0
    return (words, owner) if some.all() else (words.filter(pa.array(some)), owner[some])


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the values by number."""
    found = values.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def summed(columns: dict[str, np.ndarray], by: list[str], **asked: str) -> dict[str, np.ndarray]:
    """Groups of equal numbers, exactly: by.., and for each name=how its column <name>_<how>; a count counts rows."""
    value = next(c for c in columns if c not in by)
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    made = [(name if name in columns else value, how) for name, how in asked.items()]
    out = table.group_by(by, use_threads=False).aggregate(made)
    renamed = {f"{c}_{how}": f"{name}_{how}" for (c, how), name in zip(made, asked, strict=True)}
    return {renamed.get(c, c): out[c].to_numpy() for c in out.column_names}
