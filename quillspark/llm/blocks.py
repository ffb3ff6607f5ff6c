"""Blocks: what a map task learns of some megabytes of text under one name, so that answers find their way back.

A task keeps the distinct parts of its block in a dictionary and its documents as counts of places in it, packed as
Arrow batches of bounded size. Distinct parts travel once for each block; the answers are sorted before the packed
documents of their block, and a stream over the sorted rows holds one block at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_name() -> int:
    """A name of the task attempt's own: rows of attempts that failed are never read."""
    return uuid.uuid4().int >> 65


def some_documents(batches, rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """doc_ids and texts (null: empty) of a few documents at a time."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 32):
            some = batch.slice(k, 32)
            for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                keys.append(key)
                texts.append(text or "")
                held += len(texts[-1])
                if len(keys) == rows or held >= chars:
                    yield keys, texts
                    keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def packed(columns: dict) -> bytes:
    import pyarrow as pa

    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes):
    import pyarrow as pa

    with pa.ipc.open_stream(raw) as stream:
        return stream.read_next_batch()


def lists(arrays: list):
    """A list column of the int arrays."""
    import numpy as np
    import pyarrow as pa

    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def flat_lists(column) -> tuple:
    """Values of a list column and the number of each list's."""
    import numpy as np

    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def sums_by_list(values, lengths):
    """Sums of consecutive stretches of values, empty ones included."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - lengths]


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by the first key and sorted by all keys."""
    return rows.repartition(keys[0]).sortWithinPartitions(*keys)


def stretches(batches, *names: str) -> Iterator[tuple]:
    """(values of the named columns, rows) for each stretch of equal values; a stretch may end and go on in the next batch."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield tuple(int(c[low]) for c in columns), batch.slice(low, high - low)


def phase(rows: DataFrame, number: int) -> DataFrame:
    return rows.withColumn("phase", F.lit(number))
