"""Packing of token sequences by minimum bin slack.

Documents longer than a window are cut into whole windows and a remainder. The remainders of a shard
(a bounded run of one partition's documents) form a multiset of lengths. Each window is seeded with the
longest remaining length; a bitset subset-sum dynamic programme over the multiset finds the sum closest
to the capacity, and walking back through the stored bitsets gives how often each length is used. A
pattern found is used as often as the counts allow. Nothing is shuffled: shards are packed where their
rows are, so at most the last windows of a shard have slack.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import trim

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"


def padded_length(used: int, capacity: int) -> int:
    """A sequence is padded to capacity, except where its length is a power of two."""
    return used if used & (used - 1) == 0 else capacity


def closest_sum(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum is the largest one of at most room. lengths: descending."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        copies = min(counts[length], room // length) if length <= room else 0
        if not copies:
            continue
        steps.append((length, reach))
        take = 1
        while copies > 0:
            use = min(take, copies)
            reach |= (reach << (length * use)) & mask
            copies -= use
            take <<= 1
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            used[length] = n
    return used


def fill_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths of one window with their counts, number of such windows) until the multiset is used up."""
    counts = {k: v for k, v in counts.items() if v}
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        pattern = closest_sum(lengths, counts, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
        lengths = [k for k in lengths if counts[k]]
        yield pattern, times


def _pack_shard(docs: list[tuple], capacity: int, first: int) -> tuple[dict[str, list], int]:
    """docs: (doc_id, bytes of ids). Rows as columns, and the next free sequence id."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length")}
    by_length: dict[int, list[tuple]] = {}
    width = 4

    def put(piece: tuple, sequence: int, offset: int, padded: int) -> None:
        doc_id, ids, start, length, total = piece
        for key, value in zip(out, (doc_id, start, length, ids, total, sequence, offset, padded)):
            out[key].append(value)

    for doc_id, ids in docs:
        total = len(ids) // width
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            put((doc_id, ids[start * width : (start + capacity) * width], start, capacity, total), first, 0, capacity)
            first += 1
        if rest := total - whole:
            by_length.setdefault(rest, []).append((doc_id, ids[whole * width :], whole, rest, total))
    for pattern, times in fill_windows({k: len(v) for k, v in by_length.items()}, capacity):
        used = sum(k * n for k, n in pattern.items())
        for _ in range(times):
            offset = 0
            for length, n in pattern.items():
                for _ in range(n):
                    put(by_length[length].pop(), first, offset, padded_length(used, capacity))
                    offset += length
            first += 1
    return out, first


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048, shard_docs: int = 16384, shard_tokens: int = 1 << 21) -> DataFrame:
    """One row for each piece of a document: its ids (little-endian unsigned 32-bit), its sequence and place there.

    A document's ids are those of its text and end_id, so an empty or null text gives one id. A shard ends
    at shard_docs documents or shard_tokens ids, which bounds a task's memory whatever the input. Repeated
    rows are packed as often as they occur; a null doc_id is kept; an empty table gives no rows; other
    columns are ignored. sequence_id is the partition's number times 2**32 plus a running number.
    """
    import numpy as np

    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from quillspark.llm.word_tokens import WordEncoder

        encoder, schema = WordEncoder.of(tokenizer, chunks=1 << 18), pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length")])
        first, shard, held = TaskContext.get().partitionId() << 32, [], 0

        def rows(columns):
            table = pa.table(columns, schema=schema)
            return table.to_batches(max_chunksize=8192)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, len(keys), 64):
                for key, ids in zip(keys[at : at + 64], encoder.encode(texts.slice(at, 64).to_pylist())):
                    shard.append((key, ids + end))
                    held += len(ids) // 4 + 1
                    if len(shard) >= shard_docs or held >= shard_tokens:
                        columns, first = _pack_shard(shard, capacity, first)
                        shard, held = [], 0
                        yield from rows(columns)
                        columns = None
        if shard:
            columns, first = _pack_shard(shard, capacity, first)
            shard = None
            yield from rows(columns)
        columns = None
        trim()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
