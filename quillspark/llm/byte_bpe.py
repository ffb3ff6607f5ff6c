"""Byte-level BPE with a segment tree over byte positions.

Leaf i holds the rank of merging the live piece at byte i with its right neighbour, joined with i, so the
root is the leftmost pair of least rank. A merge updates three leaves (the merged piece, the neighbour that
vanished, the live piece to the left) and their ancestors. Pieces of one padded length are encoded side by
side as rows of an array; a long piece is encoded by itself.
"""

from __future__ import annotations

import base64
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import worker_state

_SIDE_BY_SIDE = 256


class ByteBPE:
    """Ranks of a .tiktoken file; encode gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str, limit: int = 1 << 18):
        import numpy as np
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        top = max(self.ranks.values()) + 1
        lengths = np.zeros(top, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.vocabulary = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.limit = limit
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBPE:
        """One for each Python worker, kept between tasks."""
        return worker_state(("bytes", path, pattern), lambda: cls(path, pattern))

    def _rank(self, left, right, none):
        """Ranks of pairs of ids; none where there is no such merge or an id is missing (negative)."""
        import numpy as np

        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], none)

    def _merge_rows(self, pieces: list[bytes], size: int) -> list:
        """Ids of each piece; size: a power of two, no piece is longer."""
        import numpy as np

        n, none = len(pieces), 1 << 40
        lengths = np.array([len(p) for p in pieces])
        flat = self.single[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)].reshape(n, size)
        token = np.full((n, size + 2), -1, np.int64)  # column i + 1 is byte i; the borders stay empty
        token[:, 1:-1] = np.where(np.arange(size) < lengths[:, None], flat, -1)
        after = np.tile(np.arange(1, size + 3), (n, 1))
        before = np.tile(np.arange(-1, size + 1), (n, 1))
        tree = np.full((n, 2 * size), none * size, np.int64)
        leaf = self._rank(token[:, 1:-1], token[:, 2:], none)
        tree[:, size:] = leaf * size + np.arange(size)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.arange(n)
        while True:
            row = row[tree[row, 1] < none * size]
            if not len(row):
                break
            best = tree[row, 1]
            at, rank = best % size + 1, best // size
            gone = after[row, at]
            right, left = after[row, gone], np.maximum(before[row, at], 0)
            token[row, at] = rank
            token[row, gone] = -1
            after[row, at] = right
            before[row, right] = at
            tree[row, size + gone - 1] = none * size + gone
            tree[row, size + at - 1] = self._rank(rank, token[row, right], none) * size + at - 1
            inside = left > 0
            rows_in, left = row[inside], left[inside]
            tree[rows_in, size + left - 1] = self._rank(token[rows_in, left], rank[inside], none) * size + left - 1
            for rows, node in ((row, size + gone - 1), (row, size + at - 1), (rows_in, size + left - 1)):
                node = node >> 1
                while len(node) and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        live = token >= 0
        ends = np.cumsum(live.sum(axis=1))[:-1]
        return np.split(token[live].astype("<u4"), ends)

    def _merge_one(self, piece: bytes) -> list[int]:
        """The same for one long piece."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, pairs = 1 << 60, self.pairs
        token = [self.ranks[bytes([b])] for b in piece] + [-1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int | None) -> None:
            node = size + i
            tree[node] = none if rank is None else rank * size + i
            while node := node >> 1:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at] = rank, -1, right
            put(gone, None)
            if right < n:
                before[right] = at
            put(at, pairs.get(rank << 32 | token[right]) if right < n else None)
            if left >= 0:
                put(left, pairs.get(token[left] << 32 | rank))
        return [t for t in token[:n] if t >= 0]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """ids of pieces that are not known yet."""
        import numpy as np

        out: list = [None] * len(texts)
        by_size: dict[int, list[int]] = {}
        raw = [t.encode("utf-8") for t in texts]
        for i, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], "<u4").tobytes()
            elif len(piece) > _SIDE_BY_SIDE:
                out[i] = np.array(self._merge_one(piece), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, rows in by_size.items():
            most = max(1, (1 << 18) // size)
            for at in range(0, len(rows), most):
                some = rows[at : at + most]
                for i, ids in zip(some, self._merge_rows([raw[i] for i in some], size)):
                    out[i] = ids.tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.known
        missing = set(chain.from_iterable(split)).difference(known)
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = set(chain.from_iterable(split))
            todo = list(missing)
            known.update(zip(todo, self.pieces(todo)))
        out = [b"".join(map(known.__getitem__, p)) for p in split]
        for key in [k for k in missing if len(k) > 256]:
            del known[key]
        return out

    def decode(self, token) -> bytes:
        """token: an array of ids."""
        import numpy as np

        lengths = self.lengths[token]
        ends = np.cumsum(lengths)
        if not len(token):
            return b""
        return self.vocabulary[np.repeat(self.starts[token] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def _id_lists(encoded: list[bytes]):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _mapped(make, name: str):
    """Rows with one more column, made from the last one, some rows at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, make(some.columns[-1])], names=[*batch.schema.names, name])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; of a null or empty text, an empty array.

    Each match of the pattern is encoded by itself and special tokens are ordinary text. Repeated rows stay,
    other columns are ignored, an empty table gives no rows.
    """

    def make(texts):
        return _id_lists(ByteBPE.of(ranks, pattern).encode(texts.to_pylist()))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_mapped(make, "ids"), "doc_id bigint, text string, ids array<int>").select("doc_id", "ids")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encoded, as encode() gives it, with ``decoded``: the bytes of the text. Null ids give no bytes."""

    def make(lists):
        import numpy as np
        import pyarrow as pa

        codec = ByteBPE.of(ranks, pattern)
        return pa.array([codec.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in lists], pa.binary())

    return encoded.select("doc_id", "ids").mapInArrow(_mapped(make, "decoded"), "doc_id bigint, ids array<int>, decoded binary")
