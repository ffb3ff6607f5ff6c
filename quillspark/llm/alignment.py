"""Alignment of two tokenizers' tokens over the bytes that they share, and corpus-wide counts of linked ids.

A (byte-level, a tokenizers file) and B (pieces, a sentencepiece model) both cut a text, with a space before it, into
tokens. A link is a pair of an A and a B token that share bytes. Text between white space is cut alike wherever it
occurs, so a block of documents aligns each distinct chunk once.

Counts are dense matrices striped by B id: the pairs of a block, counted there, are dealt out by stripe; a task adds
them into its stripe's matrix with ``np.add.at``, and the maximum of each row is the best count of a B id. The same
rows follow in a second phase of the same partition and take their counts back to the block, whose documents are
scored from them.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.blocks import block_name, by_key, flat_lists, lists, packed, phase, some_documents, stretches, sums_by_list, unpacked
from quillspark.llm.common import Stored, worker_state

LEARNT = "block bigint, stripe int, at int, n int, ids binary, times binary, links binary, docs binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_GAP = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Tokens:
    """Bytes and decimal texts of the ids of one vocabulary."""

    def __init__(self, raw: list[bytes]):
        import numpy as np

        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.decimal = np.array([str(i) for i in range(len(raw))], object)

    def joined(self, ids):
        import numpy as np

        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Chunks of texts and their alignment."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_tokens = _Tokens([bytes(letters.get(c, 0) for c in n) for n in names])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_tokens = _Tokens([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        self.by_chunk = not any(re.search("[^▁]▁", p) for p in pieces)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        return worker_state(("aligner", a_path, b_path), lambda: cls(a_path, b_path))

    def chunks(self, text: str) -> list[str]:
        """Parts of the text, each without the space before it: both tokenizers cut between a mark and a space."""
        if not text:
            return []
        if not self.by_chunk:
            return [text]
        if not _SPACES.search(" " + text):
            return text.split(" ")
        return [c[1:] for c in _GAP.split(" " + text)]

    def align(self, parts: list[str]) -> dict:
        """Of each part: fine, n_a, n_b, n_groups, n_links and its groups as text; and the ids of all links in order."""
        import numpy as np

        raw = [(" " + p).encode("utf-8") for p in parts]
        lengths = np.array([len(r) for r in raw], np.int64)
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b_ids = self.b.encode(parts, num_threads=1)
        if "" in parts:  # a space by itself: what it adds behind a mark
            space = self.b.encode("! ")[len(self.b.encode("!")) :]
            b_ids = [i if p else space for p, i in zip(parts, b_ids)]
        fine = np.ones(len(parts), bool)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        for tokens, ids in ((self.a_tokens, a_ids), (self.b_tokens, b_ids)):
            flat, n = np.array(list(chain.from_iterable(ids)), np.int64), np.array([len(i) for i in ids], np.int64)
            same = sums_by_list(tokens.lengths[flat], n) == lengths
            if not (same.all() and np.array_equal(tokens.joined(flat), whole)):
                same &= np.array([tokens.joined(np.array(i, np.int64)).tobytes() == r for i, r in zip(ids, raw)], bool)
            fine &= same
        a_ids, b_ids = ([i if f else [] for i, f in zip(ids, fine)] for ids in (a_ids, b_ids))
        n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_tokens.lengths[a]), np.cumsum(self.b_tokens.lengths[b])
        ends = np.union1d(a_ends, b_ends)
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        both = (a_ends[of_a] == ends) & (b_ends[of_b] == ends)
        part = np.searchsorted(np.cumsum(np.where(fine, lengths, 0)), ends)
        groups = ends[both]
        a_group, b_group = np.searchsorted(groups, a_ends), np.searchsorted(groups, b_ends)
        texts = [
            self.a_tokens.decimal[a] + np.where(groups[a_group] == a_ends, "|", ",").astype(object),
            self.b_tokens.decimal[b] + np.where(groups[b_group] == b_ends, ";", ",").astype(object),
        ]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        flat, cuts = np.concatenate(texts)[order].tolist(), [0, *np.cumsum(n_a + n_b).tolist()]
        return {
            "fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(part[both], minlength=len(parts)), "n_links": np.bincount(part, minlength=len(parts)),
            "groups": ["".join(flat[i:j]) for i, j in zip(cuts, cuts[1:])], "a": a[of_a].astype(np.int32), "b": b[of_b].astype(np.int32),
        }


class _Block:
    """Distinct chunks of some documents and how often each occurs in texts that have tokens."""

    NUMBERS = ("fine", "n_a", "n_b", "n_groups", "n_links")

    def __init__(self):
        import numpy as np

        self.name, self.index, self.chars, self.groups = block_name(), {}, 0, []
        self.numbers = {k: np.zeros(0, bool if k == "fine" else np.int64) for k in self.NUMBERS}
        self.a, self.b, self.times = [], [], np.zeros(0, np.int64)

    def add(self, aligner: Aligner, keys: list, texts: list[str]) -> bytes:
        import hashlib

        import numpy as np
        import pyarrow as pa

        split = [aligner.chunks(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.index))
        for k in range(0, len(new), 1 << 14):
            some = new[k : k + (1 << 14)]
            made = aligner.align(some)
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some))))
            self.groups += made["groups"]
            self.a.append(made["a"])
            self.b.append(made["b"])
            for name in self.NUMBERS:
                self.numbers[name] = np.concatenate([self.numbers[name], made[name]])
        self.times = np.concatenate([self.times, np.zeros(len(self.index) - len(self.times), np.int64)])
        self.chars += sum(map(len, texts))
        known, groups, at, times, digests, totals = self.index.__getitem__, self.groups.__getitem__, [], [], [], []
        for parts in split:
            places = np.fromiter(map(known, parts), np.int64, len(parts))
            if not len(parts) or not self.numbers["fine"][places].all():
                places = places[:0]
            one, n = np.unique(places, return_counts=True)
            self.times[one] += n
            at.append(one)
            times.append(n)
            totals.append([int(self.numbers[k][places].sum()) for k in self.NUMBERS[1:]])
            digests.append(hashlib.sha256("".join(map(groups, places.tolist()))[:-1].encode()).hexdigest() if len(places) else "")
        columns = {"doc_id": pa.array(keys, pa.int64())} | {k: pa.array([t[i] for t in totals], pa.int64()) for i, k in enumerate(self.NUMBERS[1:])}
        return packed(columns | {"groups_sha256": pa.array(digests, pa.string()), "at": lists(at), "times": lists(times)})

    def pairs(self, stripes: int, n_a: int):
        """(stripe, place of its first pair, ids, times) of each stripe with pairs; and the place of each link's pair, chunk by chunk."""
        import numpy as np

        a, b = (np.concatenate(x).astype(np.int64) for x in (self.a, self.b))
        stripe, width = b % stripes, n_a
        code = (stripe << 48) + (b // stripes) * width + a
        links = self.numbers["n_links"]
        code, place = np.unique(code, return_inverse=True)
        times = np.bincount(place, weights=np.repeat(self.times, links), minlength=len(code)).astype(np.int64)
        stripe = code >> 48
        cuts = [0, *(np.flatnonzero(np.diff(stripe)) + 1).tolist(), len(code)] if len(code) else [0]
        rows = [(int(stripe[i]), i, code[i:j] & (1 << 48) - 1, times[i:j]) for i, j in zip(cuts, cuts[1:])]
        ends = np.zeros(len(links) + 1, np.int32)
        np.cumsum(links, out=ends[1:])
        return rows, place.astype(np.int32), ends


def _learn(a_path: str, b_path: str, stripes: int, block_chars: int):
    def run(batches):
        import pyarrow as pa

        from quillspark.llm.common import trim

        names = ["block", "stripe", "at", "n", "ids", "times", "links", "docs"]
        kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
        aligner, block = Aligner.of(a_path, b_path), _Block()

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        def close():
            if not block.index:
                return
            pairs, place, ends = block.pairs(stripes, len(aligner.a_tokens.lengths))
            squeeze = lambda raw: pa.compress(raw, codec="zstd", asbytes=True)
            yield rows([(block.name, *[None] * 5, packed({"pair": pa.ListArray.from_arrays(pa.array(ends), pa.array(place))}), None)])
            for k in range(0, len(pairs), 256):
                yield rows([(block.name, s, at, len(ids), squeeze(ids.tobytes()), squeeze(n.tobytes()), None, None) for s, at, ids, n in pairs[k : k + 256]])

        for keys, texts in some_documents(batches):
            yield rows([(block.name, *[None] * 6, block.add(aligner, keys, texts))])
            if block.chars >= block_chars:
                yield from close()
                block = _Block()
                trim()
        yield from close()

    return run


def _wide(raw, n: int):
    """The n int64 values of a compressed column."""
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd"), np.int64)


def _count(width: int, n_a: int):
    """Rows sorted by stripe and phase: the first phase is added up in the stripe's matrix, the second takes counts from it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        matrix, of, best = np.zeros(width * n_a, np.int64), None, None
        for (stripe, step), rows in stretches(batches, "stripe", "phase"):
            if stripe != of:
                matrix[:] = 0
                of, best = stripe, None
            blocks, at, ns = (rows.column(i).to_pylist() for i in (2, 3, 4))
            if step == 0:
                for ids, times, n in zip(rows.column(5), rows.column(6), ns):
                    np.add.at(matrix, _wide(ids.as_buffer(), n), _wide(times.as_buffer(), n))
                continue
            if best is None:
                best = matrix.reshape(width, n_a).max(axis=1)
            out = []
            for name, place, n, ids in zip(blocks, at, ns, rows.column(5)):
                ids = _wide(ids.as_buffer(), n)
                counts = matrix[ids]
                top = counts == best[ids // n_a]
                out.append((name, place, n, pa.compress(counts.tobytes(), codec="zstd", asbytes=True), np.packbits(top).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "at", "n", "counts", "top"])

    return run


def _score(batches):
    """Rows sorted by block and phase: counts of its pairs, its chunks' links, its documents."""
    import numpy as np
    import pyarrow as pa

    block, held, pairs, chunks = None, [], None, None
    for (name, step), rows in stretches(batches, "block", "phase"):
        if name != block:
            block, held, pairs, chunks = name, [], None, None
        if step == 0:
            for at, n, counts, top in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), rows.column(4), rows.column(5)):
                held.append((at, _wide(counts.as_buffer(), n), np.unpackbits(np.frombuffer(top.as_buffer(), np.uint8), count=n)))
            continue
        if pairs is None:
            held.sort(key=lambda x: x[0])
            pairs = [np.concatenate([x[i] for x in held] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (1, 2)]
            held = []
        for raw in rows.column(6):
            batch = unpacked(raw.as_buffer())
            if step == 1:
                place, n = flat_lists(batch.column(0))
                chunks = [sums_by_list(p[place], n) for p in pairs]
                continue
            at, n = flat_lists(batch.column("at"))
            times = batch.column("times").flatten().to_numpy()
            counts, best = (sums_by_list(c[at] * times, n) if len(at) else np.zeros(len(n), np.int64) for c in chunks or (times, times))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best, pa.int64()), pa.array(counts, pa.int64()), batch.column("groups_sha256")], names=[f.split()[0] for f in RESULT.split(", ")])


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, stripes: int = 2048, doc_id: str = "doc_id", text: str = "text", block_chars: int = 1 << 24) -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, links that are their B id's commonest, counts summed over links.

    Groups end where tokens of both end; groups_sha256 is the digest of their ids as text. Texts that are null or empty,
    or whose tokens don't give back the text with a space before it, have no tokens: zeros and an empty digest. Special
    strings are plain text. Rows that repeat count as often; other columns are ignored; an empty table gives no rows.
    block_chars bounds what a task keeps, not what is counted; a matrix has (B ids / stripes) x (A ids) cells.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    n_a = Tokenizer.from_file(a_path).get_vocab_size(with_added_tokens=True)
    width = -(-sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() // stripes)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    learnt = Stored(rows.mapInArrow(_learn(a_path, b_path, stripes, block_chars), LEARNT), "alignment", "zstd").df
    none = lambda kind: F.lit(None).cast(kind)
    pairs = learnt.where("stripe IS NOT NULL").select("stripe", "block", "at", "n", "ids", "times")
    twice = phase(pairs, 0).unionByName(phase(pairs.withColumn("times", none("binary")), 1)).select("stripe", "phase", "block", "at", "n", "ids", "times")
    counted = by_key(twice, "stripe", "phase").mapInArrow(_count(width, n_a), "block bigint, at int, n int, counts binary, top binary")
    answers = phase(counted, 0).withColumn("packed", none("binary"))
    asked = [phase(learnt.where(f"{c} IS NOT NULL").select("block", F.col(c).alias("packed")), i) for i, c in ((1, "links"), (2, "docs"))]
    asked = asked[0].unionByName(asked[1]).withColumns({"at": none("int"), "n": none("int"), "counts": none("binary"), "top": none("binary")})
    order = ["block", "phase", "at", "n", "counts", "top", "packed"]
    return by_key(answers.select(*order).unionByName(asked.select(*order)), "block", "phase").mapInArrow(_score, RESULT)
