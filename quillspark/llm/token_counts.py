"""Numbers of tokens: pieces are counted once for each distinct pre-token and joined to documents' pre-token frequencies.

No ids are kept. Distinct pre-tokens of a block of documents travel once, packed by shards of their hash; equal ones of
all blocks meet in their shard and are given to the tokenizer once; the numbers go back to their block and are summed
over the frequencies there.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.blocks import block_name, by_key, flat_lists, lists, packed, phase, some_documents, stretches, sums_by_list, unpacked
from quillspark.llm.common import Stored, worker_state

LEARNT = "block bigint, shard int, at int, pieces binary, places binary, docs binary"


class PreTokens:
    """The pre-tokens of a text for a byte-level tokenizers file without normalizer.

    They come from Python's pattern, with special tokens as pieces of their own. A text with a character that the
    tokenizer puts into another class than Python does, or with a special token that takes more than its own string,
    is left to the tokenizer whole.
    """

    def __init__(self, path: str, pattern: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError(f"{path}: pre-tokens of a tokenizer with a normalizer aren't parts of the text")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(pattern).findall
        self.before = self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        simple = not any(t.single_word or t.lstrip or t.rstrip for t in added)
        self.special = [t.content for t in added]
        names = "|".join(re.escape(n) for n in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({names})").split if simple and names else None
        self.seen, self.odd = set(), set()

    @classmethod
    def of(cls, path: str, pattern: str) -> PreTokens:
        return worker_state(("pre-tokens", path, pattern), lambda: cls(path, pattern))

    def _fits(self, text: str) -> bool:
        letters = set(text)
        for c in letters - self.seen:
            self.seen.add(c)
            if any((len(self.before(x + c)) == 1) != (len(self.find(x + c)) == 1) for x in "a1!"):
                self.odd.add(c)
        return letters.isdisjoint(self.odd)

    def split(self, text: str) -> list[str] | None:
        """None: the text must be taken whole."""
        if not self._fits(text):
            return None
        if not any(s in text for s in self.special):
            return self.find(text)
        if self.cut is None:
            return None
        parts = self.cut(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.find(part))]

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _learn(tokenizer: str, pattern: str, shards: int, block_chars: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from quillspark.llm.common import trim

        names = [f.split()[0] for f in LEARNT.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 2, *[pa.binary()] * 3]
        pre, index, held, name = PreTokens.of(tokenizer, pattern), {}, 0, block_name()

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        def dictionary():
            """The block's pieces by shard, and the places in it of pieces in the order in which documents count them."""
            known = list(index)
            shard = np.fromiter((zlib.crc32(p.encode()) % shards for p in known), np.int32, len(known))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(known), np.int32)
            place[order] = np.arange(len(known), dtype=np.int32)
            yield rows([(name, None, None, None, packed({"place": pa.array(place)}), None)])
            cuts = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(known)]
            order = order.tolist()
            for k in range(0, len(cuts) - 1, 256):
                some = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257]))
                yield rows([(name, int(shard[order[i]]), i, packed({"piece": pa.array([known[x] for x in order[i:j]], pa.string())}), None, None) for i, j in some])

        for keys, texts in some_documents(batches):
            split = [pre.split(t) for t in texts]
            whole = iter(pre.lengths([t for t, s in zip(texts, split) if s is None]))
            times = [Counter(s or ()) for s in split]
            for piece in set(chain.from_iterable(times)).difference(index):
                index[piece] = len(index)
            at = [np.fromiter(map(index.__getitem__, t), np.int32, len(t)) for t in times]
            order = [np.argsort(a) for a in at]
            counts = [np.fromiter(t.values(), np.int32, len(t)) for t in times]
            columns = {
                "doc_id": pa.array(keys, pa.int64()), "n_bytes": pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), "whole": pa.array([next(whole) if s is None else 0 for s in split], pa.int64()),
                "step": lists([np.diff(a[o], prepend=0) for a, o in zip(at, order)]), "times": lists([c[o] for c, o in zip(counts, order)]),
            }
            yield rows([(name, None, None, None, None, packed(columns))])
            held += sum(map(len, texts))
            if held >= block_chars:
                if index:
                    yield from dictionary()
                index, held, name = {}, 0, block_name()
                trim()
        if index:
            yield from dictionary()

    return run


def _count(tokenizer: str, pattern: str, known: int):
    """Rows sorted by shard: a piece that several blocks hold is counted once for all of them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from quillspark.llm.word_tokens import _Recent

        pre, of, learnt = PreTokens.of(tokenizer, pattern), None, _Recent(known)
        for (shard,), rows in stretches(batches, "shard"):
            if shard != of:
                of, learnt = shard, _Recent(known)
            out = []
            for block, at, raw in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3)):
                pieces = unpacked(raw.as_buffer()).column(0).to_pylist()
                if new := learnt.missing(set(pieces)):
                    learnt.new.update(zip(new, pre.lengths(new)))
                out.append((block, at, packed({"n": pa.array(np.fromiter(map(learnt.new.__getitem__, pieces), np.int32, len(pieces)))})))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "at", "packed"])

    return run


def _sum(batches):
    """Rows sorted by block and phase: numbers of its pieces by shard, their places, its documents."""
    import numpy as np
    import pyarrow as pa

    block, held, numbers = None, [], np.zeros(0, np.int64)
    for (name, step), rows in stretches(batches, "block", "phase"):
        if name != block:
            block, held, numbers = name, [], np.zeros(0, np.int64)
        for at, raw in zip(rows.column(2).to_pylist(), rows.column(3)):
            some = unpacked(raw.as_buffer())
            if step == 0:
                held.append((at, some.column(0).to_numpy()))
            elif step == 1:
                numbers = np.concatenate([n for _, n in sorted(held, key=lambda x: x[0])])[some.column(0).to_numpy()].astype(np.int64)
                held = []
            else:
                (steps, n), times = flat_lists(some.column("step")), some.column("times").flatten().to_numpy()
                past = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                at = past[1:] - np.repeat(past[np.cumsum(n) - n], n)
                tokens = sums_by_list(numbers[at] * times, n) + some.column("whole").to_numpy()
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(
    docs: DataFrame, tokenizer: str, pattern: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text", shards: int = 1024, known: int = 1 << 19, block_chars: int = 1 << 24
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text, as the tokenizer gives them.

    Special strings inside texts are special tokens, none is added. A null or empty text has no tokens; rows that
    repeat stay; other columns are ignored; an empty table gives no rows. pattern: the tokenizer's pre-tokens.
    block_chars and known bound what a task keeps, not what is counted: a shard with more distinct pre-tokens than
    ``known`` counts some of them again, so let ``shards`` grow with the corpus.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    learnt = Stored(rows.mapInArrow(_learn(tokenizer, pattern, shards, block_chars), LEARNT), "token-counts", "zstd").df
    pieces = by_key(learnt.where("shard IS NOT NULL").select("shard", "block", "at", "pieces"), "shard")
    answers = phase(pieces.mapInArrow(_count(tokenizer, pattern, known), "block bigint, at int, packed binary"), 0)
    asked = [phase(learnt.where(f"{c} IS NOT NULL").select("block", F.lit(None).cast("int").alias("at"), F.col(c).alias("packed")), i) for i, c in ((1, "places"), (2, "docs"))]
    order = ["block", "phase", "at", "packed"]
    both = answers.select(*order).unionByName(asked[0].select(*order)).unionByName(asked[1].select(*order))
    found = by_key(both, "block", "phase").mapInArrow(_sum, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
