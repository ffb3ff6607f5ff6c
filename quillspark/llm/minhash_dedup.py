"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

A document is the multiset of its shingles (five words each); a shingle's weight is how often it occurs.
Every shingle owns a plane of weight and rank on which hashed darts lie, one per unit of area on average,
cut into regions at powers of two. A document sees the darts of its shingles below their weights and below
a rank that leaves about k (ln k + 2) of them; each dart belongs to one of k coordinates, and a
signature keeps each coordinate's dart of least rank. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Where a coordinate has no dart, the rank doubles.

Documents of equal multisets are folded into one, whatever their ids: a node is a multiset, named by one of its
rows. The rest meet in bands of signature entries. Members of
a bucket are checked against one leader on their exact multisets, and those that this leaves apart against
another. What no link has joined with its bucket by then is joined exactly on each document's rarest items, so that no link between different texts is lost, and
neither copies nor common passages are expanded into pairs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Stored, cut, trim, worker_state
from quillspark.llm.components import components

_NOT_WORD = re.compile(r"\W+")
_STEP_DOCS, _STEP_CHARS = 1000, 1 << 20
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x):
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_C2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_C3)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Weighted shingles of texts. A word is a run of letters, digits and underscores, in lower case."""

    def __init__(self, width: int = 5):
        import numpy as np

        self.width = width
        word = np.zeros(256, bool)
        word[128:] = True
        for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
            word[c] = True
        self.word = word
        self.odd = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_C1)) | np.uint64(1)
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if len(self.power) < n:
            base, inverse = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)], dtype=np.uint64)
        return self.power, self.inverse

    def __call__(self, texts: list[str]):
        """(document, shingle, weight) arrays, sorted by document and shingle; fewer words than the width make one shingle."""
        import numpy as np

        low = [t.lower() if t.isascii() else _NOT_WORD.sub(" ", t.lower()) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in low]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        ends_of_docs = np.cumsum([len(r) + 1 for r in raw])
        inside = self.word[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        doc = np.searchsorted(ends_of_docs, start, "right").astype(np.uint64)
        if not len(start):
            return doc, doc, doc.astype(np.int64)
        power, inverse = self._powers(len(data))
        prefix = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)]
        words = _mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_C1))
        n = self.width
        last = len(words) - n + 1
        shingles, owners = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if last > 0:
            whole = np.flatnonzero(doc[:last] == doc[n - 1 :])
            total = np.zeros(len(whole), np.uint64)
            for k in range(n):
                total += words[whole + k] * self.odd[k]
            shingles, owners = _mix(total), doc[whole]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        short = np.flatnonzero(count < n)
        if len(short):
            total = count[short].astype(np.uint64) * np.uint64(_C2)
            for k in range(n - 1):
                has = count[short] > k
                total[has] += words[first[short[has]] + k] * self.odd[k]
            shingles, owners = np.r_[shingles, _mix(total)], np.r_[owners, doc[first[short]]]
        key = np.sort(owners << np.uint64(54) | shingles >> np.uint64(10))
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        weight = np.diff(np.r_[new, len(key)])
        key = key[new]
        return key >> np.uint64(54), key & np.uint64((1 << 54) - 1), weight


class DartMinHash:
    """Signatures of k entries for non-negatively weighted sets."""

    def __init__(self, k: int, seed: int = 11, finest: float = 1 / 16):
        self.k, self.seed, self.finest = k, seed, finest
        self.darts = k * (math.log(k) + 2)
        self.cdfs: dict[float, object] = {}

    def _cdf(self, area: float):
        """Cumulative Poisson probabilities."""
        import numpy as np

        if area not in self.cdfs:
            n = np.arange(int(area + 12 * math.sqrt(area) + 12))
            logs = n * math.log(area) - area - np.r_[0.0, np.cumsum(np.log(np.maximum(n[1:], 1)))]
            self.cdfs[area] = np.cumsum(np.exp(logs))
        return self.cdfs[area]

    @staticmethod
    def _span(level: int, unit: float) -> tuple[float, float]:
        return (0.0, unit) if level == 0 else (unit * 2.0 ** (level - 1), unit * 2.0**level)

    def __call__(self, doc, item, weight, n_docs: int):
        """Array (n_docs, k) of unsigned 64-bit entries, equal where it is the same dart; documents without weight keep the largest value."""
        import numpy as np

        none = np.uint64(2**64 - 1)
        out = np.full((n_docs, self.k), none, np.uint64)
        doc = doc.astype(np.int64)
        total = np.bincount(doc, weight, n_docs)
        limit = np.where(total > 0, self.darts / np.maximum(total, 1e-300), 0.0)
        rows = np.arange(len(doc))
        while len(rows):
            self._throw(out, doc[rows], item[rows], weight[rows].astype(float), limit)
            empty = (out == none).any(axis=1) & (total > 0)
            limit = limit * 2
            rows = rows[empty[doc[rows]]]
            out[empty] = none if len(rows) else out[empty]
        return out

    def _throw(self, out, doc, item, weight, limit) -> None:
        import numpy as np

        flat, bound = out.reshape(-1), limit[doc]
        base = _mix(item + np.uint64(self.seed * _C1 % 2**64))
        for level_w in range(64):
            low_w, high_w = self._span(level_w, 1.0)
            tall = np.flatnonzero(weight > low_w)
            if not len(tall):
                break
            for level_r in range(1100):
                low_r, high_r = self._span(level_r, self.finest)
                tall = tall[bound[tall] > low_r]
                if not len(tall):
                    break
                cdf = self._cdf((high_w - low_w) * (high_r - low_r))
                region = _mix(base[tall] + np.uint64((level_w * 1100 + level_r + 1) * _C3 % 2**64))
                uniform = (region >> np.uint64(11)).astype(float) * 2.0**-53
                some = np.flatnonzero(uniform >= cdf[0])
                counts = np.searchsorted(cdf, uniform[some], "right")
                who = np.repeat(some, counts)
                if not len(who):
                    continue
                nth = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
                dart = _mix(region[who] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(_C1))
                rank = low_r + (high_r - low_r) * ((dart & np.uint64((1 << 32) - 1)).astype(float) * 2.0**-32)
                who = tall[who]
                hit = rank < bound[who]
                if high_w > 1 or level_w:
                    other = _mix(dart ^ np.uint64(_C2))
                    hit &= low_w + (high_w - low_w) * ((other >> np.uint64(11)).astype(float) * 2.0**-53) < weight[who]
                elif (weight[who[: 1 << 10]] < 1).any() or (weight < 1).any():
                    other = _mix(dart ^ np.uint64(_C2))
                    hit &= (other >> np.uint64(11)).astype(float) * 2.0**-53 < weight[who]
                who, dart, rank = who[hit], dart[hit], rank[hit]
                own = _mix(dart + np.uint64(_C3))
                cell = doc[who] * self.k + (own % np.uint64(self.k)).astype(np.int64)
                fixed = np.minimum(rank * 2.0**24, 2.0**40 - 2).astype(np.uint64)
                np.minimum.at(flat, cell, fixed << np.uint64(24) | own >> np.uint64(40))


def _steps(batches):
    """(keys, texts) a bounded number of documents and characters at a time; a key has the columns before the text, null texts are empty."""
    for batch in batches:
        *before, texts = batch.columns
        ids = list(zip(*(c.to_pylist() for c in before)))
        for at in range(0, len(ids), _STEP_DOCS):
            some = [t or "" for t in texts.slice(at, _STEP_DOCS).to_pylist()]
            keys, held, size = [], [], 0
            for key, text in zip(ids[at : at + _STEP_DOCS], some):
                keys.append(key)
                held.append(text)
                size += len(text)
                if size >= _STEP_CHARS:
                    yield keys, held
                    keys, held, size = [], [], 0
            if keys:
                yield keys, held


def _sign(width: int, bands: int, rows: int):
    """(id, text_hash, text) to (id, text_hash, h1, h2, keys): h1 and h2 name the multiset, keys the buckets; null without words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler, darts = worker_state(("shingles", width, bands, rows), lambda: (Shingler(width), DartMinHash(bands * rows)))
        for ids, texts in _steps(batches):
            doc, item, weight = shingler(texts)
            n = len(ids)
            sig = darts(doc, item, weight, n).reshape(n, bands, rows)
            key = np.zeros((n, bands), np.uint64) + _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_C2))
            for r in range(rows):
                key = _mix(key * np.uint64(_C3) + sig[:, :, r])
            where = doc.astype(np.int64)
            names = []
            for c in (_C1, _C2):
                h = np.zeros(n, np.uint64)
                np.add.at(h, where, _mix(item * np.uint64(c) + weight.astype(np.uint64) * np.uint64(_C3)))
                names.append(h.view(np.int64))
            blank = np.bincount(where, minlength=n) == 0
            offsets = np.arange(n + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.reshape(-1).view(np.int64)))
            kept = [pa.array(c, pa.int64()) for c in zip(*ids)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(h, mask=blank) for h in names), lists], names=["id", "text_hash", "h1", "h2", "keys"])
        trim()

    return run


def _items(width: int):
    """(id, text) to (id, items): each shingle's n-th occurrence as a hash of 32 bits, so that a set stands for the multiset."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler = worker_state(("shingler", width), lambda: Shingler(width))
        for ids, texts in _steps(batches):
            doc, item, weight = shingler(texts)
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            hashed = (_mix(np.repeat(item, weight) + nth.astype(np.uint64) * np.uint64(_C1)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.bincount(doc.astype(np.int64), weight, len(ids)).astype(np.int32), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed))], names=["id", "items"])
        trim()

    return run


def _linked(pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets are at least so similar."""
    left = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * similarity)
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size(F.array_distinct("x")) + F.size(F.array_distinct("y")) - shared
    return both.where(shared >= union * F.lit(similarity)).select("a", "b")


def _sharing_prefix(docs: DataFrame, items: DataFrame, similarity: float, hot_parts: int = 1000) -> DataFrame:
    """Pairs (a, b) of documents (rep, root) of different roots, among them all that are at least so similar.

    Items are ordered from the rarest. A pair as similar as asked shares at least
    need = similarity / (1 + similarity) of both sizes' sum, so behind its first shared item each side has that
    many left: that item is among the first n - 2 need n + 1 of the smaller document and among the first
    n - similarity n + 1 of the larger one. A passage in many documents thus makes no pairs by itself. Counts of
    items that hold more than 1 / hot_parts of all occurrences, fewer than hot_parts rows, are broadcast, so
    that no task gets all holders of a common item.
    """
    part, slack = similarity / (1 + similarity), 1e-9
    spread = cut(items.join(docs, F.col("id") == F.col("rep")).withColumn("items", F.array_distinct("items")).select("rep", "root", F.size("items").alias("n"), F.explode("items").alias("x")))
    often = spread.groupBy("x").agg(F.count("*").alias("f"))
    common = often.where(F.col("f") > spread.count() / hot_parts).withColumnRenamed("f", "hot")
    marked = spread.join(F.broadcast(common), "x", "left")
    counted = marked.where("hot IS NULL").drop("hot").join(often, "x").unionByName(marked.where("hot IS NOT NULL").withColumnRenamed("hot", "f"))
    rarest = Window.partitionBy("rep").orderBy("f", "x")
    left = F.col("n") - F.row_number().over(rarest) + 1
    prefix = counted.withColumn("left", left).where(F.col("left") >= F.col("n") * similarity - slack)
    prefix = cut(prefix.where("f > 1").select("x", "rep", "root", "n", "left"))
    small = prefix.where(F.col("left") >= 2 * part * F.col("n") - slack).alias("s")
    need = part * (F.col("s.n") + F.col("l.n")) - slack
    fits = (F.col("s.x") == F.col("l.x")) & (F.col("s.root") != F.col("l.root")) & (F.col("s.n") <= F.col("l.n")) & (F.col("s.n") >= F.col("l.n") * similarity - slack) & (F.least("s.left", "l.left") >= need)
    return small.join(prefix.alias("l"), fits).select(F.least("s.rep", "l.rep").alias("a"), F.greatest("s.rep", "l.rep").alias("b")).distinct()


def near_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5, leaders: int = 2) -> DataFrame:
    """One row for each row: doc_id, text_hash, class_id, n_exact, kept.

    Documents whose weighted Jaccard similarity of shingles is at least similarity are linked; class_id is
    the least doc_id that links reach and kept marks the rows of the class that have it. n_exact counts documents
    of the same multiset. A pair at the threshold meets in some band with probability
    1 - (1 - similarity ** rows) ** bands, 0.99993 here. Texts without words (null, empty, marks only) are
    classes of their own; fewer words than the width make one shingle; rows that share a doc_id are told
    apart by their texts and share a class only by them, in any order of the rows; classes may then share
    a class_id, and of the rows that have it those of the least text_hash are kept in each. Rows without
    doc_id come out with a null class and are kept. An empty table
    gives no rows; other columns are ignored.
    """
    t = F.col(text).cast("string")
    rows_in = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    signed = Stored(rows_in.mapInArrow(_sign(width, bands, rows), "id bigint, text_hash bigint, h1 bigint, h2 bigint, keys array<bigint>").withColumn("row", F.monotonically_increasing_id()), "signatures")
    named_rows = signed.df.where("id IS NOT NULL AND h1 IS NOT NULL")
    # the row of a multiset is settled once its table is written; ids and texts choose it, not the order of rows
    folded = Stored(named_rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "row")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")).select("h1", "h2", "first.*", "n", "keys").withColumnRenamed("row", "rep"), "classes")
    # the text of least id leads: copies tend to come after what they were made from, and are nearer to it than to each other
    met = folded.df.select("rep", "id", "text_hash", F.explode("keys").alias("key"))
    buckets = met.groupBy("key").agg(F.min(F.struct("id", "text_hash", "rep")).getField("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = Stored(met.select("rep", "key").join(buckets.select("key", "leader"), "key"), "buckets")
    wanted = folded.df.select("id", "text_hash", "rep").join(members.df.select("rep").distinct(), "rep", "left_semi")
    found = rows_in.join(wanted, ["id", "text_hash"]).dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "text")
    items = Stored(found.mapInArrow(_items(width), "id bigint, items array<int>"), "shingles")
    tested = members.df.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_linked(tested, items.df, similarity))
    for again in range(leaders):
        roots = components(links).withColumnRenamed("node", "rep")
        now = members.df.select("key", "rep").join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
        lead = F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(again))).alias("lead")
        mixed = now.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), lead).where("least < most AND n > 2")
        apart = now.join(mixed.select("key", "lead"), "key")
        if again + 1 < leaders:
            pairs = apart.where("root <> lead.root").select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:
            pairs = _sharing_prefix(apart.select("rep", "root").distinct(), items.df, similarity)
        links = links.unionByName(cut(_linked(pairs, items.df, similarity)))
    roots = components(links).withColumnRenamed("node", "rep")
    items.drop()
    members.drop()
    # a component's class_id is its least doc_id; of several texts under that id, the least hash is the one that stays
    whole = folded.df.select("h1", "h2", "rep", "id", "text_hash", "n").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = whole.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("least"))
    named = whole.join(least, "root").select("h1", "h2", F.col("least.id").alias("class_id"), F.col("least.text_hash").alias("class_hash"), F.col("n").alias("n_exact"))
    stays = (F.col("doc_id") == F.col("class_id")) & (F.coalesce("class_hash", "text_hash") == F.col("text_hash"))
    return (
        signed.df.select("id", "text_hash", "h1", "h2")
        .join(named, ["h1", "h2"], "left")
        .select(F.col("id").alias("doc_id"), "text_hash", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_exact", F.lit(1)).cast("bigint").alias("n_exact"), "class_hash")
        .withColumn("kept", F.coalesce(stays, F.lit(True)))
        .drop("class_hash")
    )
