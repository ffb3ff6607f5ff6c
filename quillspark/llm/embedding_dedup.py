"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors within cosine s lie within distance sqrt(2 - 2 s). A table hashes a vector by k numbers
floor((a . x + b) / w), a Gaussian, b uniform in [0, w): the nearer, the likelier equal. k follows the number
of vectors so that unrelated ones seldom meet; the number of tables follows k so that a pair at exactly s
meets in one of them with the probability asked for. Equal vectors are first folded into one; a bucket
above a bounded size is dealt out in blocks of its own pairs, all of which are checked. A pair is counted in
the first table where it meets, so counts need no list of pairs; each block hands on a spanning forest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Stored, cut
from quillspark.llm.components import components
from quillspark.llm.topk import usable


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection is equal for two points at this distance."""
    if not distance:
        return 1.0
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, similarity: float, recall: float, width: float, met: int) -> tuple[int, int]:
    """(projections of a table, tables): met is the number of unrelated vectors that one vector may meet in a table."""
    near, far = collision(math.sqrt(2 - 2 * similarity), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(1.0, n / met)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def merge_labels(labels, i, j) -> None:
    """labels (each node's root, roots to themselves) after linking nodes i with nodes j."""
    import numpy as np

    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _units(x):
    """Rows as doubles of length one, scaled first so that no square over- or underflows."""
    import numpy as np

    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _opened(payloads: list[bytes], dim: int):
    """Unit vectors of payloads, which hold 32-bit components where these are exact."""
    import numpy as np

    out = np.empty((len(payloads), dim))
    narrow = np.array([len(p) == 4 * dim for p in payloads])
    for which, kind in ((narrow, np.float32), (~narrow, np.float64)):
        rows = np.flatnonzero(which)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(payloads[r] for r in rows), kind).reshape(len(rows), dim)
    return _units(out)


def _hash(k: int, tables: int, width: float, seed: int):
    """(rep, n, e) to (rep, n, dim, payload: the components, codes: one of 32 bits for each table)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        made: dict = {}
        for batch in batches:
            e = batch.column(2)
            offsets, values = e.offsets.to_numpy(), e.values.to_numpy().astype(np.float64)
            lengths = np.diff(offsets)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                raw = values[offsets[rows][:, None] + np.arange(dim)]
                x = _units(raw)
                with np.errstate(over="ignore"):
                    narrow = raw.astype(np.float32)
                payload = [n.tobytes() if same else r.tobytes() for n, r, same in zip(narrow, raw, (narrow == raw).all(axis=1))]
                if dim not in made:
                    rng = np.random.default_rng([seed, int(dim)])
                    made[dim] = rng.standard_normal((int(dim), k * tables)), rng.uniform(0, width, k * tables), rng.integers(1, 1 << 62, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                a, b, odd = made[dim]
                q = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, k)
                h = (q * odd).sum(axis=2, dtype=np.uint64)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                codes = (h >> np.uint64(32)).astype(np.uint32).astype(np.int32)
                took = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(took), batch.column(1).take(took), pa.array(np.full(len(rows), dim, np.int32)), pa.array(payload, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))],
                    names=["rep", "n", "dim", "x", "codes"],
                )

    return run


def _check(similarity: float, step: int = 512):
    """Rows sorted by (t, code, lo, hi), the pairs of one block together, to (node, links, root).

    links: copies of other vectors linked in this block and in no earlier table; root: the least node that
    this block's links reach.
    """

    def cosines(x, y):
        import numpy as np

        c = x @ y.T
        i, j = np.nonzero(np.abs(c - similarity) < 1e-9)
        for a, b in zip(i, j):  # the product's last bits depend on the block's shape
            c[a, b] = math.fsum(x[a] * y[b])
        return c

    def block(t, reps, ns, side, x, codes, own):
        import numpy as np

        links, labels = np.zeros(len(reps), np.int64), np.arange(len(reps))
        left = np.arange(len(reps)) if own else np.flatnonzero(side == 0)
        right = np.arange(len(reps)) if own else np.flatnonzero(side == 1)
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            i, j = np.nonzero(cosines(x[rows], x[right]) >= similarity)
            i, j = rows[i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            merge_labels(labels, i, j)
            new = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
            np.add.at(links, i[new], ns[j[new]])
            np.add.at(links, j[new], ns[i[new]])
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, reps)
        root = least[labels]
        touched = np.flatnonzero((links > 0) | (root != reps))
        return reps[touched], links[touched], root[touched]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        out: list[tuple] = []
        held: list[tuple] = []

        def close():
            if len(held) > 1:
                t, _, dim, lo, hi = held[0][0]
                reps, ns, side = (np.array([h[c] for h in held]) for c in (1, 2, 3))
                x = _opened([h[4] for h in held], dim)
                found = block(t, reps, ns, side, x, np.array([h[5] for h in held]), lo == hi)
                if len(found[0]):
                    out.append(found)
            held.clear()

        def emit():
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "root"])
                out.clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], axis=1)
            reps, ns, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in (5, 6, 7))
            x, codes = batch.column(8), batch.column(9)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = np.r_[0, cuts, len(keys)]
            for s, e in zip(starts[:-1], starts[1:]):
                key = tuple(keys[s].tolist())
                if held and held[0][0] != key:
                    close()
                if e - s == 1 and e < len(keys) and not held:
                    continue
                for r in range(s, e):
                    held.append((key, reps[r], ns[r], side[r], x[r].as_py(), codes[r].values.to_numpy()))
                if e < len(keys):
                    close()
            if sum(len(o[0]) for o in out) > 1 << 16:
                yield from emit()
        close()
        yield from emit()

    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", similarity: float = 0.9, recall: float = 0.99, width: float = 2.0, met: int = 256, block: int = 2048, seed: int = 7, broadcast_rows: int = 100_000) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    Links join rows whose cosine, in double precision, is at least similarity; each such pair is found with
    probability recall or more, and no other pair is linked. n_links counts linked rows, copies included;
    component_id is the least vec_id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths, nor rows without vec_id,
    which come out with a null component_id and are kept. Repeated rows are copies like any others. An empty
    table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fine = usable(F.col("e")) & F.exists("e", lambda x: x != 0) & F.col("vec_id").isNotNull()
    marked = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    k1, k2 = F.xxhash64("e"), F.xxhash64(F.lit(1), "e")
    keyed = marked.where("fine").select("vec_id", "e", k1.alias("k1"), k2.alias("k2"))
    reps = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("e").alias("e"))
    folded = Stored(reps, "vectors")
    k, tables = plan(folded.df.count(), similarity, recall, width, met)
    hashed = Stored(folded.df.select("rep", "n", "e").mapInArrow(_hash(k, tables, width, seed), "rep bigint, n bigint, dim int, x binary, codes array<int>"), "vector-codes")
    bucket = F.posexplode("codes").alias("t", "code")
    large = cut(hashed.df.select("dim", bucket).groupBy("t", "code", "dim").count().where(F.col("count") > block).select("t", "code", "dim", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    few = large.count() <= broadcast_rows  # else vectors are dealt out by bucket for this join too
    dealt = hashed.df.select("rep", "n", "dim", "x", "codes", bucket).join(F.broadcast(large) if few else large, ["t", "code", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    paired = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("t", "code", "dim", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "rep", "n", (F.col("mine") > F.col("other")).cast("int").alias("side"), "x", "codes")
    keys = ["t", "code", "dim", "lo", "hi"]
    found = cut(paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_check(similarity), "node bigint, links bigint, root bigint"))
    hashed.drop()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_rep = folded.df.select("k1", "k2", "rep", "n").join(links, F.col("rep") == links["node"], "left").drop("node").join(roots, F.col("rep") == roots["node"], "left")
    per_rep = per_rep.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = keyed.select("vec_id", "k1", "k2").join(per_rep, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
