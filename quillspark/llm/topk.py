"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into m slices; a slice's inner products with a query are one local score
list, and the score is their sum. No list entry exceeds the product of the slice's norms, so a list has an
order in which it can be read without being computed whole. Phase 1 gathers the best k entries of the head of
every local list, the vectors of greatest norm in that slice and some of all norms, and resolves them, which gives each query a safe
cutoff: the k-th best of the scores found, tau. Phase 2 sends every query's cutoff to all lists. A candidate
that reaches tau has a list with tau / m or more; list by list, what was found and the norms of what is left
bound its score, and entries that can't reach tau are not asked for their further lists. Phase 3 resolves
those that can, exactly.

Queries meet candidates in blocks: a block of queries and a group of candidates are in memory together. No pair
becomes a row unless it reaches its query's cutoff and is among the block's best k.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Stored

FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _best(query, ids, score, k: int):
    """Indices of each query's k best entries, ties to the smaller id."""
    import numpy as np

    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


class Slices:
    """Integer vectors as m slices of columns, with the slices' norms; exact as doubles below 2**53."""

    def __init__(self, ids, mat, m: int, big: bool):
        import numpy as np

        self.ids, self.parts = ids, np.array_split(mat.astype(np.int64 if big else np.float64), min(m, mat.shape[1]), axis=1)
        self.norms = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in self.parts]

    def score(self, other: Slices, i, j, only: int | None = None, step: int = 1 << 16):
        """Sums over the slices, or one of them, for the pairs (i, j)."""
        import numpy as np

        out = np.zeros(len(i), self.parts[0].dtype)
        for s in range(len(self.parts)) if only is None else (only,):
            for at in range(0, len(i), step):
                some = slice(at, at + step)
                out[some] += np.einsum("ij,ij->i", self.parts[s][i[some]], other.parts[s][j[some]])
        return out


def gather(q: Slices, c: Slices, k: int, head: int = 512):
    """Phase 1: (i, j, score) of each query's best k among the head of every local list."""
    import numpy as np

    head = min(len(c.ids), max(head, len(c.ids) // 8))
    spread = np.arange(0, len(c.ids), max(1, 2 * len(c.ids) // head))
    pick = []
    for x, y, norms in zip(q.parts, c.parts, c.norms):
        top = np.union1d(np.argpartition(-norms, head // 2)[: head // 2], spread)
        local = (x @ y[top].T).astype(np.float64)
        local[q.ids[:, None] == c.ids[top][None, :]] = -np.inf
        best = np.argpartition(-local, min(k, len(top)) - 1, axis=1)[:, :k]
        pick.append(np.stack([np.repeat(np.arange(len(local)), best.shape[1]), top[best].ravel()], axis=1))
    i, j = np.unique(np.concatenate(pick), axis=0).T
    other = q.ids[i] != c.ids[j]
    i, j = i[other], j[other]
    return i, j, q.score(c, i, j)


def resolve(q: Slices, c: Slices, tau, step: int = 1024, dense: float = 0.1):
    """Phases 2 and 3: (i, j, score) of all pairs of at least their query's tau, and how many list entries were computed."""
    import numpy as np

    found, computed = [], 0
    least = tau.astype(np.float64)
    least -= np.abs(least) * 1e-9 + 1e-6  # bounds are rounded, the last test is not
    for at in range(0, len(c.ids), step):
        ids, norms, parts = c.ids[at : at + step], [n[at : at + step] for n in c.norms], [p[at : at + step] for p in c.parts]
        rest = sum(a[:, None] * b[None, :] for a, b in zip(q.norms, norms))
        alive = (q.ids[:, None] != ids[None, :]) & (rest >= least[:, None])
        total, i, j = np.zeros(alive.shape, parts[0].dtype), None, None
        for s, (x, y) in enumerate(zip(q.parts, parts)):
            if i is None and np.count_nonzero(alive) < dense * alive.size:
                i, j = np.nonzero(alive)
                total, rest = total[i, j], rest[i, j]
            if i is None:
                rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                total[np.ix_(rows, cols)] += x[rows] @ y[cols].T
                computed += len(rows) * len(cols)
                rest -= q.norms[s][:, None] * norms[s][None, :]
                alive &= total + rest >= least[:, None]
            else:
                total += q.score(c, i, at + j, s)
                computed += len(i)
                rest -= q.norms[s][i] * norms[s][j]
                left = total + rest >= least[i]
                i, j, total, rest = i[left], j[left], total[left], rest[left]
        if i is None:
            i, j = np.nonzero(alive)
            total = total[i, j]
        reach = total >= tau[i]
        found.append((i[reach], at + j[reach], total[reach]))
    i, j, total = (np.concatenate(x) for x in zip(*found))
    return i, j, total, computed


def _scan(k: int, slices: int, exact: bool):
    """The function over rows (key, kind, vec_id, v, tau): a key's queries (kind 0), then its candidates."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def by_length(rows):
            """Rows (id, vector, tau) as arrays, by length of the vector."""
            by: dict[int, list] = {}
            for row in rows:
                by.setdefault(len(row[1]), []).append(row)
            return {n: (np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), np.array([np.iinfo(np.int64).min if r[2] is None else r[2] for r in some], np.int64)) for n, some in by.items()}

        def meet(queries, candidates):
            candidates = by_length(candidates)
            for n, (qids, qmat, tau) in by_length(queries).items():
                if n not in candidates:
                    continue
                ids, mat, _ = candidates[n]
                big = float(np.abs(qmat).max(initial=0)) * float(np.abs(mat).max(initial=0)) * n >= 2.0**53
                q, c = Slices(qids, qmat, slices, big), Slices(ids, mat, slices, big)
                i, j, score = resolve(q, c, tau)[:3] if exact else gather(q, c, k)
                keep = _best(qids[i], ids[j], score.astype(np.int64), k)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (qids[i[keep]], ids[j[keep]], score[keep])], names=["query_id", "vec_id", "score"])

        key, held = None, ([], [])
        for batch in batches:
            for name, kind, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), zip(batch.column(2).to_pylist(), (v.values.to_numpy() for v in batch.column(3)), batch.column(4).to_pylist())):
                if name != key:
                    yield from meet(*held)
                    key, held = name, ([], [])
                held[kind].append(row)
        yield from meet(*held)

    return run


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256, slices: int = 4, query_block: int = 2048, group: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows, all if there are fewer.

    Components become floor(scale * x), x as double; scores are exact integers. Ties go to the smaller
    vec_id. Vectors that are null, empty or hold null or non-finite components take no part, and neither do
    rows without vec_id; vectors of different lengths never meet; whole repeated rows count once; an empty
    table gives no rows. Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    flagged = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("e"), is_query.alias("q"))
    fixed = (
        flagged.where(usable(F.col("e")) & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"), F.coalesce("q", F.lit(False)).alias("q"))
        .distinct()
    )
    kept = Stored(fixed, "topk-vectors")
    n, n_queries = kept.df.agg(F.count("*"), F.count_if("q")).first()
    blocks, groups = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n / group))

    def rows(cutoffs: DataFrame | None) -> DataFrame:
        h = F.xxhash64("vec_id", "v")
        q = kept.df.where("q")
        q = q.join(cutoffs, q["vec_id"] == cutoffs["query_id"], "left").select("vec_id", "v", "tau") if cutoffs is not None else q.withColumn("tau", F.lit(None).cast("bigint"))
        q = q.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.pmod(h, F.lit(blocks)) * groups + g)).alias("key"), F.lit(0).alias("kind"), "vec_id", "v", "tau")
        c = kept.df.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + F.pmod(h, F.lit(groups)))).alias("key"), F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("bigint").alias("tau"))
        return q.unionByName(c).repartition("key").sortWithinPartitions("key", "kind")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = ranked(rows(None).mapInArrow(_scan(k, slices, exact=False), FOUND).distinct())
    cutoffs = Stored(first.where(F.col("rank") == k).select("query_id", F.col("score").alias("tau")), "topk-cutoffs").df
    return ranked(rows(cutoffs).mapInArrow(_scan(k, slices, exact=True), FOUND).distinct()).select("query_id", "rank", "vec_id", "score")
