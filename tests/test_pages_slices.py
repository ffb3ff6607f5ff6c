"""Pages of a batch are made in slices, with the same rows in the same order."""

import pyarrow as pa

from quillspark.plans import corpora as C
from quillspark.sources import pages as P


def test_few_pages_are_python_objects_at_once():
    raw = [None, "", "x" * 1_500_000, *("<p>a</p>" * 50_000 for _ in range(12)), "last"]
    seen = []

    def make(some, own):
        seen.append(sum(len(x or "") for x in (*some, *own)))
        return pa.array([f"{len(h or '')} {len(a or '')}" for h, a in zip(some, own)])

    out = P.in_slices(pa.array(raw), pa.array(raw[::-1]), make, pa.array([], pa.string()))
    assert out.to_pylist() == [f"{len(h or '')} {len(a or '')}" for h, a in zip(raw, raw[::-1])]
    assert len(seen) > 4 and max(seen) < P.SLICE_BYTES + 2 * 1_500_000
    assert P.in_slices(pa.array([], pa.string()), pa.array([], pa.string()), make, pa.array([], pa.string())).to_pylist() == []


def test_a_task_has_few_pages(spark):
    counts = C.spread(spark.range(0, 9_500, 1, 2), C.TASK_PAGES).groupBy(C.F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 9_500 and max(r["count"] for r in counts) <= 1.1 * C.TASK_PAGES
