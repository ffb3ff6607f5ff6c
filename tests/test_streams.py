"""Streams with state against the same numbers from tables."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

BASE = datetime.datetime(2024, 1, 1)


def feed(spark, folder, rows, schema, size, seed):
    """rows as files of a stream; the rows of one file in any order. Files are read in the order of their times."""
    import os
    import time

    rng = random.Random(seed)
    for i in range(0, len(rows), size):
        some = rows[i : i + size]
        rng.shuffle(some)
        part = f"{folder}-{i}"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{i:06d}.parquet"
        shutil.move(f"{part}/{name}", path)
        at = time.time() - 10000 + i
        os.utime(path, (at, at))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


# running trust

EVENT = "source string, ts timestamp, doc_id long, overall double, action string"


def events(n, seed, start=BASE):
    from quillspark.streaming.trust import ACTIONS

    rng, t, rows = random.Random(seed), start, []
    for i in range(n):
        t += datetime.timedelta(hours=rng.choice([1, 2, 5, 9]) if i != n // 2 else 24 * 120)
        rows.append((rng.choice(["a", "a", "a", "b", None]), t, i if i % 7 else None, round(rng.random(), 3), rng.choice([*ACTIONS, "other"])))
    return rows


def closed_by(rows, days):
    """Rows of days that are over ``days`` before the last event."""
    return max(r[1] for r in rows) - datetime.timedelta(days=days)


def test_trust_of_a_table(spark):
    """Against a loop over the events; rows without time, confidence or action are left out."""
    from quillspark.streaming.trust import ACTIONS, trust_by_day

    rows = events(200, 3)
    got = {(r["source"], r["day"]): r for r in trust_by_day(spark.createDataFrame([*rows, ("a", None, 1, 0.5, "drop"), ("a", BASE, 1, None, "drop"), ("a", BASE, 1, 0.5, None)], EVENT), half_life=10, idle=90).collect()}
    state, seen = {}, set()
    for source, ts, doc_id, overall, action in rows:
        key, day = source or "", ts.date()
        s = state.setdefault(key, {"x": []})
        if s["x"] and (day - s["x"][-1][0].date()).days > 90:
            s["x"] = []
        s["x"].append((ts, overall, action))
        end = datetime.datetime.combine(day, datetime.time()) + datetime.timedelta(days=1)
        w = [0.5 ** ((end - t).total_seconds() / 86400 / 10) for t, _, _ in s["x"]]
        seen.add((key, day))
        state[key]["row"] = (len(w), sum(o for _, o, _ in s["x"]) / len(w), sum(a * o for a, (_, o, _) in zip(w, s["x"])) / sum(w), action, [sum(x == a for _, _, x in s["x"]) for a in ACTIONS])
        state[key].setdefault("rows", {})[day] = state[key]["row"]
    assert set(got) == seen
    for (key, day), r in got.items():
        n, mean, trust, action, counts = state[key]["rows"][day]
        assert (r["n"], r["last_action"], [r[f"n_{a}"] for a in ACTIONS]) == (n, action, counts)
        assert r["mean"] == pytest.approx(mean, abs=2e-6) and r["trust"] == pytest.approx(trust, abs=2e-6)


def test_trust_of_a_stream_equals_the_table(spark, tmp_path):
    from quillspark.streaming.runs import run_available
    from quillspark.streaming.trust import rounded, trust_by_day, trust_stream

    rows = events(300, 4)
    feed(spark, str(tmp_path / "in"), list(rows), EVENT, 75, 1)
    got = sorted(map(tuple, rounded(run_available(trust_stream(stream(spark, str(tmp_path / "in"), EVENT), late="3 days"), "trust")).collect()))
    end = closed_by(rows, 3)
    want = sorted(tuple(r) for r in trust_by_day(spark.createDataFrame(rows, EVENT)).collect() if datetime.datetime.combine(r["day"], datetime.time()) + datetime.timedelta(days=1) <= end)
    assert got == want and len(got) > 50


def test_trust_goes_on_after_a_restart_and_from_a_table(spark, tmp_path):
    """Two runs with one checkpoint give each day once; so does a table up to a day and a stream from there on."""
    from quillspark.streaming.runs import run_available
    from quillspark.streaming.trust import last_state, rounded, running_by_day, trust_by_day, trust_stream

    rows = sorted(events(240, 5), key=lambda r: r[1])
    cut = next(i for i, r in enumerate(rows) if i > 100 and r[1].date() != rows[i - 1][1].date())
    folder, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    whole = {tuple(r) for r in trust_by_day(spark.createDataFrame(rows, EVENT)).collect()}
    feed(spark, folder, rows[:cut], EVENT, 60, 2)
    run_available(trust_stream(stream(spark, folder, EVENT), late="1 day"), "trust", checkpoint=checkpoint, out=out)
    feed(spark, folder + "2", rows[cut:], EVENT, 60, 3)
    import os

    for name in os.listdir(folder + "2"):
        shutil.move(f"{folder}2/{name}", f"{folder}/9{name}")
    got = [tuple(r) for r in rounded(run_available(trust_stream(stream(spark, folder, EVENT), late="1 day"), "trust", checkpoint=checkpoint, out=out)).collect()]
    assert len(got) == len(set(got)) and set(got) <= whole and len(whole) - len(got) <= 9

    before = running_by_day(spark.createDataFrame(rows[:cut], EVENT))
    feed(spark, folder + "3", rows[cut:], EVENT, 60, 4)
    more = rounded(run_available(trust_stream(stream(spark, folder + "3", EVENT), late="1 day", initial=last_state(before)), "trust"))
    assert {tuple(r) for r in more.collect()} <= whole
    assert {tuple(r)[:2] for r in more.collect()} == {r[:2] for r in got if r[1] >= rows[cut][1].date()}


# comparison

DOC = "group_id long, doc_idx int, source_name string, text string, ts timestamp"
FIELDS = ["group_id", "doc_count", "error", "shared_claims", "unique_claims", "conflicts", "alignment", "crude_note", "follow_up_sources", "triage_summary"]


def group_rows(n, seed, spread=lambda g: 55):
    rng, rows = random.Random(seed), []
    for g in range(n):
        for i in range(rng.choice([1, 2, 3, 5, 12])):
            ts = BASE + datetime.timedelta(hours=g, minutes=rng.randrange(0, spread(g)))
            lines = (f"{rng.choice(['Gold', 'CPI', 'WTI crude', 'Brent crude', '10-Year Treasury'])}: {rng.choice(['$', ''])}{rng.choice([3.1, 3.12, 90, 91.5])}{rng.choice(['%', ''])}" for _ in range(rng.randrange(0, 5)))
            rows.append((g, i, rng.choice([None, "", "desk"]), rng.choice([None, "\n".join(lines), "\n".join(lines)]), ts))
    return sorted(rows, key=lambda r: r[4])


def compared_stream(spark, folder, **options):
    from quillspark.streaming.comparison import compare_stream
    from quillspark.streaming.runs import run_available

    return run_available(compare_stream(stream(spark, folder, DOC), late="2 hours", **options), "comparison")


def test_comparison_of_a_stream_equals_the_table(spark, tmp_path):
    """Documents that come again, beyond the horizon or in too great number; any order within the watermark."""
    from quillspark.operators.claims import compare
    from quillspark.streaming.comparison import gathered

    rows = group_rows(30, 6, lambda g: 80 if g % 5 == 0 else 55)
    rows += [(g, i, "again", "Gold: 77", ts + datetime.timedelta(minutes=1)) for g, i, _, _, ts in rows[::6]]
    rows.sort(key=lambda r: r[4])
    feed(spark, str(tmp_path / "in"), list(rows), DOC, 50, 7)
    got = compared_stream(spark, str(tmp_path / "in"))
    ours = {r["group_id"]: r for r in got.select(FIELDS).collect()}
    want = {r["group_id"]: r for r in compare(gathered(spark.createDataFrame(rows, DOC))).select(FIELDS).collect()}
    assert set(ours) >= set(range(26)) and all(ours[g] == want[g] for g in ours)
    assert got.agg(F.sum("n_late")).first()[0] > 0


def test_full_groups_close_early(spark, tmp_path):
    from quillspark.operators.claims import compare
    from quillspark.streaming.comparison import gathered

    rows = group_rows(25, 8)
    feed(spark, str(tmp_path / "in"), list(rows), DOC, 60, 9)
    got = {r["group_id"]: r for r in compared_stream(spark, str(tmp_path / "in"), close_full=True).select("closed_by", *FIELDS).collect()}
    want = {r["group_id"]: tuple(r) for r in compare(gathered(spark.createDataFrame(rows, DOC))).select(FIELDS).collect()}
    full = {g for g in want if want[g][1] == 10}
    assert {g for g, r in got.items() if r["closed_by"] == "count"} == full and all(tuple(r)[1:] == want[g] for g, r in got.items())


def test_summaries_are_bounded(spark):
    """A group with 300,000 claims of one entity: counts and range of all, the first values, ranks limited before each exchange."""
    from quillspark.operators.claims import compare, entities, first_values, grouped, items_of

    rows = spark.range(0, 300000, 1, 8).select(
        (F.col("id") * 0 + 1).alias("group_id"), F.col("id").alias("doc_idx"), F.lit(0).alias("pos"), F.lit("s").alias("source_name"), F.substring(F.concat(F.lit("gold"), F.col("id").cast("string")), 1, 4).alias("entity_key"), F.lit("Gold").alias("entity_label"),
        (F.col("id") % 1000 + 0.5).alias("numeric_value"), F.lit("$").alias("unit"), F.col("id").cast("string").alias("raw_value"), F.lit(True).alias("new_entity"),
    )
    item = grouped(rows, k=5).first()["items"][0]
    assert (item["n_values"], item["n_docs"], item["low"], item["high"], item["status"]) == (300000, 300000, 0.5, 999.5, "conflict")
    assert [v["doc_idx"] for v in item["values"]] == [0, 1, 2, 3, 4]
    plan = first_values(rows, "group_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert "values" not in entities(rows).columns
    few = rows.where("doc_idx < 40")
    whole = F.collect_list(F.struct(*(c for c in rows.columns if c != "group_id")))
    assert few.groupBy("group_id").agg(items_of(whole, 5).alias("items")).first()["items"] == grouped(few, k=5).first()["items"]
    empty = spark.createDataFrame([], DOC)
    assert compare(empty).count() == 0


# sinks


def test_rendered_documents_come_once_after_a_failure(spark, tmp_path):
    """A run that dies in a batch, with and without its files written, and one that goes on from its checkpoint."""
    from quillspark.plans.triage import analyze
    from quillspark.streaming import sinks

    schema = "doc_id long, text string"
    rows = [(i, f"The audit of site {i} reported 3.{i} percent, however it may change.") for i in range(40)]
    feed(spark, str(tmp_path / "in"), list(rows), schema, 20, 1)
    flag = tmp_path / "dies"
    flag.write_text("")

    def check(i, path=str(flag)):
        import os

        if i == 25 and os.path.exists(path):
            raise RuntimeError("killed")
        return i

    docs = stream(spark, str(tmp_path / "in"), schema).withColumn("doc_id", F.udf(check, "long")("doc_id"))
    want = {r["doc_id"]: r["value"] for r in sinks.rendered(spark.createDataFrame(rows, schema), "capsule").collect()}
    places = {k: str(tmp_path / k) for k in ("files", "files-log", "batches", "batches-log")}
    for start, name in ((sinks.write_rendered, "files"), (sinks.write_batches, "batches")):
        flag.write_text("")
        for fails in (True, False):
            if not fails:
                flag.unlink()
            query = start(docs, "capsule", places[name], places[f"{name}-log"], available=True)
            try:
                query.awaitTermination()
                assert not fails
            except Exception as e:  # noqa: BLE001  the stream's own error
                assert fails and "killed" in str(e)
        got = (sinks.read_rendered(spark, places[name]) if name == "files" else spark.read.parquet(places[name])).collect()
        assert len(got) == 40 and {r["doc_id"]: r["value"] for r in got} == want
    again = sinks.write_batches(docs, "capsule", places["batches"], str(tmp_path / "lost-log"), available=True)
    again.awaitTermination()
    assert spark.read.parquet(places["batches"]).count() == 40
    with pytest.raises(ValueError):
        sinks.rendered(analyze(spark.createDataFrame(rows, schema)), "poem")


def test_every_kind_of_rendering(spark):
    import json

    from quillspark.streaming import sinks

    docs = spark.createDataFrame([(1, "Act now!! This shocking secret is guaranteed."), (2, None)], "doc_id long, text string")
    for kind in sinks.KINDS:
        got = {r["doc_id"]: r["value"] for r in sinks.rendered(docs, kind, day=F.lit("2024-01-01").cast("date")).collect()}
        assert set(got) == {1, 2} and all(got.values())
        if kind in ("json", "envelope"):
            assert all(isinstance(json.loads(v), dict) for v in got.values())
