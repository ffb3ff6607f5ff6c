"""An assessment takes the text's lower case and numbers of matches from its features."""

from quillspark.plans.triage import analyze


def test_an_assessment_looks_at_a_text_once(spark):
    """Custody and each kind of brief made the lower case again, and clues looked for matches that weren't there."""
    plan = analyze(spark.createDataFrame([(1, "a text")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text#") <= 3
    assert all(f"n_{k} > 0" in plan for k in ("evidence", "hype", "urgency", "certainty"))
