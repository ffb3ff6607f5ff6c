"""SQL functions whose bodies are the engine's columns: native, without Python workers.

``register(spark)`` makes these temporary functions of the session:

    triage(text, source_type, source_url)   struct of action, verdict, genre, source_type, overall, flags, questions
    claim_list(text)                        array of numeric claims, one for each entity and number
    numeric_claims(text)                    table function of the same claims, for LATERAL

    SELECT doc_id, triage(text, 'auto', '').action FROM documents
    SELECT d.doc_id, c.* FROM documents d, LATERAL numeric_claims(d.text) c
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import claims as K
from quillspark.operators import scoring as S

_OPERATORS = r"<=>|<=|>=|==|!=|=|<|>|\+|-|\*|/|%|!|\|\||\||&|\^|and|or|not|in|rlike|like|exists|if"
_PART = re.compile(rf"'(?:\\.|[^'\\])*'|`[^`]*`|->|(?<![\w.`])({_OPERATORS})\(|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])|(?<![\w.'])([A-Za-z_]\w*)(?![\w(])")


def text_of(column: Column, names: dict[str, str] | None = None) -> str:
    """A column as SQL text. Operators become calls by quoted name and decimals doubles; names stand in for columns."""

    def part(m: re.Match) -> str:
        if m.group(1):
            return f"`{m.group(1)}`("
        if m.group(2):
            return m.group(2) + "D"
        return names.get(m.group(3), m.group(0)) if names and m.group(3) else m.group(0)

    return _PART.sub(part, column._jc.node().sql())


class _Recorded:
    """Stands in for a table: keeps the columns that steps add, in order, instead of adding them."""

    def __init__(self, columns: list[str], steps: tuple = ()):
        self.columns, self.steps = columns, steps

    def withColumns(self, new: dict[str, Column]) -> _Recorded:  # noqa: N802  as of a table
        return _Recorded([*self.columns, *(c for c in new if c not in self.columns)], (*self.steps, new))


def nested(steps: tuple, start: dict[str, str], wanted: dict[str, str], schema: str) -> str:
    """One SQL expression of all steps: each binds a struct with the columns so far, so nothing is computed twice.

    Only columns that a later step or ``wanted`` mentions are computed. wanted: the result's fields and their columns.
    """
    mentioned = lambda texts: set(re.findall(r"\w+", " ".join(texts)))
    plain = [{k: c._jc.node().sql() for k, c in step.items()} for step in steps]
    needed, kept = set(wanted.values()), []
    for step in reversed(plain):
        used = [k for k in step if k in needed]
        kept.append(used)
        needed = (needed - set(used)) | mentioned(step[k] for k in used)
    out, have, close = "", dict(start), ""
    for i, (step, used) in enumerate(zip(steps, reversed(kept))):
        if not used:
            continue
        fresh = {k: text_of(step[k], have) for k in used}
        fields = ", ".join(f"'{k}', {v}" for k, v in {**have, **fresh}.items())
        out, close = f"{out}get(transform(array(named_struct({fields})), r{i} -> ", f"), 0){close}"
        have = {k: f"r{i}.{k}" for k in {**have, **fresh}}
    made = ", ".join(f"'{name}', {have[c]}" for name, c in wanted.items())
    return f"CAST({out}named_struct({made}){close} AS {schema})"


TRIAGE = "STRUCT<action: STRING, verdict: STRING, genre: STRING, source_type: STRING, overall: DOUBLE, flags: ARRAY<STRING>, questions: ARRAY<STRING>>"
_TRIAGE = {"action": "__d_action", "verdict": "__d_verdict", "genre": "__f_genre", "source_type": "__r_effective", "overall": "__s_overall", "flags": "__d_flags", "questions": "__d_questions"}
CLAIM = "STRUCT<pos: INT, entity_key: STRING, entity_label: STRING, raw_value: STRING, numeric_value: DOUBLE, unit: STRING>"


def triage_body() -> str:
    rows = S.decisions(S.scores(S.resolved(S.features(S.document(_Recorded(["text", "source_type", "source_url"]))))))
    return nested(rows.steps, {"text": "doc_text", "source_type": "doc_type", "source_url": "doc_url"}, _TRIAGE, TRIAGE)


def claims_body() -> str:
    found = K.claim_array(F.col("doc_text"))
    listed = F.transform(found, lambda c: F.struct(c["pos"], c["key"], c["label"], c["raw"], c["number"], K.unit(c["raw"])))
    return f"CAST({text_of(listed)} AS ARRAY<{CLAIM}>)"


def register(spark: SparkSession) -> None:
    """Makes the functions of this module in the session; again, if they are there."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION triage(doc_text STRING, doc_type STRING, doc_url STRING) RETURNS {TRIAGE} RETURN {triage_body()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION claim_list(doc_text STRING) RETURNS ARRAY<{CLAIM}> RETURN {claims_body()}")
    fields = CLAIM[len("STRUCT<") : -1].replace(":", "")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION numeric_claims(doc_text STRING) RETURNS TABLE({fields}) RETURN SELECT c.* FROM (SELECT explode(found) AS c FROM (SELECT claim_list(doc_text) AS found))")
