"""analyze(): a corpus to assessments, one row each, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import resolve as R
from quillspark.operators import scoring as S
from quillspark.operators.briefs import brief, brief_by_genre


WORKING = ("__f_", "__r_", "__s_", "__d_")


def scored(docs: DataFrame, *only: str) -> DataFrame:
    """docs (without columns of these names) with the struct columns f, r, s and d: features, resolution, unrounded scores, decisions.

    The structs hang on a condition that is no constant to the optimizer: else a filter on one of their
    fields would be pushed down with the whole tree of expressions in its place. That keeps fields which nobody
    reads, too; only names those to keep, as "s.overall", and what they don't need is never computed.
    """
    rows = S.decisions(S.scores(S.resolved(S.features(S.document(docs)))))
    flat = [c for c in rows.columns if c[:4] in WORKING]
    kept = [c for c in flat if not only or f"{c[2]}.{c[4:]}" in only]
    here = F.spark_partition_id() >= 0
    own = [c for c in rows.columns if c not in flat]
    made = {k[2]: [F.col(c).alias(c[4:]) for c in kept if c.startswith(k)] for k in WORKING}
    return rows.select(*own, *(F.when(here, F.struct(*fields)).alias(k) for k, fields in made.items() if fields))


#: score: the working column that it is.
SCORES = {"signal": "s.signal", "noise": "s.noise", "pressure": "s.pressure", "source_custody": "s.custody", "source_custody_raw": "s.custody_raw", "source_custody_adjusted": "s.custody", "certainty_bias": "s.certainty_bias", "specificity": "s.specificity", "evidence": "s.evidence", "attribution": "f.attribution", "bias_risk": "s.bias_risk", "manipulation_risk": "s.manipulation_risk", "certainty_to_evidence_gap": "s.gap", "internal_coherence": "s.coherence", "overall_confidence": "s.overall"}


def score_struct(*only: str) -> Column:
    """The scores, or those that are named."""
    return F.struct(*(T.py_round(F.col(c), 3).alias(k) for k, c in SCORES.items() if not only or k in only))


def brief_column(*only: str) -> Column:
    """The brief, or its fields that are named."""
    make = lambda kind: brief(F.col("text"), F.col("f.sentences"), F.col("r.effective"), F.col("f.genre"), F.col("f.providers"), F.col("f.venues"), kind, only, F.col("f.lower"))
    return brief_by_genre(make, F.col("f.genre"))


def _once(column: Column) -> Column:
    """A column behind the same condition as in scored(): a struct is otherwise made anew for each mention of a field."""
    return F.when(F.spark_partition_id() >= 0, column)


def with_briefs(docs: DataFrame) -> DataFrame:
    """docs with a column ``signal_brief``, that of analyze(), without the scores that it doesn't need."""
    rows = scored(docs, *NEEDS["signal_brief"])
    return rows.withColumn("signal_brief", _once(brief_column())).drop("f", "r")


def assess(rows: DataFrame, with_brief: bool = True, only: tuple[str, ...] = ()) -> DataFrame:
    """scored() rows with one struct column ``assessment`` in place of the working columns.

    only: the fields to keep, those of scores and signal_brief as "scores.pressure"; what no one of them needs isn't computed.
    """
    text, r3 = F.col("text"), lambda c: T.py_round(F.col(c), 3)
    keep = [c for c in rows.columns if c not in ("f", "r", "s", "d")]
    part = lambda struct: tuple(n.partition(".")[2] for n in only if n.startswith(f"{struct}."))
    wanted = lambda name: not only or name in only or bool(part(name))
    later = {
        "evidence_clues": lambda: F.col("c.evidence_clues"), "pressure_clues": lambda: F.col("c.pressure_clues"),
        "custody_breakdown": lambda: R.custody_breakdown(text, F.col("r.effective"), F.col("r.confidence"), *(F.col(f"f.{c}") for c in ("providers", "venues", "ascii", "lower"))),
        "evidence_shape": lambda: R.evidence_shape(text, *(F.col(f"f.{c}") for c in ("providers", "venues", "vocabulary", "listed", "ascii", "pairs", "lower"))),
        **({"signal_brief": lambda: brief_column(*part("signal_brief"))} if with_brief else {}),
    }
    rows = S.clues(rows) if wanted("evidence_clues") or wanted("pressure_clues") else rows
    rows = rows.withColumns({f"__{k}": _once(make()) for k, make in later.items() if wanted(k)})
    fields = {
        "kind": lambda: F.lit("heuristic"), "source_name": lambda: F.col("source_name"), "source_type": lambda: F.col("r.effective"), "declared_source_type": lambda: F.col("r.declared"), "inferred_source_type": lambda: F.col("r.inferred"),
        "source_type_confidence": lambda: r3("r.confidence"), "source_url": lambda: F.col("source_url"), "word_count": lambda: F.col("f.n_words"), "language_note": lambda: F.when(F.col("f.non_english"), S.FLAGS["language"]).otherwise(""),
        "verdict": lambda: T.lookup(F.col("d.verdict"), {k: t for k, (_, t) in S.VERDICTS.items()}, None), "recommended_action": lambda: F.col("d.action"), "triage_summary": lambda: F.col("d.triage"), "scores": lambda: score_struct(*part("scores")),
        "confidence_band": lambda: F.struct(r3("s.low").alias("low"), r3("s.high").alias("high")), "custody_label": lambda: T.lookup(F.col("s.label_type"), S.CUSTODY_LABELS, S.CUSTODY_LABELS["unknown"]), "custody_warning_level": lambda: F.col("s.warning"),
        "evidence_breakdown": lambda: F.struct("f.anchored", "f.unanchored"), "flags": lambda: S.worded(F.col("d.flags"), S.FLAGS), "evidence_clues": lambda: F.col("__evidence_clues"), "pressure_clues": lambda: F.col("__pressure_clues"), "questions_to_ask": lambda: S.worded(F.col("d.questions"), S.QUESTIONS),
        "ai_instruction": lambda: F.lit(S.NOTE), "source_genre": lambda: F.col("f.genre"), "custody_breakdown": lambda: F.col("__custody_breakdown"), "evidence_shape": lambda: F.col("__evidence_shape"),
        **({"signal_brief": lambda: F.col("__signal_brief")} if with_brief else {}),
    }
    return rows.select(*keep, F.struct(*(make().alias(k) for k, make in fields.items() if wanted(k))).alias("assessment"))


#: field of an assessment: the working columns that it reads, where only some fields are kept.
NEEDS = {
    "source_type": ("r.effective",), "recommended_action": ("d.action",), "triage_summary": ("d.triage",), "confidence_band": ("s.low", "s.high"), "custody_warning_level": ("s.warning",), "flags": ("d.flags",),
    "source_genre": ("f.genre",), "signal_brief": ("f.sentences", "f.genre", "f.providers", "f.venues", "f.lower", "r.effective"), **{f"scores.{k}": (c,) for k, c in SCORES.items()},
}


def needed(*only: str) -> tuple[str, ...]:
    """The working columns that these fields of an assessment read."""
    return tuple(dict.fromkeys(c for name in only for c in NEEDS.get(name) or NEEDS[name.partition(".")[0]]))


def analyze(docs: DataFrame, with_brief: bool = True, only: tuple[str, ...] = ()) -> DataFrame:
    """docs (text, and optionally source_type, source_name, source_url) with a column ``assessment``.

    only: as of assess(), names in NEEDS. Null texts are empty. Other columns pass through, whatever their names; one named assessment gives way.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c in ("f", "r", "s", "d", "c")}
    done = assess(scored(docs.drop("assessment").withColumnsRenamed(own), *needed(*only)), with_brief, only)
    return done.withColumnsRenamed({new: old for old, new in own.items()})
