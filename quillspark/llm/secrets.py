"""Secrets in texts, with native columns only.

Patterns find assignments, access keys and hexadecimal strings. Beside them, runs of 20 or more key
characters are candidates: a window slides over a candidate's characters, and the window's Shannon entropy
follows from counts that change by one character in and one out. A candidate is a secret if its highest
entropy reaches the threshold of its character class, unless an allow-listed form explains it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.spans import clear_of_base, listed, matches, named

# The forms asked for.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same as every run of which those below 24 are dropped
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<s:int,k:int,e:int,kind:string,m:string>"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes from the narrowest, with the entropy in bits that a random window of 20 exceeds.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
_WORD = r"(?:[A-Z]{1,24}|[A-Z]?[a-z]{1,24})"
#: Forms that are no secrets however mixed: one case or a capital first, no letter, UUIDs, slugs of such words and short numbers.
ALLOWED = (r"^[+/_=-]*(?:[A-Z]+|[A-Z]?[a-z]+)[+/_=-]*$", r"^[^A-Za-z]+$", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", rf"^[+/_=-]*(?:{_WORD}|[0-9]{{1,8}})(?:[+/_=-]+(?:{_WORD}|[0-9]{{1,8}}))+[+/_=-]*$")


def window_entropy(candidate: Column, window: int = 20) -> Column:
    """Highest Shannon entropy in bits of a window of the candidate's characters."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    costs = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 1)))
    zero = F.array_repeat(F.lit(0), len(ALPHABET))

    def cost(n: Column) -> Column:
        return F.element_at(costs, n + 1)

    def step(acc: Column, code: Column) -> Column:
        full = acc["i"] >= window
        out = F.when(full, F.element_at(acc["last"], 1)).otherwise(F.lit(0))
        n_out = F.when(full, F.element_at(acc["n"], out)).otherwise(F.lit(0))
        without = acc["sum"] - F.when(full, cost(n_out) - cost(n_out - 1)).otherwise(F.lit(0.0))
        n_in = F.element_at(acc["n"], code) - F.when(code == out, F.lit(1)).otherwise(F.lit(0))
        total = without + cost(n_in + 1) - cost(n_in)
        counts = F.transform(acc["n"], lambda v, k: v + F.when(k + 1 == code, F.lit(1)).otherwise(F.lit(0)) - F.when(k + 1 == out, F.lit(1)).otherwise(F.lit(0)))
        last = F.concat(F.when(full, F.slice(acc["last"], 2, window)).otherwise(acc["last"]), F.array(code))
        # before the window is full its sum must not count as the least one
        bound = F.when(acc["i"] + 1 >= window, total).otherwise(F.lit(window * math.log2(window)))
        return F.struct((acc["i"] + 1).alias("i"), counts.alias("n"), total.alias("sum"), F.when(acc["i"] + 1 == window, total).otherwise(F.least(acc["least"], bound)).alias("least"), last.alias("last"))

    state = F.struct(F.lit(0).alias("i"), zero.alias("n"), F.lit(0.0).alias("sum"), F.lit(window * math.log2(window)).alias("least"), F.array().cast("array<int>").alias("last"))
    return F.aggregate(codes, state, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def _secret(candidate: Column, window: int) -> Column:
    allowed = F.lit(False)
    for form in ALLOWED:
        allowed = allowed | candidate.rlike(form)
    threshold = F.lit(None).cast("double")
    for _, form, bits in reversed(CLASSES):
        threshold = F.when(candidate.rlike(form), F.lit(bits)).otherwise(threshold)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(window_entropy(candidate, window) >= threshold, F.lit(False)))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """doc_id, base and spans: arrays of (s, k, e, kind, m), sorted; base has the patterns' spans, spans all.

    A null text is empty and has none; an entropy span never overlaps a base one. Repeated rows stay, other
    columns are ignored, an empty table gives no rows.
    """
    t = F.col("__t")
    value = F.regexp_extract
    base = F.concat(
        named(matches(t, ASSIGN, t.rlike(ASSIGN)), "assign", 0, lambda m: F.length(value(m, ASSIGN, 1)) >= 6),
        named(matches(t, ACCESS, t.contains("AKIA")), "access", 1, lambda m: F.length(m) >= 20),
        named(matches(t, HEX, t.rlike(HEX)), "hex", 2),
    )
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    rows = rows.select("doc_id", base.alias("base"), named(matches(t, CANDIDATE, t.rlike(CANDIDATE)), "entropy", 3, lambda m: _secret(m, window)).alias("more"))
    spans = F.when(F.size("more") == 0, F.array_sort("base")).otherwise(clear_of_base(F.concat("base", "more"), len(KINDS) - 1, SPAN))
    return rows.select("doc_id", F.array_sort("base").alias("base"), spans.alias("spans"))


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
