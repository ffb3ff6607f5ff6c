"""Matches with their places, as native columns. Places count code points; ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

MATCHES = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing, with their places.

    gate: a cheaper condition without which there can't be one; text must not be null.
    """
    found = T.matches(text, pattern)
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast(MATCHES))


def named(found: Column, kind: str, order: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """(s, order, e, kind, m) of the matches that are valid."""
    kept = F.filter(found, lambda x: valid(x["m"])) if valid else found
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then by the order of the kinds, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def clear_of_base(spans: Column, kinds: int, span: str) -> Column:
    """Spans without those of kinds from ``kinds`` on that overlap one below, sorted; span is their type.

    One pass in order has the furthest end of the base spans before each, one in reverse the nearest start behind.
    """
    marked = f"struct<x:{span},hit:boolean>"
    base = lambda x: x["k"] < kinds
    ahead = T.scan(F.array_sort(spans), F.lit(0), "int", marked, lambda end, x: F.when(base(x), F.greatest(end, x["e"])).otherwise(end), lambda end, x: F.struct(x, ~base(x) & (x["s"] < end)))
    back = T.scan(F.reverse(ahead), F.lit(2**31 - 1), "int", marked, lambda at, y: F.when(base(y["x"]), y["x"]["s"]).otherwise(at), lambda at, y: F.struct(y["x"], y["hit"] | (~base(y["x"]) & (at < y["x"]["e"]))))
    return F.reverse(F.transform(F.filter(back, lambda y: ~y["hit"]), lambda y: y["x"]))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with label(span) in place of each span; overlapping ones leave one label."""

    def rebuilt(cut: Column, spans: Column) -> Column:
        one = lambda at, x: F.when(x["s"] >= at, F.concat(T.piece(cut, at, x["s"] - at), label(x))).otherwise(F.lit(""))
        parts = T.scan(spans, F.lit(0), "int", "string", lambda at, x: F.greatest(at, x["e"]), one)
        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(parts, ""), T.piece(cut, end, F.length(text) - end))

    return F.when(F.size(spans) == 0, text).otherwise(T.bound(F.array_sort(spans), lambda x: T.bound(T.pieces(text), lambda cut: rebuilt(cut, x))))
