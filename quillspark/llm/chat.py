"""Conversations from reply trees.

A table of nodes names each one's parent. Self-joins that double the distance each time give every node
its ancestor 2**k steps up, the number of nodes to the root and the sum of their scores; a leaf's sum ranks
its branch. The same tables, joined to the chosen leaves, list the nodes of their paths. A path becomes one
text whose marks can't occur in what people wrote: a turn is ``<turn ROLE>``, a line break, the text and
``</turn>``, a line break; inside, a backslash stands before every backslash and every mark.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Stored, cut

_TURN = re.compile(r"<turn ((?:[^\\>]+|\\.)*+)>\n((?:[^\\<]+|\\.|<(?!turn |/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in ("<turn ", "</turn>"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return out


def _steps(nodes: DataFrame) -> list[DataFrame]:
    """Tables of (tree, node, up, n, total): up is 2**k steps above; n and total count and sum the scores of the nodes below up."""
    level = cut(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("n"), F.col("score").alias("total")))
    levels, most = [level], max(1, level.count())
    for _ in range(math.ceil(math.log2(most + 1)) + 1):
        rest = level.where("up IS NOT NULL")
        if rest.isEmpty():
            break
        above = level.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        more = rest.join(above, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        level = cut(level.where("up IS NULL").unionByName(more))
        levels.append(level)
    return levels


def format_trees(nodes: DataFrame, *, branches: int = 1, answers: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree_id, branch (from 1), leaf, score, n_turns, formatted, loss.

    nodes: tree_id, node_id, parent_id, role, text, score; the node_ids of a tree differ. A tree's
    branches are ranked by the sum of their scores (null: 0), ties by the leaf's id. loss: the spans
    (start, end; code points of formatted) of the escaped texts of the role ``answers``. Null roles and texts
    are empty; a null parent or one that isn't there makes a root; nodes whose parents form a ring reach no
    root and are left out; rows without tree_id form a tree of their own, and those without node_id are left
    out. An empty table gives no rows. A path is one text, so it must fit in memory.
    """
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit(""))
    rows = nodes.where(F.col("node_id").isNotNull()).select(tree.alias("tree"), F.col("tree_id"), F.col("node_id").cast("bigint").alias("node"), F.col("parent_id").cast("bigint").alias("parent"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    levels = _steps(rows.select("tree", "node", "parent", "score"))
    parents = rows.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = levels[-1].where("up IS NULL").join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = cut(leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select("tree", F.col("node").alias("leaf"), "branch", F.col("total").alias("path_score")))
    path = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("above"))
    for k, level in enumerate(levels[:-1]):
        up = level.where("up IS NOT NULL").select("tree", "node", "up")
        path = path.unionByName(path.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above")))
        if k % 3 == 2:
            path = Stored(path, "paths").df
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\>")), F.lit(">\n"))
    turns = path.join(rows.select("tree", "tree_id", "node", "role", "text"), ["tree", "node"])  # a parent that isn't there has no row
    turns = turns.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == answers, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    whole = turns.groupBy("tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    return whole.join(chosen, ["tree", "leaf"]).select("tree_id", "branch", "leaf", F.col("path_score").alias("score"), "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of conversations whose rows follow each other by turn (ties by role and text): chains without scores."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("bigint"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from formatted and loss."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for key, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns, h = parse(text), hashlib.sha256()
                for role, said in turns:
                    h.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                out.append((key, len(turns), h.hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], names=["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col("tree_id").cast("bigint").alias("tree_id"), "formatted", "loss")
    return rows.mapInArrow(run, "tree_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
