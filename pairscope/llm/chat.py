"""Chat formatting of reply trees.

Messages form trees by parent. Root-to-leaf paths come from iterative self-joins of the ancestor table (the distance
doubles each round), branches are ranked by the sum of their messages' scores, and each chosen path is one conversation
in a template with turn marks. Control strings inside texts are escaped reversibly; a loss mask marks the assistant texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairscope.llm.common import workers_import
from pairscope.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


# escaping ------------------------------------------------------------------------------------------------
# '<', some backslashes, '|' gets one more backslash, so a text never holds '<|' and every mark is the template's own
def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return regex.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """A role fills one line: backslashes are doubled and line ends written as \\n."""
    flat = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(flat)


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


# trees ---------------------------------------------------------------------------------------------------
def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as trees without branches: columns conv, node, parent, role, text, score.

    Rows follow by turn, null first, ties by role and text; repeated rows are turns of their own.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    placed = rows.withColumn("node", place.cast("bigint"))
    return placed.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of trees (conv, node, parent): columns conv, leaf, node, back (steps from the leaf).

    A message whose parent does not exist is a root. Messages on a cycle are an error. ``node`` is unique in a
    conversation; null conversations are one conversation.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    all_nodes = cut_lineage(nodes.select("conv", key.alias("tree"), "node", "parent"))
    known = all_nodes.select("tree", F.col("node").alias("parent"))
    up = cut_lineage(all_nodes.select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("ancestor")))
    leaves = all_nodes.join(up.select("tree", F.col("ancestor").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = leaves.select("conv", "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("back"))
    step, most = 1, None
    while not up.isEmpty():
        if most is None:
            most = all_nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
        if step > most:
            raise ValueError("messages on a cycle have no root")
        # every path so far reaches step - 1 back from its leaf; its copies shifted by step double that
        moved = found.join(up, ["tree", "node"]).select("conv", "tree", "leaf", F.col("ancestor").alias("node"), (F.col("back") + step).alias("back"))
        found = cut_lineage(found.unionByName(moved))
        far = up.select("tree", F.col("ancestor").alias("node"), F.col("node").alias("below"))
        up = cut_lineage(far.join(up, ["tree", "node"]).select("tree", F.col("below").alias("node"), "ancestor"))
        step *= 2
    return found.drop("tree")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv, leaf, branch, place (from 0 at the root), role, text of the ``branches`` best paths of each conversation.

    A path's rank is by the sum of its messages' scores (null: 0), ties by the smaller leaf.
    """
    steps = paths(nodes)
    scores = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = steps.join(scores, steps["conv"].eqNullSafe(scores["c"]) & (steps["node"] == scores["n"])).drop("c", "n")
    rated = scored.groupBy("conv", "leaf").agg(F.sum("score").alias("total"), F.max("back").alias("length"))
    ranked = rated.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("total").desc(), "leaf")))
    best = ranked.where(F.col("branch") <= branches).select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "branch", "length")
    chosen = cut_lineage(steps.join(best, steps["conv"].eqNullSafe(best["c"]) & (steps["leaf"] == best["l"])).select(
        "conv", "leaf", "node", "branch", (F.col("length") - F.col("back")).alias("place")))
    # the texts join last, once
    said = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    return chosen.join(said, chosen["conv"].eqNullSafe(said["c"]) & (chosen["node"] == said["n"])).select(
        "conv", "leaf", "branch", "place", "role", "text")


def format_paths(chosen: DataFrame) -> DataFrame:
    """One row per conversation and branch: conv, branch, formatted, loss_mask (array of start, end in code points).

    Null roles and texts are empty. One conversation is one string, so its turns meet in one row.
    """
    turn = F.struct("place", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
                    (F.col("role") == LEARNED_ROLE).alias("learned"))
    rows = chosen.withColumn("turn", turn).groupBy("conv", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    tail = f"{END}\n"
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(tail))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def follow(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        end = start + F.length(t["text"])
        span = F.when(t["learned"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(tail)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    mask = F.aggregate("turns", empty, follow, lambda s: s["spans"])
    return rows.select("conv", "branch", formatted.alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the template."""
    out = []
    for part in formatted.split(START)[1:]:
        if not part.endswith(f"{END}\n"):
            raise ValueError("a turn has no end mark")
        role, _, text = part[: -len(END) - 1].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the output gets: conv, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    workers_import(formatted.sparkSession)

    def digest(text: str, mask: list[dict]) -> tuple[int, str, int, str, int]:
        turns = parse(text)
        learned = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        return len(turns), _sha(whole), len(learned), _sha(learned), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t.as_py(), m.as_py()) for t, m in zip(batch.column(2), batch.column(3), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["conv", "branch", *_DIGESTS])

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.select("conv", "branch", "formatted", "loss_mask").mapInArrow(
        run, f"conv {kind}, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) and conversation -1, whose two texts hold control strings."""
    said = F.lit(f"{END}{START}assistant ok")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_report(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and the digests of its formatted form. An empty table gives none."""
    return read_back(format_paths(chosen_paths(cut_lineage(chain(turns))))).select(F.col("conv").alias("conv_id"), *_DIGESTS)
