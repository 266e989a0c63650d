"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a measure of it. On a bounded sample the cascade times every measure and counts
what its rules reject, and orders the rules by rejection per cost; a document is evaluated in that order and
only as far as its first rejection. The verdict does not depend on the order, the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairscope.functions.shaping import computed_once
from pairscope.llm.common import fresh, let, words

#: Rows that cost and selectivity are estimated on, and the characters one of them has at most; verdicts come from every row.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 50_000
#: Characters that mark debris of markup and tables.
SYMBOLS = "[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


# measures: a text column and its words -> a long ------------------------------------------------------------
def n_words(text: Column, tokens: Column) -> Column:
    return F.size(tokens).cast("bigint")


def word_chars(text: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w))


def n_symbols(text: Column, tokens: Column) -> Column:
    return (F.size(F.split(text, SYMBOLS)) - 1).cast("bigint")


def n_dup_lines(text: Column, tokens: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(text: Column, tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by 64-bit hash. Sorted by hash, a repeated window equals a neighbour; the places of
    those, sorted again, cover three words each, less where the next one starts earlier.
    """
    n = F.size(tokens)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))

    def covered(found: Column) -> Column:
        many = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(many, _covered(found)).otherwise(0)

    return F.when(n < 4, 0).otherwise(let(windows, covered)).cast("bigint")


def _covered(windows: Column) -> Column:
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(found: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(found, k).getField("h") == x.getField("h"), F.lit(False))

        repeated = F.filter(found, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(repeated, lambda x: x.getField("i")))

    def total(at: Column) -> Column:
        own = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    return let(let(ordered, places), total)


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures by name to a condition; ``needs`` names those it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("short", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repetitive", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_words"), lambda m: 10 * m["n_dup_lines"] > m["n_words"]),
    Rule("short_words", ("word_chars", "n_words"), lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", ("word_chars", "n_words"), lambda m: m["word_chars"] > 14 * m["n_words"]),
)


def _prepared(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """``docs`` with two helper columns, the measures as expressions over them, the helpers' names."""
    text, tokens = fresh(docs, "_text", "_tokens")
    df = computed_once(docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))), tokens, words(text_col))
    return df, {name: m(F.col(text), F.col(tokens)) for name, m in MEASURES.items()}, [text, tokens]


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per second on a sample, largest first; ties and an empty table keep the given order."""
    # the head of the table: a few partitions are read, not all of them
    head = docs.select(F.col(text_col).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).take(sample_rows)
    if not head:
        return list(rules)
    sample = docs.sparkSession.createDataFrame([(r["text"],) for r in head], "text string").persist()
    try:
        df, measures, _ = _prepared(sample, "text")

        def timed(condition: Column) -> tuple[int, float]:
            began = time.perf_counter()
            return df.agg(F.count_if(condition).alias("r")).first()["r"], time.perf_counter() - began

        timed(F.lit(False))  # fills the cache
        _, idle = timed(measures["n_words"] < 0)
        rated = []
        for place, rule in enumerate(rules):
            rejected, seconds = timed(rule.rejects(measures))
            rated.append((-rejected / max(seconds - idle, 1e-3), place))
        return [rules[place] for _, place in sorted(rated)]
    finally:
        sample.unpersist()


def first_rejection(measures: Mapping[str, Column], rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(out)
    return out


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: <id_col>, the five measures, base_failed, kept.

    Null, empty and blank texts measure zero and fail. Repeated rows are repeated, an empty table gives none, and
    other columns are ignored. ``kept`` is whether no rule rejects; it does not depend on the order of the rules.
    """
    df, measures, _ = _prepared(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_body")
    table = df.select(F.col("_id").alias(id_col), *[c.alias(name) for name, c in measures.items()])
    values = {name: F.col(name) for name in measures}
    ordered = order_rules(docs, rules, text_col)
    return table.select(
        "*", first_rejection(values, BASE_RULES).isNotNull().alias("base_failed"), first_rejection(values, ordered).isNull().alias("kept"))


def passing(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; repeated rows are judged alike."""
    df, measures, helpers = _prepared(docs, text_col)
    return df.where(first_rejection(measures, order_rules(docs, rules, text_col)).isNull()).drop(*helpers)
