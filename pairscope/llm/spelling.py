"""Spelling variant grouping by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly when their common prefix and suffix together reach
the longer length minus one. For a longer length M, either the first M // 2 code points agree or the last M - M // 2 do, so
words meet in tiles of equal halves. A tile is compared densely: its words are two padded code-point matrices, one aligned left
and one right, every row against every row. Tiles above ``TILE`` words are cut into blocks, and each pair of blocks is a task of
its own; what leaves a tile is one row per word, its count and best partner, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairscope.llm.common import workers_import
from pairscope.session import cut_lineage

#: One in so many runs loses a code point, and which one: both from the CRC of identifier and run.
DROPPED_OF = 199
SHORTEST, RAREST = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Words of a tile that are compared at once.
TILE = 512
_CELLS = 1 << 22
#: Distinct words a task counts before it hands them on.
_COUNTED = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def altered(doc_id: object, run: str) -> str:
    """The run, or the run without one code point."""
    code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if code % DROPPED_OF:
        return run
    k = code % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns word, n over all rows, of words of ``SHORTEST`` code points or more and ``RAREST`` occurrences or more.

    Null texts have no words; a null identifier counts as an empty text in the CRC; repeated rows count as often as they occur.
    """
    workers_import(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run, n in Counter(_RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                    if len(run) >= SHORTEST and len(word := altered(one, run)) >= SHORTEST:
                        total[word] += n
            if len(total) > _COUNTED:
                yield told()
                total.clear()
        yield told()

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns longer, tail, words: the members of each tile or pair of blocks, most frequent first, with their block."""
    length = F.char_length("word")
    halves = []
    for more in (0, 1):
        longer = length + more
        first = F.floor(longer / 2).cast("int")
        halves += [F.struct(longer.alias("longer"), F.lit(False).alias("tail"), F.left("word", first).alias("half")),
                   F.struct(longer.alias("longer"), F.lit(True).alias("tail"), F.right("word", longer - first).alias("half"))]
    keys = ["longer", "tail", "half"]
    rows = words.select("word", "n", F.explode(F.array(*halves)).alias("k")).select("word", "n", "k.*")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / tile).cast("int")
    dealt = rows.join(sizes, keys).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    paired = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = F.struct((-F.col("n")).alias("less"), "word", "block")
    return (
        paired.groupBy(*keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .agg(F.array_sort(F.collect_list(member)).alias("words")).where(F.size("words") > 1)
        .select("longer", "tail", (F.col("low") != F.col("high")).alias("crossed"), "words"))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and, reversed, right; zeros fill the rest. Lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int32)
    width = int(lengths.max())
    left = np.array([w.ljust(width, "\0") for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    right = np.array([w[::-1].ljust(width, "\0") for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of ``a`` and each of ``b``: leading axis tiles, then rows."""
    same = a[:, :, None, :] == b[:, None, :, :]
    return np.where(same.all(axis=-1), a.shape[-1], same.argmin(axis=-1))


def compared(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, longer: np.ndarray, tail: np.ndarray,
             crossed: np.ndarray, rows: slice) -> np.ndarray:
    """Whether words are near, for tiles of one size: [tile, word of ``rows``, word]."""
    prefix, suffix = _common(left[:, rows], left), _common(right[:, rows], right)
    most = np.maximum(lengths[:, rows, None], lengths[:, None, :])
    one = (prefix + suffix >= most - 1) & (most == longer[:, None, None]) & (prefix + suffix < 2 * left.shape[-1])
    # lengths that differ by more never reach the longer one minus one; a pair in both kinds of tile counts in the first
    one &= ~tail[:, None, None] | (prefix < longer[:, None, None] // 2)
    return one & (~crossed[:, None, None] | (blocks[:, rows, None] != blocks[:, None, :]))


def neighbours(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns word, n_near, less, form: how many words are near, minus the count of the most frequent, and that word.

    ``words`` has distinct word, n. Ties of the most frequent go to the smallest word in code-point order.
    """
    workers_import(words.sparkSession)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            longer, tail, crossed = (np.array(batch.column(k).to_pylist()) for k in range(3))
            members = batch.column(3).flatten()
            less, text, block = (members.field(k) for k in range(3))
            ends = np.cumsum([len(w) for w in batch.column(3)])
            sizes = np.diff(ends, prepend=0)
            spelled = text.to_pylist()
            left, right, lengths = _matrices(spelled)
            block = np.asarray(block)
            counts, best = np.zeros(len(spelled), dtype=np.int64), np.zeros(len(spelled), dtype=np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                step = max(1, _CELLS // int(size * size * left.shape[1]))
                for k in range(0, len(mine), step):
                    some = mine[k:k + step]
                    at = (ends[some] - size)[:, None] + np.arange(size)
                    # a large tile goes row block by row block
                    high = max(1, _CELLS // int(size * left.shape[1] * len(some)))
                    for r in range(0, size, high):
                        found = compared(left[at], right[at], lengths[at], block[at], longer[some], tail[some], crossed[some], slice(r, r + high))
                        counts[at[:, r:r + high]] = found.sum(axis=-1)
                        best[at[:, r:r + high]] = np.take_along_axis(at[:, None, :], found.argmax(axis=-1)[..., None], axis=-1)[..., 0]
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [text.take(pa.array(some)), pa.array(counts[some]), less.take(pa.array(best[some])), text.take(pa.array(best[some]))],
                names=["word", "n_near", "less", "form"])

    found = tiles(words, tile).mapInArrow(near, "word string, n_near bigint, less bigint, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best")).select("word", "n_near", "best.*")


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root: where the forms end that lead on from each word of ``forms`` (word, form; no circles).

    Each round joins the pointers with themselves and so doubles their reach.
    """
    ahead = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut_lineage(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        ahead = ahead.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of most occurrences (ties: smallest in code-point order) if those are ``TIMES`` its own or
    more; the root is the last form. See ``word_counts`` for nulls and repeats; other columns are ignored; a table without such
    words gives no rows. Forms are always more frequent than their variants, so they cannot lead in a circle.
    """
    words = cut_lineage(word_counts(docs, id_col, text_col))
    close = words.join(neighbours(words, tile), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("less") >= TIMES * F.col("n"), F.struct("form", (-F.col("less")).alias("form_n"))).alias("f"))
    named = cut_lineage(close.select("word", "n", "n_near", "f.form", "f.form_n"))
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
