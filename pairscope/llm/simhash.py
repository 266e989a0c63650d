"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 2r or less share a point at distance r or less from both. Every
distinct fingerprint emits all points of its ball of radius r (for 2 bits: itself and its 64 one-bit
variants), points are shuffled, and fingerprints that meet at a point are verified pairs. Copies collapse
before that, so a point holds at most one ball of distinct fingerprints (65 of them), however large a
group of documents is, and one edge per fingerprint and point links all that meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from pairscope.functions.graph import connected_components
from pairscope.llm.common import fresh, workers_import
from pairscope.session import cut_lineage

SHINGLE = 3
SEED = 42
_BLOCK = 1 << 15


def word_spans(text: str | None, shingle: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The words (A-Z lower-cased, split at the six ASCII spaces) joined by one space, and the bytes of each run of ``shingle`` words.

    Fewer words are one run; no words, none.
    """
    found = text.encode().lower().split() if text else []
    joined, ends, at = b" ".join(found), [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return joined, ([(0, len(joined))] if 0 < len(found) < shingle else list(zip(starts, ends[shingle - 1:])))


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles; 0 without words.

    A-Z are lower-cased, words are split at the six ASCII spaces, a text of fewer words than a shingle is
    one shingle. Memory is one block of hashes, however long the text is.
    """
    joined, spans = word_spans(text, SHINGLE)
    if not spans:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(spans), _BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans[k:k + _BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(spans)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp (the fingerprint's 64 bits as a signed long), one row per input row."""
    workers_import(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = thin.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return thin.mapInArrow(hashed, f"id {id_type}, fp bigint")


def ball(fp: str, radius: int) -> Column:
    """All values at ``radius`` bits or less from a column of longs, as an array without repeats."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(64)} | set(masks))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col(fp).bitwiseXOR(m))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Verified pairs (a < b) of distinct fingerprints that connect everything at ``bits`` or less (even).

    ``fps`` has one column of distinct longs. At each shared point its smallest fingerprint is linked to the
    others; all of them are within ``bits`` of each other, so no connection is lost.
    """
    if bits % 2:
        raise ValueError("the ball method splits an even distance in two")
    name = fps.columns[0]
    points = fps.select(F.col(name).alias("fp")).select("fp", F.explode(ball(name, bits // 2)).alias("point"))
    met = points.withColumn("a", F.min("fp").over(Window.partitionBy("point")))
    return (
        met.where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row per input row: <id_col>, fingerprint (16 hex digits), component_id (smallest identifier reachable).

    Texts without words, null ones too, have fingerprint zero and are linked like others. Null identifiers get
    a row, and count only where a component has no other. Repeated rows are repeated. An empty table gives no rows.
    """
    hashed = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(hashed.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest identifier of each group, with all their columns.

    Where identifiers repeat, all rows of the one that stays remain; run the exact stage before.
    A group whose identifiers are all null stays whole.
    """
    groups = near_groups(docs, id_col, text_col, bits)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("k")).distinct()
    (name,) = fresh(docs, "_kept")
    kept = kept.withColumnRenamed("k", name)
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")
