"""Token ids of a corpus in Simple-8b files, in document order.

Documents are dealt into ranges of their identifiers, sorted and encoded once; a task packs whole documents into segments of
about ``SEGMENT`` ids and Spark's Parquet writer commits them, one file a range, so a lost executor repeats its range only and
the files lie in whatever store the folder is in. A segment holds its range's number, its own, the ids and lengths of its
documents, and one Simple-8b stream. Places in the whole sequence come from the segments' sizes when the files are read: a
sum inside each range and one over the ranges' totals.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairscope.llm import simple8b
from pairscope.llm.common import partitions, workers_import

#: Ids after which a segment is closed; a longer document still lies in one.
SEGMENT = 1 << 15
#: Appended to each document.
END_ID = 0
#: Texts with a run of so many bytes go to the library, whose merging does not slow down on long runs.
_LONG_RUN = 1024
#: Fixed value of byte-level vocabularies: the pattern that splits a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value of byte-level vocabularies: the bytes that stand for themselves; the others follow from code point 256 on.
_PLAIN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def _byte_of() -> dict[str, int]:
    plain = [b for r in _PLAIN_BYTES for b in r]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _same_as_ranks(spec: dict) -> bool:
    """Whether merging by lowest id is what the vocabulary's merge list says, with nothing before or beside it."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type"), split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("BPE", "ByteLevel", False, True):
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if spec.get("normalizer") or any(model.get(k) for k in odd):
        return False
    plain = ("single_word", "lstrip", "rstrip", "normalized")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in plain):
        return False
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in merged and all(a < b for a, b in zip(merged, merged[1:]))


def _has_long_run(text: str) -> bool:
    """Whether ``_LONG_RUN`` bytes in a row are all blank (up to the space) or all not."""
    if len(text) < _LONG_RUN // 4:
        return False
    blank = np.frombuffer(text.encode(), dtype=np.uint8) <= 0x20
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return int(np.diff(edges, prepend=-1, append=len(blank) - 1).max()) >= _LONG_RUN


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids the tokenizers library gives with ``add_special_tokens=False``, truncation and padding unused.

    A byte-level vocabulary whose ids rise with its merge list needs no merge list: tiktoken then gives the same ids at four
    times the speed (tested on every code point). Other vocabularies, and texts with very long runs, go to the library.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def whole(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not _same_as_ranks(spec):
        return whole
    import tiktoken

    byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    ranked = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        return whole(text) if _has_long_run(text) else ranked.encode_to_numpy(text, allowed_special="all")

    return encode


def _segments(docs: DataFrame, path: str, id_col: str, text_col: str, segment: int) -> DataFrame:
    """Columns shard, segment, n_ids, doc_ids, lengths, data; documents rise through shards, segments and arrays."""
    spark = docs.sparkSession
    workers_import(spark)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows of one identifier spread by their text and, where that is equal too, by their place in the input
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    dealt = (
        thin.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("id", "text"))
    id_type = thin.schema["id"].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number = encoder(path), TaskContext.get().partitionId(), 0
        ids, lengths, parts, size, kind = [], [], [], 0, None
        end = np.array([END_ID], dtype=np.uint32)

        def closed() -> pa.RecordBatch:
            data = simple8b.encode(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([pa.array(ids, kind)], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["shard", "segment", "n_ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            kind = batch.column(0).type
            for one, text in zip(batch.column(0), batch.column(1)):
                found = encode(text.as_py() or "")
                ids.append(one.as_py())
                lengths.append(len(found) + 1)
                parts += [found, end]
                size += len(found) + 1
                if size >= segment:
                    yield closed()
                    ids, lengths, parts, size, number = [], [], [], 0, number + 1
        if parts:
            yield closed()

    schema = f"shard int, segment int, n_ids bigint, doc_ids array<{id_type.simpleString()}>, lengths array<bigint>, data binary"
    return dealt.mapInArrow(packed, schema)


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Encode each text with the vocabulary file ``path``, append ``END_ID``, and write the ids to ``folder`` by rising identifier.

    A null or empty text has the end id alone. Null identifiers come first; rows of one identifier lie beside each other
    and repeated rows are repeated. Other columns are ignored. An empty table makes files without segments. ``docs`` should
    be a scan or a checkpointed table: rows of one identifier and text are told apart by their place in it.
    """
    _segments(docs, path, id_col, text_col, segment).write.parquet(folder)


def placed_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``start``, the number of ids before them. One row per range meets in the window over all."""
    held = spark.read.parquet(folder)
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner_start"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = held.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outer_start"))
    places = sizes.join(shards, "shard").select("shard", "segment", (F.col("inner_start") + F.col("outer_start")).alias("start"))
    return held.join(places, ["shard", "segment"])


def _documents(segments: DataFrame, id_col: str, kind: str, value: Callable[[np.ndarray], object], arrow: pa.DataType, name: str) -> DataFrame:
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, lengths, data in zip(*batch.columns):
                n = np.array(lengths.values, dtype=np.int64)
                ends, found = np.cumsum(n), simple8b.decode(data.as_py())
                parts = pa.array([value(found[e - k:e]) for e, k in zip(ends, n)], arrow)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(start.as_py() + ends - n), pa.array(n), parts], names=["id", "start", "n_tokens", name])

    read = segments.select("start", "doc_ids", "lengths", "data").mapInArrow(
        unpacked, f"id {id_type}, start bigint, n_tokens bigint, {name} {kind}")
    return read.withColumnRenamed("id", id_col)


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Columns <id_col>, start, n_tokens, ids (with the end id) of files of ``write_tokens``."""
    workers_import(spark)
    return _documents(
        placed_segments(spark, folder), id_col, "array<bigint>", lambda v: v.astype(np.int64), pa.list_(pa.int64()), "ids")


def token_checksums(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Columns <id_col>, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    workers_import(spark)
    return _documents(
        placed_segments(spark, folder), id_col, "bigint", lambda v: zlib.crc32(v.astype("<u4").tobytes()), pa.int64(), "ids_crc32")
