"""Sinks. Each task writes its own part files; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, kind: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """``kind``: parquet (zstd), csv, csv.gz, json, jsonl. JSON keys are written in sorted order."""
    writer = df.select(*sorted(df.columns)) if kind in ("json", "jsonl") else df
    writer = writer.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind in ("csv", "csv.gz"):
        writer.option("header", "true").option("compression", "gzip" if kind.endswith("gz") else "none").csv(path)
    elif kind in ("json", "jsonl"):
        writer.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown sink kind {kind!r}")


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``json``: the row as JSON with sorted keys and null fields kept."""
    names = sorted(columns or df.columns)
    return df.withColumn("json", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
