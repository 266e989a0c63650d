"""Small pieces that several operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairscope.session import prepare

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and return.
SPACES = r"[\x20\x09-\x0D]+"


def workers_import(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it; on a cluster it comes with --py-files."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
    # workers hold a few batches at once, and one text may be very long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the data folder, with the session settings in place."""
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys occur in ``kept``; null keys match null keys, and columns stay as they are."""
    names = fresh(df, *[f"_kept_{k}" for k in keys])
    right = kept.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    on = None
    for key, name in zip(keys, names, strict=True):
        same = df[key].eqNullSafe(right[name])
        on = same if on is None else on & same
    return df.join(right, on, "left_semi")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder that driver and executors share."""
    prepare(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
