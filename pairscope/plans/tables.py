"""The input tables of a query run, as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairscope.session import cut_lineage, prepare
from pairscope.operators import errors, metrics, separation, stems
from pairscope.sources import derived


#: Ids and positions compress to a hundredth and are spread to many rows behind a shuffle: merged by its bytes, partitions would hold
#: hundreds of MB in one task. So only those of a few kB are merged.
_PARTITION_BYTES = "256k"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        for name in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
            spark.conf.set(f"spark.sql.adaptive.{name}", _PARTITION_BYTES)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @cached_property
    def truth(self) -> DataFrame:
        return derived.truth_pairs(self.documents)

    @cached_property
    def predicted(self) -> DataFrame:
        return derived.predicted_pairs(self.documents)

    @cached_property
    def records(self) -> DataFrame:
        return derived.records(self.documents)

    @cached_property
    def rnas(self) -> DataFrame:
        return self.records.where(F.col("source") == derived.SOURCES[0]).select("rna_id", "sequence", "sequence_length")

    @cached_property
    def folds(self) -> DataFrame:
        return derived.folds(self.documents)

    @cached_property
    def pair_events(self) -> DataFrame:
        return derived.pair_events(self.documents)

    @cached_property
    def item_events(self) -> DataFrame:
        """Order lines as scored events: one group per supplier, returned lines are the positives."""
        return self.raw("lineitem").select(
            F.col("l_suppkey").cast("string").alias("rna_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
            (F.col("l_discount") * 10).alias("score"),
        )

    # shared intermediate results -------------------------------------------------
    @cached_property
    def status(self) -> DataFrame:
        return metrics.pair_status(self.records, self.truth, self.predicted)

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.with_prf(metrics.count_status(self.status, metrics.RECORD, self.records))

    @cached_property
    def pair_errors(self) -> DataFrame:
        return errors.pair_error_table(self.status, self.truth, self.predicted)

    @cached_property
    def truth_separation(self) -> DataFrame:
        return separation.pair_separation(self.truth, self.rnas)

    @cached_property
    def relations(self) -> DataFrame:
        return stems.stem_relations(self.truth, self.predicted)

    @cached_property
    def candidates(self) -> DataFrame:
        return stems.stem_candidates(self.relations)

    @cached_property
    def candidates_once(self) -> DataFrame:
        """Written down, for queries that read them several times."""
        return cut_lineage(self.candidates)

    @cached_property
    def stem_states(self) -> DataFrame:
        return stems.stem_states(self.records, self.truth, self.predicted, self.candidates_once)
