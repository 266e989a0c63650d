"""Rows that compress well are not merged into a few large partitions."""

from pairscope.plans.tables import Tables


def test_small_shuffles_keep_several_partitions(spark, tmp_path):
    spark.range(60000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        counted = Tables(spark, str(tmp_path)).truth.groupBy("rna_id").count()
        # by the default sizes all of it, under 1 MB as it is written, would be one partition
        assert counted.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
