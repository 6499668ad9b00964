"""Scans are spread by where their rows are, not by how many splits they have."""

from pyspark.sql import functions as F

from signalmesh.sources import fixtures as fx


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))
    rows.coalesce(1).write.parquet(path)
    conf, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(conf, "8k")
    try:
        cores = spark.sparkContext.defaultParallelism
        held = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
        scan = fx.table(spark, str(tmp_path), "documents")
        assert scan.rdd.getNumPartitions() >= cores > held(scan) == 1
        spread = fx.text_table(spark, str(tmp_path), "documents", "doc_id")
        assert held(spread) >= cores and sorted(spread.collect()) == sorted(rows.collect())
        many = rows.repartition(cores)
        assert fx.spread(many, "doc_id") is many
    finally:
        spark.conf.set(conf, old)
