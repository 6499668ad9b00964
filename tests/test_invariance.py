"""Results do not depend on partitioning or input order (ties go through ``ord``)."""

from pyspark.sql import functions as F

from signalmesh.config import FIXTURE_THEMES
from signalmesh.params import Params
from signalmesh.plans import jobs
from signalmesh.plans.analysis import analyze, fixture_feeds

SF = "/root/testdata/sf0.001"


def _snapshot(a):
    return (
        sorted(tuple(r) for r in jobs.themes_view(a, "standard").collect()),
        sorted((r.ngram, r.frequency) for r in a.emerging.collect()),
        sorted(tuple(r) for r in a.summary().collect()),
    )


def test_partition_and_order_invariance(spark):
    base = _snapshot(analyze(fixture_feeds(spark, SF), FIXTURE_THEMES, Params()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        feeds = fixture_feeds(spark, SF)
        feeds.tickets = feeds.tickets.orderBy(F.col("id").desc()).repartition(3)
        feeds.posts = feeds.posts.orderBy(F.col("id").desc())
        other = _snapshot(analyze(feeds, FIXTURE_THEMES, Params()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == other
