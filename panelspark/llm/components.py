"""Connected components of a table of links, by alternating star steps.

A large-star step hangs every larger neighbour of a node on the smallest node near
it; a small-star step does so for the node and its smaller neighbours. Links only
ever get shorter, and when a round changes nothing each node hangs on the smallest
node of its component. A round is written to the shared scratch folder and read
back, and the round before it removed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import discard, scratch_dir


def _told(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link with what its node ``a`` is told. A node may have a large share of all links: with an exchange of
    its own on either side of the join, the optimizer can split the tasks of such a node."""
    return links.join(least.repartition(F.xxhash64("a")), "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _told(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = _told(links, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has two columns of long ids. Nulls and links of a node to itself are ignored.
    """
    a, b = links.columns
    now = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    mark, path = None, None
    while True:
        new_path = scratch_dir(spark, "components")
        (now if path is None else _small_star(_large_star(now))).write.parquet(new_path)
        if path:
            discard(spark, path)
        path = new_path
        now = spark.read.schema("a long, b long").parquet(path)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if found == mark or not found[0]:
            break
        mark = found
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return hung.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
