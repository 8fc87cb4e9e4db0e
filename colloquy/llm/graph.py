"""Connected components of a graph too large for one machine, by alternating stars.

Each round links every node's larger neighbours to its least neighbour (large star), then every node's smaller neighbours
to the least of them (small star). Rounds halve the depth of the trees; they end when nothing changes. Every round is
written to the shared folder. Joins are between written tables, so that a hub's rows can be split among tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node that can be reached) of every node of an edge, as a written table. Loops and null
    ends are ignored. The tables of a round go when the next is written."""
    both = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    with Scratch(edges.sparkSession) as tables:
        stars = tables.cut(both.where("a < b").distinct(), "edges")
        tally = _tally(stars)
        while tally[0]:
            former, either = stars, stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = tables.cut(either.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "least")
            large = either.where("b > a").join(near, F.col("a") == F.col("node")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
            large = tables.cut(large, "large")
            least = tables.cut(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), "m"), "least")
            small = large.where("true").join(least, F.col("b") == F.col("node"))
            small = small.select(
                F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")
            ).select("e.*")
            stars = tables.cut(small.where("a < b").distinct(), "edges")
            tables.drop(former, near, large, least)
            new = _tally(stars)
            if new == tally:
                break
            tally = new
        roots = stars.select(F.col("a").alias("node"), F.col("a").alias("component"))
        return cut(stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots.distinct()), "components")
