"""Connected components of a table of links, each named by its smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import stage_table


def components(links: DataFrame) -> DataFrame:
    """v and component (the smallest id reachable) of every id in links (a, b).

    Every id takes the least of its own and its neighbours' labels' labels, until nothing changes;
    labels travel twice as far each round. Nothing but a yes or no reaches the driver.
    """
    pairs = links.select("a", "b").filter("a <> b")
    # both ways, and each id as its own neighbour
    ways = F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u in "ab" for v in "ab"]))
    edges = stage_table(pairs.select(ways.alias("x")).select("x.*").distinct(), "edges")
    labels = stage_table(edges.groupBy("v").agg(F.min("u").alias("component")), "labels")
    while True:
        further = labels.select(F.col("v").alias("component"), F.col("component").alias("label"))
        jumped = labels.join(further, "component").select(F.col("v").alias("u"), "label", F.col("component").alias("before"))
        own = F.max(F.when(F.col("u") == F.col("v"), F.col("before")))
        new = stage_table(edges.join(jumped, "u").groupBy("v").agg(F.min("label").alias("component"), own.alias("before")), "labels")
        if new.filter("before <> component").isEmpty():
            return new.select("v", "component")
        labels = new.drop("before")
