"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.lineage import cut
from quillmill.plans.skew import salted_join


def connected_components(edges: DataFrame, src: str, dst: str, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`; component is the least node reachable.

    Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the links no longer change.  The minimum of each neighbourhood is an
    aggregate with map-side combine, and links of a hub are spread over several tasks where they meet that minimum.
    Links and labels stay in the cluster; the driver sees one count and one hash a round.
    Null ends and self-links are ignored.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = cut(links)
    nodes = links.select(F.col("u").alias("node")).unionAll(links.select(F.col("v").alias("node"))).distinct()
    total, state = links.count(), None
    for _ in range(max_rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Large star: every larger neighbour of u is linked to the least of u's neighbourhood.
        large = salted_join(both.where("v > u"), least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.  Each node has one link a row here at most for each neighbour.
        low = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small_least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(low, small_least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = cut(small)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        total, state = now["n"], (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    label = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
