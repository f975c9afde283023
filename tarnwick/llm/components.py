"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps only connect nodes to smaller ones they are linked with, so the table never grows
beyond the links and their nodes; it takes a logarithmic number of rounds. Each round is written
to the shared scratch folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import stash


def _with_least(pairs: DataFrame) -> DataFrame:
    """a, b, m: m is the least of a and all b it stands with."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "component") -> DataFrame:
    """node, root for every node of the links: root is the least node that links reach.

    Nulls and links of a node with itself are passed over; an empty table gives an empty result.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    links = stash(links, name)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        kept = _with_least(large)  # every a stands with smaller nodes only
        small = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(kept.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        links = stash(small, name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
