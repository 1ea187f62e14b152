"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.store import written

#: Tasks that the edges of one node are dealt out to.
SALTS = 8


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of edges(a, b), where root is the smallest node of its
    component. Null ends are dropped, self-loops keep their node. Every round is one minimum by
    node and one join by node, salted, so a node with many edges is neither gathered
    into one row nor left to one task; each round's table is written to the shared folder.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(edges, name)
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = now.where("a <> b")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _met(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _met(large, low).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        links = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), name)
        before, state = state, _state(links)
        if before == state:
            break
    return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))


def _met(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each edge with its node's minimum; a node's edges are dealt out to several tasks by their
    other ends, to each of which the node's one minimum goes."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "_s"]).drop("_s")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]
