"""Replication checks: quorum marks, divergence, read tiers, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quorum_mark(replicas: DataFrame, by: list[str], min_isr: int, max_lag: int) -> DataFrame:
    """The ``min_isr``-th greatest end of the replicas in sync; null if there are fewer.

    In sync: the leader, and whoever is at most ``max_lag`` behind (0: anyone).
    """
    lead = replicas.filter("is_leader").groupBy(*by).agg(F.max("end").alias("_lead"))
    j = replicas.join(lead, by)
    sync = F.col("is_leader") | (F.lit(max_lag) == 0) | (F.col("_lead") - F.col("end") <= max_lag)
    ends = F.sort_array(F.collect_list(F.when(sync, F.col("end"))), asc=False)  # one entry a replica
    out = j.groupBy(*by).agg(ends.alias("_e"))
    return out.select(*by, F.try_element_at("_e", F.lit(min_isr)).alias("high_watermark"), F.size("_e").alias("in_sync"))


def first_divergence(a: DataFrame, b: DataFrame, by: list[str], *, whole: bool) -> DataFrame:
    """Least offset at which two copies (offset, mark) differ.

    ``whole``: a missing row differs too; else only offsets on both sides count.
    """
    x, y = a.select(*by, "offset", F.col("mark").alias("_x")), b.select(*by, "offset", F.col("mark").alias("_y"))
    j = x.join(y, [*by, "offset"], "full_outer" if whole else "inner")
    return j.filter(~F.col("_x").eqNullSafe(F.col("_y"))).groupBy(*by).agg(F.min("offset").alias("first_divergence"))


def heal(divergence: Column, floor: Column) -> Column:
    return F.when(divergence.isNull(), "clean").when(divergence < floor, "critical").otherwise("heal_to_committed_floor")


def safe_mark(own: Column, known: Column) -> Column:
    """What a follower may serve: the lower of both marks, nothing without the leader's."""
    return F.when(known.isNull(), F.lit(0)).otherwise(F.least(own, known))


def read_decision(tier: Column, start: Column, wanted: Column, safe: Column) -> Column:
    """nothing, serve_local or confirm_with_leader for a read at a follower."""
    local = F.when(start < safe, "serve_local")
    return (
        F.when(wanted <= start, "nothing")
        .when(tier == "committed", local.otherwise("nothing"))
        .when(tier == "latest", local.otherwise("confirm_with_leader"))
        .otherwise("confirm_with_leader")
    )


def eligible(replicas: DataFrame, mark: str) -> DataFrame:
    """Replicas that may lead: in sync, not diverged, and holding all that is committed."""
    return replicas.filter(F.col("in_isr") & ~F.col("divergent") & (F.col("durable_prefix") >= F.col(mark)))


def spread(nodes: DataFrame, replication: int) -> DataFrame:
    """Replica nodes in rounds over failure domains, labelled domains first.

    ``nodes``: node, domain (null: a domain of its own). The table is one row a node.
    """
    own = F.coalesce(F.concat(F.lit("d"), F.col("domain").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string")))
    n = nodes.withColumn("_d", own).withColumn("_round", F.row_number().over(W.partitionBy("_d").orderBy("node")))
    n = n.withColumn("_bare", F.col("domain").isNull())
    return n.orderBy("_round", "_bare", "domain", "node").limit(replication).select("node", "domain")


def leaders(replicas: DataFrame, load: DataFrame) -> DataFrame:
    """Leader of each partition: its replica with the least load, then the least node id."""
    j = replicas.join(load, "node", "left")
    return j.groupBy("partition").agg(F.min_by("node", F.struct(F.coalesce("load", F.lit(0)), "node")).alias("leader"))
