"""Acknowledgement levels, leadership and forwarding between nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.scan import running

# Names of the levels, weakest first.
ACK_LEVELS = ["c0", "c1", "c2-pagecache", "c2-fsync"]


def default_level(replicas: Column) -> Column:
    return F.when(replicas >= 3, "c2-fsync").otherwise("c1")


def resolve_level(asked: Column, replicas: Column, opted_in: Column) -> Column:
    """The level in force: null for an unknown name, the default where none is asked for.

    An acknowledgement out of the page cache has to be opted in to.
    """
    known = F.when(asked.isin(*ACK_LEVELS), asked)
    safe = F.when((known == "c2-pagecache") & ~opted_in, "c2-fsync").otherwise(known)
    return F.when(asked.isNull(), default_level(replicas)).otherwise(safe)


def admits(unsynced: Column, size: Column, headroom: int) -> Column:
    """Whether a record may join what is not yet on disk; the first always may, 0 sets no bound."""
    return (F.lit(headroom) == 0) | (unsynced == 0) | (unsynced + size <= headroom)


def release_acks(parked: DataFrame, commits: DataFrame) -> DataFrame:
    """Which parked acknowledgements go out, in the order of their arrival.

    ``parked``: log, seq, offset; ``commits``: log, commit (null: no quorum). One that
    is not committed holds all behind it, so the first of these decides: a partial
    minimum a log and a join.
    """
    log = ["stream", "partition"]
    j = parked.join(commits, log, "left")
    blocked = j.filter(F.col("commit").isNull() | (F.col("offset") >= F.col("commit"))).groupBy(*log).agg(F.min("seq").alias("_stop"))
    out = j.join(blocked, log, "left")
    return out.withColumn("released", F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("commit", "_stop")


def leadership(seen: DataFrame, lease: int) -> DataFrame:
    """A node's view of who leads: ``seen`` has node, segment, n, term, leads, now.

    A lower term than the highest so far is stale and changes nothing. Any other
    sets the epoch; if the node itself leads, its lease runs from now on, else it
    has none. The epoch is a running maximum, the lease the latest accepted row's.
    """
    df = running(seen, ["node"], "segment", "n", F.col("term"), "max", "_top", inclusive=False)
    before = F.coalesce("_top", F.lit(0))
    kind = F.when(F.col("term") > before, "advanced").when(F.col("term") == before, "unchanged").otherwise("stale")
    df = df.withColumn("outcome", kind).withColumn("epoch", F.greatest("term", before))
    taken = F.when(F.col("outcome") != "stale", F.struct("n", F.when(F.col("leads"), F.col("now") + lease).alias("deadline")))
    df = running(df, ["node"], "segment", "n", taken, "max", "_lease")
    return df.withColumn("deadline", F.col("_lease.deadline")).drop("_top", "_lease")


def fenced(epoch: Column, held_epoch: Column, deadline: Column, now: Column) -> Column:
    """Whether a write of a leader of ``epoch`` is refused: another epoch, no lease, or one that ran out."""
    return (epoch != held_epoch) | deadline.isNull() | (now >= deadline)


def federated(streams: DataFrame, peers: DataFrame, own: str) -> DataFrame:
    """Role of each stream: served from here, mirrored from a known peer, or without one.

    ``streams``: local, origin, remote; ``peers``: origin, address, one row each.
    """
    j = streams.join(peers, "origin", "left")
    here = F.col("origin") == own
    role = F.when(here, "served").when(F.col("address").isNotNull(), "mirrored").otherwise("unknown_peer")
    return j.select("local", "origin", "remote", role.alias("role"), F.when(~here, F.col("address")).alias("address"))


def leaf_machine(head: int = 0):
    """Pushes of a leaf against the hub's head: (from, claimed, valid) -> (verdict, appended, accepted_through).

    ``valid`` of ``claimed`` frames decode. What the hub has is skipped; what decodes
    is kept even if a frame behind it does not, and then nothing is acknowledged.
    """

    def step(start: int, claimed: int, valid: int):
        nonlocal head
        end = start + claimed
        if end <= head:
            return "known", 0, end
        new = max(valid - max(head - start, 0), 0)
        head += new
        return ("accepted", new, end) if valid >= claimed else ("corrupt", new, None)

    return step
