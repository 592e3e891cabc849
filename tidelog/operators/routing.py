"""Subjects: grammar, matching, bindings, and single-home resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 32


def verdict(subject: Column, *, pattern: bool = False) -> Column:
    """'ok' or the first fault of a subject, by token; a pattern may hold wildcards.

    Tokens are read from the left; each first asks whether an earlier ``>`` should
    have been the last, then whether it is one too many, then what it is itself.
    """
    tokens = F.split(subject, r"\.", -1)
    lone = F.lit("ok") if pattern else F.lit("WildcardNotAllowed")

    def fault(t: Column, i: Column) -> Column:
        earlier = F.array_position(F.slice(tokens, F.lit(1), F.greatest(i, F.lit(1))), ">") if pattern else F.lit(0)
        tail = (i > 0) & (earlier > 0) & (earlier <= i)
        return (
            F.when(tail, "TailWildcardNotLast")
            .when(i == MAX_DEPTH, "TooDeep")
            .when(t == "", "EmptyToken")
            .when(t.isin("*", ">"), lone)
            .when(F.regexp_extract(t, r"[\x00-\x1F\x7F\u0080-\u009F*>]", 0) == "", "ok")
            .when(F.regexp_extract(t, r"[\x00-\x1F\x7F\u0080-\u009F*>]", 0).isin("*", ">"), "IllegalChar")
            .otherwise("ControlChar")
        )

    bad = F.filter(F.transform(tokens, fault), lambda x: x != "ok")
    return F.when(subject == "", "Empty").otherwise(F.coalesce(F.try_element_at(bad, F.lit(1)), F.lit("ok")))


def pattern_regex(pattern: Column) -> Column:
    """Anchored regular expression of a valid pattern."""
    quoted = F.regexp_replace(pattern, r"([\\\[\](){}+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(quoted, F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^.]+")), F.lit(">"), F.lit(".+")), F.lit("$"))


def matches(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """Distinct subjects joined with the bindings that match them: subject, pattern, target.

    Only distinct subjects are matched. Literal patterns meet by equality; the
    others meet on their number of literal leading tokens and those tokens, which
    leaves a regular expression to the few that agree there.
    """
    subjects = records.select("subject").filter("subject <> ''").distinct()
    wild = F.col("pattern").rlike(r"[*>]")
    literal = subjects.join(bindings.filter(~wild), subjects["subject"] == bindings["pattern"]).select("subject", "pattern", "target")
    lead = F.regexp_extract(F.col("pattern"), r"^((?:[^.*>]+\.)*)", 1)
    rest = bindings.filter(wild).select("pattern", "target", lead.alias("_lead"), pattern_regex(F.col("pattern")).alias("_re"))
    parts = F.split("subject", r"\.")
    leads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "."), F.lit("."))))
    spread = subjects.select("subject", F.explode(leads).alias("_lead"))
    return literal.unionByName(spread.join(rest, "_lead").filter(F.expr("subject rlike _re")).select("subject", "pattern", "target"))


def single_home(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each distinct subject with its resolution: no_stream, routed, ambiguous, and the count."""
    subjects = records.select("subject").distinct()
    hits = matches(records, bindings).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("home"))
    out = subjects.join(hits, "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") == 0, "no_stream").when(F.col("n") == 1, "routed").otherwise("ambiguous")
    return out.select("subject", kind.alias("resolution"), "n", F.when(F.col("n") == 1, F.col("home")).alias("home"))


def key_hash(key: Column) -> Column:
    """A portable 32-bit hash of a key; any SQL engine with md5 repeats it."""
    return F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, 8), 16, 10).cast("long")


def partition_of(key: Column, partitions: int) -> Column:
    return F.pmod(key_hash(key), F.lit(partitions))


def rendezvous(keys: DataFrame, members: DataFrame) -> DataFrame:
    """Owner of each key: the member whose hash with the key is greatest, ties to the larger id."""
    score = key_hash(F.concat(F.col("member").cast("string"), F.lit("|"), F.col("key")))
    return keys.select("key").distinct().join(F.broadcast(members)).groupBy("key").agg(F.max_by("member", F.struct(score, "member")).alias("owner"))


def fuzzy(query: str, candidate: Column) -> Column:
    """Case-insensitive in-order subsequence; an empty query matches all."""
    special = set("\\[](){}+*?^$|.-")
    body = ".*".join(("\\" + c if c in special else c) for c in query.lower())
    return F.lower(candidate).rlike(f"(?s).*{body}.*")
