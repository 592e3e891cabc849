"""Sequential folds over derived event sequences.

Where the state of a fold is a few scalars, SQL steps through each key's rows by
recursion; the others are checked by tests.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import folds
from tidelog.plans.registry import query
from tidelog.sources.views import records, table


def _half(spark, d):
    """The event at which producers take a new epoch: half way through the table."""
    return table(spark, d, "events").agg(F.expr("coalesce((max(event_id) + 1) div 2, 0)")).first()[0]


def _steps(key: str, given: str, state: dict[str, tuple[str, str]], out: str) -> str:
    """Recursive SQL: ``state`` has each value's start and its step, from ``f`` (before) and ``p`` (the row)."""
    first = ", ".join(f"{start} AS {n}" for n, (start, _) in state.items())
    step = ", ".join(f"{x} AS {n}" for n, (_, x) in state.items())
    return f"""WITH RECURSIVE p AS (SELECT {key}, event_id, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS i, {given} FROM events),
    f AS (SELECT DISTINCT {key}, 0::BIGINT AS i, 0::BIGINT AS event_id, {first} FROM p
      UNION ALL SELECT p.{key}, p.i, p.event_id, {step} FROM f JOIN p ON p.{key} = f.{key} AND p.i = f.i + 1)
    SELECT {key}, event_id, {out} FROM f WHERE i > 0"""


# a newer epoch forgets the high mark, an older one is fenced
_FENCED, _HIGH = "p.epoch < coalesce(f.epoch, p.epoch)", "CASE WHEN p.epoch = f.epoch THEN f.high END"
_FRESH = f"(({_HIGH}) IS NULL OR p.seq = ({_HIGH}) + 1)"
SEQUENCE_SQL = _steps(
    "user_id",
    """(CASE WHEN event_id >= (SELECT (max(event_id) + 1) // 2 FROM events) THEN 2 ELSE 1 END - CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END)::BIGINT AS epoch,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 23 = 0 THEN 3 ELSE 0 END - CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS seq""",
    {
        "epoch": ("NULL::BIGINT", "greatest(coalesce(f.epoch, p.epoch), p.epoch)"),
        "high": ("NULL::BIGINT", f"CASE WHEN {_FENCED} THEN f.high WHEN {_FRESH} THEN p.seq ELSE f.high END"),
        "held": ("0::BIGINT", f"CASE WHEN {_FENCED} THEN f.held WHEN {_FRESH} THEN p.event_id ELSE f.held END"),
        "decision": ("''", f"CASE WHEN {_FENCED} THEN 'fenced' WHEN {_FRESH} THEN 'fresh' WHEN p.seq <= f.high THEN 'duplicate' ELSE 'out_of_order' END"),
        "detail": ("0::BIGINT", f"CASE WHEN {_FENCED} THEN f.epoch WHEN {_FRESH} THEN p.event_id WHEN p.seq <= f.high THEN f.held ELSE f.high + 1 END"),
    },
    "decision, detail",
)


@query("sequence_classify", SEQUENCE_SQL)
def _(spark, d):
    i = F.col("event_id")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    seq = (n + F.when(i % 23 == 0, 3).otherwise(0) - F.when(i % 10 == 0, 1).otherwise(0)).cast("long")
    epoch = (F.when(i >= _half(spark, d), 2).otherwise(1) - F.when(i % 101 == 0, 1).otherwise(0)).cast("long")
    e = table(spark, d, "events").select("user_id", "event_id", epoch.alias("epoch"), seq.alias("seq"))
    return folds.fold(e, ["user_id"], ["event_id"], ["epoch", "seq", "event_id"], folds.sequence_machine, "user_id long, event_id long, decision string, detail long")


@query("dedup_window")
def _(spark, d):
    i = F.col("offset")
    e = records(spark, d).select("user_id", i.alias("offset"), F.when(i >= _half(spark, d), 2).otherwise(1).cast("long").alias("epoch"), F.concat(F.lit("m"), (i % 40).cast("string")).alias("msg_id"), F.col("due_ms").alias("now"))
    return folds.fold(e, ["user_id"], ["offset"], ["epoch", "msg_id", "offset", "now"], folds.dedup_machine(20, 5 * 86_400_000), "user_id long, offset long, decision string, held long")


@query("lease_replay")
def _(spark, d):
    i = F.col("event_id")
    ops = F.array(*[F.lit(x) for x in ("claim", "claim", "ack", "extend", "nack", "claim", "defer")])
    e = table(spark, d, "events").select(
        (F.col("user_id") % 16).alias("group"), i.alias("n"), F.element_at(ops, (i % 7 + 1).cast("int")).alias("op"), (i % 5).alias("offset"), (i % 11).alias("generation"), (i * 3).alias("now"), (i % 4 * 10).alias("delay"),
    )
    out = "`group` long, n long, outcome string, generation long, deadline long, deliveries long"
    return folds.fold(e, ["group"], ["n"], ["op", "offset", "generation", "now", "delay"], folds.lease_machine(30, 100), out)


@query("key_shared_replay")
def _(spark, d):
    i = F.col("offset")
    e = records(spark, d).select(
        "stream", i.alias("n"), F.when(i % 3 == 2, "ack").otherwise("take").alias("op"), "key", (i - i % 3).alias("offset"), (i % 2).alias("member"), (F.length("key") % 2).cast("long").alias("owner")
    )
    return folds.fold(e, ["stream"], ["n"], ["op", "key", "offset", "member", "owner"], folds.key_shared_machine, "stream string, n long, decision string")


TXN_SQL = _steps(
    "user_id",
    "['prepare', 'commit', 'rollback', 'commit'][event_id % 4 + 1] AS op",
    {
        "state": ("'none'", "CASE WHEN p.op = 'prepare' AND f.state = 'none' THEN 'prepared' WHEN f.state = 'prepared' AND p.op <> 'prepare' THEN p.op ELSE f.state END"),
        "outcome": (
            "''",
            """CASE WHEN p.op = 'prepare' THEN CASE f.state WHEN 'none' THEN 'prepared' WHEN 'prepared' THEN 'already_prepared' ELSE 'spent' END
        WHEN f.state = 'none' THEN 'unknown' WHEN f.state = 'prepared' THEN 'resolved' WHEN f.state = p.op THEN 'already_resolved' ELSE 'conflict' END""",
        ),
    },
    "outcome",
)


@query("txn_replay", TXN_SQL)
def _(spark, d):
    i = F.col("event_id")
    ops = F.array(*[F.lit(x) for x in ("prepare", "commit", "rollback", "commit")])
    e = table(spark, d, "events").select("user_id", "event_id", F.element_at(ops, (i % 4 + 1).cast("int")).alias("op"))
    return folds.fold(e, ["user_id"], ["event_id"], ["op"], folds.txn_machine, "user_id long, event_id long, outcome string")


@query("confirm_replay")
def _(spark, d):
    i = F.col("event_id")
    op = F.when(i % 10 == 9, "commit").when(i % 37 == 0, "expire").otherwise("register")
    e = table(spark, d, "events").select("event_type", "event_id", op.alias("op"), i.alias("offset"), (i * 1000).alias("now"))
    return folds.fold(e, ["event_type"], ["event_id"], ["op", "offset", "now"], folds.confirm_machine(4, 30_000), "event_type string, event_id long, outcome string, settled long")


@query("codel_drops")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", (F.col("value") * 1_000_000).cast("long").alias("sojourn"), (F.col("event_id") * 2_000_000).alias("now"))
    return folds.fold(e, ["event_type"], ["event_id"], ["sojourn", "now"], folds.codel_machine(5_000_000, 20_000_000), "event_type string, event_id long, dropped boolean")


def _aimd(start: int, low: int, high: int, up: int, name: str) -> str:
    return _steps("user_id", "event_type <> 'error' AS ok", {"v": (f"{start}::BIGINT", f"CASE WHEN p.ok THEN least(f.v + {up}, {high}) ELSE greatest(f.v // 2, {low}) END")}, f'v AS "{name}"')


@query("aimd_limit", _aimd(16, 4, 128, 1, "limit"))
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return folds.fold(e, ["user_id"], ["event_id"], ["ok"], folds.aimd_machine(), "user_id long, event_id long, limit long")


@query("credit_autotune", _aimd(256, 64, 2048, 64, "credit"))
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return folds.fold(e, ["user_id"], ["event_id"], ["ok"], folds.aimd_machine(256, 64, 2048, 64), "user_id long, event_id long, credit long")


@query("token_bucket")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.octet_length("props").cast("long").alias("size"), (F.col("event_id") * 1_000_000).alias("now"))
    return folds.fold(e, ["event_type"], ["event_id"], ["size", "now"], folds.token_bucket_machine(100, 800, 20, 200), "event_type string, event_id long, admitted boolean")


@query("retry_budget")
def _(spark, d):
    k = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "click", "shed").otherwise("accept")
    e = table(spark, d, "events").select("user_id", "event_id", k.alias("kind"), (F.col("event_id") * 1_000_000).alias("now"))
    return folds.fold(e, ["user_id"], ["event_id"], ["kind", "now"], folds.retry_budget_machine(3_000_000_000, 100_000), "user_id long, event_id long, throttled boolean")


_ANEW = "(f.begun IS NULL OR p.now - f.begun > 900000)"
LOCKOUT_SQL = _steps(
    "user_id",
    "event_type <> 'error' AS ok, event_id * 1000 AS now",
    {
        "begun": ("NULL::BIGINT", f"CASE WHEN p.ok THEN NULL WHEN {_ANEW} THEN p.now ELSE f.begun END"),
        "failed": ("0::BIGINT", f"CASE WHEN p.ok THEN 0 WHEN {_ANEW} THEN 1 ELSE f.failed + 1 END"),
        "until": ("0::BIGINT", f"CASE WHEN NOT p.ok AND CASE WHEN {_ANEW} THEN 1 ELSE f.failed + 1 END >= 2 THEN p.now + 600000 ELSE f.until END"),
        "now": ("0::BIGINT", "p.now"),
    },
    "now < until AS locked",
)


@query("auth_lockout", LOCKOUT_SQL)
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") * 1000).alias("now"))
    return folds.fold(e, ["user_id"], ["event_id"], ["ok", "now"], folds.lockout_machine(2, 900_000, 600_000), "user_id long, event_id long, locked boolean")
