from tidelog.operators import folds


def test_sequence():
    s = folds.sequence_machine()
    assert [s(1, q, 10 + q) for q in (5, 6, 6, 8, 7, 3)] == [("fresh", 15), ("fresh", 16), ("duplicate", 16), ("out_of_order", 7), ("fresh", 17), ("duplicate", 17)]
    assert s(0, 9, 0) == ("fenced", 1)
    assert s(2, 1, 99) == ("fresh", 99)


def test_dedup_window():
    s = folds.dedup_machine(8, 1000)()
    assert s(1, "m1", 0, 0) == ("fresh", 0)
    assert s(1, "m1", 1, 1) == ("duplicate", 0)
    assert s(1, "m2", 1, 2) == ("fresh", 1)
    assert s(1, "m1", 2, 1000) == ("fresh", 2)  # the window's end is exclusive
    assert s(5, "m2", 3, 1001) == ("fresh", 3)
    assert s(4, "m9", 4, 1002) == ("fenced", 5)
    few = folds.dedup_machine(2, 0)()
    assert [few(1, m, k, k)[0] for k, m in enumerate("abcab")] == ["fresh"] * 5


def test_leases():
    s = folds.lease_machine(30, 100)()
    assert s("claim", 1, 0, 0, 0) == ("granted", 0, 30, 1)
    assert s("claim", 1, 0, 29, 0)[0] == "in_flight"
    assert s("claim", 1, 0, 30, 0) == ("granted", 1, 60, 2)
    assert s("ack", 1, 0, 31, 0)[0] == "fenced"
    assert s("extend", 1, 1, 50, 0) == ("extended", 1, 80, 2)
    assert s("extend", 1, 1, 115, 0)[2] == 130
    assert s("extend", 1, 1, 130, 0)[0] == "cap_reached"
    assert s("nack", 1, 1, 131, 500) == ("requeued", 2, 631, 2)
    assert s("defer", 1, 0, 700, 50) == ("deferred", 2, 750, 2)
    assert s("ack", 1, 2, 701, 0)[0] == "acked"


def test_transactions():
    s = folds.txn_machine()
    assert [s(x)[0] for x in ("commit", "prepare", "prepare", "commit", "commit", "rollback", "prepare")] == ["unknown", "prepared", "already_prepared", "resolved", "already_resolved", "conflict", "spent"]


def test_key_shared():
    s = folds.key_shared_machine()
    assert s("take", "k", 0, 1, 1) == ("deliver",)
    assert s("take", "k", 1, 1, 1) == ("key_busy",)
    assert s("take", "k", 0, 2, 1) == ("not_owner",)
    assert s("take", "", 5, 2, 1) == ("deliver",)
    assert s("ack", "k", 0, 0, 0) == ("freed",)
    assert s("take", "k", 1, 1, 1) == ("deliver",)


def test_flow_control():
    c = folds.codel_machine(5, 100)()
    drops = [t for t in range(0, 1000, 10) if c(50, t)[0]]
    assert drops[0] == 100
    assert all(a <= b for a, b in zip([b - a for a, b in zip(drops, drops[1:])][1:], [b - a for a, b in zip(drops, drops[1:])]))
    assert [c(None, 1000)[0], c(50, 1010)[0], c(50, 1110)[0]] == [False, False, True]  # empty, standing anew, after an interval
    assert not c(50, 1110 + 1601)[0]  # the host slept
    assert not any(folds.codel_machine(0, 100)()(50, t)[0] for t in range(0, 1000, 10))
    assert not folds.retry_budget_machine(10, 0)()("retry", 0)[0]
    both = folds.token_bucket_machine(10, 100, 2, 100)()
    assert [both(60, n)[0] for n in (0, 1, 600_000_001, 600_000_002)] == [True, False, True, False]
    a = folds.aimd_machine()()
    assert [a(x)[0] for x in (True, False, False, False)] == [17, 8, 4, 4]
    t = folds.token_bucket_machine(1, 0, 2, 0)()
    assert [t(1, n)[0] for n in (0, 0, 0, 1_000_000_000)] == [True, True, False, True]
    r = folds.retry_budget_machine(10**9, 100_000)()
    for n in range(10):
        r("shed", n)
    assert [r("retry", 11)[0] for _ in range(3)] == [False, True, True]
    k = folds.lockout_machine(2, 100, 50)()
    assert [k(False, 0)[0], k(False, 10)[0], k(True, 20)[0], k(True, 61)[0]] == [False, True, True, False]
    f = folds.confirm_machine(2, 100)()
    assert [f("register", 1, 0), f("register", 2, 0), f("register", 3, 0), f("commit", 3, 1), f("expire", 0, 100)] == [("registered", 0), ("registered", 0), ("dropped", 1), ("consumed", 1), ("timed_out", 1)]


def test_fold_on_spark(spark):
    df = spark.createDataFrame([("p", 1, 1, 5), ("p", 2, 1, 7), ("p", 3, 1, 6), ("q", 1, 1, 0)], "id string, at long, epoch long, seq long")
    out = folds.fold(df, ["id"], ["at"], ["epoch", "seq", "at"], folds.sequence_machine, "id string, at long, decision string, detail long")
    assert sorted(map(tuple, out.collect())) == [("p", 1, "fresh", 1), ("p", 2, "out_of_order", 6), ("p", 3, "fresh", 3), ("q", 1, "fresh", 1)]
