"""Sequential folds: each decision depends on the decisions before it.

A fold runs per key over rows in order. Rows are dealt by key, sorted within
tasks and streamed through a small state machine, so a key's rows never have to
fit in memory; only its state does. The same machines serve the streaming form
(:mod:`tidelog.streaming.stateful`).
"""

from __future__ import annotations

from collections import Counter, OrderedDict, deque
from collections.abc import Callable, Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame

Machine = Callable[..., tuple]


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], Machine], out: str) -> DataFrame:
    """Run ``machine()`` over each key's rows; ``out`` is the DDL of keys, order and results.

    The machine is called with the values of ``columns`` and returns the results.
    """
    names = [*keys, *order, *(c for c in columns if c not in keys + order)]
    results = [x.strip().split()[0].strip("`") for x in out.split(",")]
    nk = len(keys)
    given = [names.index(c) for c in columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                if row[:nk] != last:
                    last, step = row[:nk], machine()
                rows.append((*row[: nk + len(order)], *step(*[row[k] for k in given])))
            yield pd.DataFrame(rows, columns=results)

    laid = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    return laid.mapInPandas(run, out)


# ------------------------------------------------------------ producers


def sequence_machine() -> Machine:
    """fresh / duplicate (offset held) / out_of_order (expected) / fenced (epoch held)."""
    epoch, high, held, first = 0, None, 0, True

    def step(e: int, seq: int, offset: int) -> tuple:
        nonlocal epoch, high, held, first
        if first:
            epoch, first = e, False
        if e < epoch:
            return "fenced", epoch
        if e > epoch:
            epoch, high = e, None
        if high is None or seq == high + 1:
            high, held = seq, offset
            return "fresh", offset
        if seq <= high:
            return "duplicate", held
        return "out_of_order", high + 1

    return step


def dedup_machine(max_ids: int = 100_000, window: int = 120_000_000_000) -> Callable[[], Machine]:
    """Ids of a producer are remembered by count and by age; a newer epoch forgets all."""

    def make() -> Machine:
        epoch, first = 0, True
        seen: dict[str, tuple[int, int]] = {}
        order: deque[tuple[str, int]] = deque()

        def drop() -> None:
            mid, at = order.popleft()
            if mid in seen and seen[mid][1] == at:
                del seen[mid]

        def step(e: int, msg_id: str, offset: int, now: int) -> tuple:
            nonlocal epoch, first
            if first:
                epoch, first = e, False
            if e < epoch:
                return "fenced", epoch
            if e > epoch:
                epoch = e
                seen.clear()
                order.clear()
            while window and order and now - order[0][1] >= window:
                drop()
            while len(order) > max_ids:
                drop()
            if msg_id in seen:
                return "duplicate", seen[msg_id][0]
            seen[msg_id] = (offset, now)
            order.append((msg_id, now))
            while len(order) > max_ids:
                drop()
            return "fresh", offset

        return step

    return make


# --------------------------------------------------------------- leases


def lease_machine(visibility: int, hard_cap: int) -> Callable[[], Machine]:
    """Events of one group: claim, ack, extend, nack, defer, release_below.

    Returns outcome, generation, deadline, deliveries (nulls where they mean nothing).
    """

    def make() -> Machine:
        leases: dict[int, list[int]] = {}  # offset: generation, attempt start, deadline, deliveries
        upcoming = 0

        def step(op: str, offset: int, generation: int, now: int, delay: int) -> tuple:
            nonlocal upcoming
            held = leases.get(offset)
            if op == "claim":
                if held and now < held[2]:
                    return "in_flight", None, held[2], held[3]
                deadline = now + min(visibility, hard_cap)
                leases[offset] = held = [upcoming, now, deadline, held[3] + 1 if held else 1]
                upcoming += 1
                return "granted", held[0], deadline, held[3]
            if op == "release_below":
                for o in [o for o in leases if o < offset]:
                    del leases[o]
                return "released", None, None, None
            if op == "defer":
                if held and now >= held[2]:
                    held[2] = now + delay
                    return "deferred", held[0], held[2], held[3]
                return "unchanged", None, None, None
            if not held or held[0] != generation:
                return "fenced", None, None, None
            if op in ("ack", "term"):
                del leases[offset]
                return "acked" if op == "ack" else "terminated", generation, None, held[3]
            if op == "extend":
                if now >= held[1] + hard_cap:
                    return "cap_reached", generation, held[2], held[3]
                held[2] = min(now + visibility, held[1] + hard_cap)
                return "extended", generation, held[2], held[3]
            held[0], held[2] = upcoming, now + delay  # nack
            upcoming += 1
            return "requeued", held[0], held[2], held[3]

        return step

    return make


def key_shared_machine() -> Machine:
    """Whether a member may take an offset: deliver, key_busy, not_owner; an ack frees the key."""
    busy: dict[str, int] = {}

    def step(op: str, key: str, offset: int, member: int, owner: int) -> tuple:
        if op == "ack":
            if busy.get(key) == offset:
                del busy[key]
            return ("freed",)
        if key == "":
            return ("deliver",)
        if busy.get(key, offset) != offset:
            return ("key_busy",)
        if owner != member:
            return ("not_owner",)
        busy[key] = offset
        return ("deliver",)

    return step


# --------------------------------------------------------- transactions


def txn_machine() -> Machine:
    """prepare / commit / rollback of one transaction id."""
    state: str | None = None

    def step(op: str) -> tuple:
        nonlocal state
        if op == "prepare":
            if state is None:
                state = "prepared"
                return ("prepared",)
            return ("already_prepared" if state == "prepared" else "spent",)
        goal = {"commit": "committed", "rollback": "rolled_back"}[op]
        if state is None:
            return ("unknown",)
        if state == "prepared":
            state = goal
            return ("resolved",)
        return ("already_resolved" if state == goal else "conflict",)

    return step


def confirm_machine(cap: int = 65_536, ttl: int = 300_000) -> Callable[[], Machine]:
    """Consume confirmations of a stream: register, commit (consumed below), expire.

    Returns the offsets settled by the event and how: consumed, dropped, timed_out.
    """

    def make() -> Machine:
        waiting: OrderedDict[int, int] = OrderedDict()

        def step(op: str, offset: int, now: int) -> tuple:
            if op == "register":
                gone = []
                if len(waiting) >= cap:
                    low = min(waiting)
                    del waiting[low]
                    gone = [low]
                waiting[offset] = now
                return "dropped" if gone else "registered", len(gone)
            if op == "commit":
                done = [o for o in waiting if o < offset]
            else:
                done = [o for o, at in waiting.items() if ttl and now - at >= ttl]
            for o in done:
                del waiting[o]
            return "consumed" if op == "commit" else "timed_out", len(done)

        return step

    return make


# --------------------------------------------------------- flow control


def codel_machine(target: int, interval: int) -> Callable[[], Machine]:
    """Drop decisions from queueing times (RFC 8289): a delay above ``target`` that
    stands for an ``interval`` starts a run of drops, the n-th an ``interval`` over
    the root of n after the one before. A run soon after another goes on from there.

    A delay of None says that the queue is empty. A silence of 16 intervals (the
    host slept) forgets everything. A target or interval of 0 never drops.
    """

    def make() -> Machine:
        standing, seen, running = None, None, False  # since when the delay stands, the last event, within a run
        n, due = 0, 0  # the last drop's number in its run, and when the next may follow

        def step(delay: int | None, now: int) -> tuple:
            nonlocal standing, seen, running, n, due
            if not (target and interval):
                return (False,)
            if seen is not None and now - seen > 16 * interval:
                standing, running, n = None, False, 0
            seen = now
            if delay is None or delay <= target:
                standing, running = None, False
                return (False,)
            standing = now if standing is None else standing
            if now < (due if running else standing + interval):
                return (False,)
            soon = now < due + 2 * interval
            n = n + 1 if running else n - 2 if soon and n > 2 else 1
            running, due = True, now + max(interval // isqrt(n), 1)
            return (True,)

        return step

    return make


def aimd_machine(start: int = 16, low: int = 4, high: int = 128, up: int = 1) -> Callable[[], Machine]:
    """Limit that grows by ``up`` on success and halves on failure, within bounds."""

    def make() -> Machine:
        limit = start

        def step(ok: bool) -> tuple:
            nonlocal limit
            limit = min(limit + up, high) if ok else max(limit // 2, low)
            return (limit,)

        return step

    return make


MICRO, SECOND = 1_000_000, 1_000_000_000  # parts of a token; nanoseconds


def token_bucket_machine(msgs: int, bytes_: int, msg_burst: int, byte_burst: int) -> Callable[[], Machine]:
    """Admit a message if every meter with a rate can pay for it; all pay or none.

    Meters are kept in millionths of a token; a rate of 0 is no meter.
    """

    def make() -> Machine:
        meters = [(rate, burst * MICRO, by_size) for rate, burst, by_size in ((msgs, msg_burst, False), (bytes_, byte_burst, True)) if rate]
        levels, clock = [full for _, full, _ in meters], None

        def step(size: int, now: int) -> tuple:
            nonlocal levels, clock
            passed = 0 if clock is None else max(now - clock, 0)
            clock = now if clock is None else max(clock, now)
            levels = [min(have + rate * passed * MICRO // SECOND, full) for have, (rate, full, _) in zip(levels, meters, strict=True)]
            price = [(size if by_size else 1) * MICRO for _, _, by_size in meters]
            admitted = all(have >= cost for have, cost in zip(levels, price, strict=True))
            if admitted:
                levels = [have - cost for have, cost in zip(levels, price, strict=True)]
            return (admitted,)

        return step

    return make


def retry_budget_machine(window: int, ratio_ppm: int, k: int = 2) -> Callable[[], Machine]:
    """Which retries are held back: those over a share of a window's requests, once
    fewer than one request in ``k`` is accepted. A ratio of 0 holds none back.

    Windows tumble: one begins with the first event after the last one's end.
    """

    def make() -> Machine:
        begun, tally = None, Counter()  # requests of the window by kind; retries held back are none

        def step(kind: str, now: int) -> tuple:
            nonlocal begun, tally
            if begun is None or now - begun >= window:
                begun, tally = now, Counter()
            requests = tally.total()
            spent = tally["retry"] >= requests * ratio_ppm // 1_000_000
            held = bool(kind == "retry" and ratio_ppm and requests > k * tally["accept"] and spent)
            tally[kind] += not held
            return (held,)

        return step

    return make


def lockout_machine(threshold: int, window: int, cooldown: int) -> Callable[[], Machine]:
    """Failures within a restarting window lock an address for a while."""

    def make() -> Machine:
        begun, failed, until = None, 0, None

        def step(ok: bool, now: int) -> tuple:
            nonlocal begun, failed, until
            if ok:
                begun, failed = None, 0
            else:
                if begun is None or now - begun > window:
                    begun, failed = now, 0
                failed += 1
                if failed >= threshold:
                    until = now + cooldown
            return (until is not None and now < until,)

        return step

    return make
