"""Streaming forms: keyed folds with kept state, joins with watermarks, windows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from types import FunctionType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.folds import dedup_machine, sequence_machine


class Sequence:
    """Producer sequences, for :func:`keyed`."""

    def __init__(self):
        self.step = sequence_machine()


class Dedup:
    """A bounded window of ids by count and age, for :func:`keyed`."""

    def __init__(self, max_ids: int = 100_000, window: int = 120_000):
        self.step = dedup_machine(max_ids, window)()


def _cells(step: Callable) -> list:
    """The variables a machine keeps between steps, its helpers' too, always in the same order."""
    out, todo, known = [], [step], set()
    while todo:
        for cell in todo.pop().__closure__ or ():
            if id(cell) in known:
                continue
            known.add(id(cell))
            if isinstance(cell.cell_contents, FunctionType):
                todo.append(cell.cell_contents)
            else:
                out.append(cell)
    return out


def freeze(step: Callable) -> bytes:
    """The state of a machine of :mod:`tidelog.operators.folds`, to be kept."""
    return pickle.dumps([c.cell_contents for c in _cells(step)])


def thaw(step: Callable, state: bytes) -> Callable:
    """A new machine of the same kind goes on from a kept state."""
    for cell, value in zip(_cells(step), pickle.loads(state), strict=True):
        cell.cell_contents = value
    return step


def keyed(stream: DataFrame, key: str, order: str, columns: list[str], make: Callable[[], object], out: str) -> DataFrame:
    """Fold a stream per key by any machine of the batch folds: producers, leases, key
    sharing, transactions, confirmations, flow control.

    ``make()`` gives the machine, or an object that has it as ``step``. Rows of a key are taken in ``order`` within each micro-batch. ``out`` is the
    DDL of key, order and the results of a step.
    """
    names = [x.strip().split()[0] for x in out.split(",")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = make()
        step = getattr(machine, "step", machine)
        if state.exists:
            thaw(step, state.get[0])
        frame = pd.concat(list(frames)).sort_values(order)
        rows = [(k[0], o, *step(*values)) for o, *values in frame[[order, *columns]].itertuples(index=False, name=None)]
        state.update((freeze(step),))
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, out, "machine binary", "append", GroupStateTimeout.NoTimeout)


def correlate(requests: DataFrame, replies: DataFrame, key: str, within: str, late: str = "1 minute") -> DataFrame:
    """Stream-stream join of requests with replies in time; unanswered ones come out late."""
    q = requests.withWatermark("at", late)
    r = replies.withColumnsRenamed({"at": "reply_at", key: "reply_key"}).withWatermark("reply_at", late)
    on = (q[key] == r["reply_key"]) & (r["reply_at"] >= q["at"]) & (r["reply_at"] < q["at"] + F.expr(f"interval {within}"))
    return q.join(r, on, "leftOuter")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per event-time window; a window comes out once the watermark passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
