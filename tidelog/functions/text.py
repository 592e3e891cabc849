"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of durations (ms) and sizes (bytes).
DURATION = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
SIZE = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


def _scaled(raw: Column, units: dict[str, int]) -> Column:
    number, unit = F.regexp_extract(raw, r"^(\d+)([A-Za-z]+)$", 1), F.regexp_extract(raw, r"^(\d+)([A-Za-z]+)$", 2)
    factor = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, v)])
    return F.try_multiply(F.nullif(number, F.lit("")).try_cast("long"), F.try_element_at(factor, unit).cast("long"))


def duration_ms(raw: Column) -> Column:
    """Milliseconds of a whole number with its unit; null for anything else."""
    return _scaled(raw, DURATION)


def byte_size(raw: Column) -> Column:
    """Bytes of a whole number with a binary unit; null for anything else."""
    return _scaled(raw, SIZE)


def uptime(seconds: Column) -> Column:
    """``Nd Nh Nm Ns`` without leading zero units."""
    s = seconds.cast("long")

    def part(least: int, value: str, unit: str) -> Column:
        return F.when(s >= least, F.concat(value.cast("string"), F.lit(unit))).otherwise("")

    days, hours, minutes = F.floor(s / 86_400), F.floor(s % 86_400 / 3_600), F.floor(s % 3_600 / 60)
    return F.concat(part(86_400, days, "d "), part(3_600, hours, "h "), part(60, minutes, "m "), (s % 60).cast("string"), F.lit("s"))


def traceparent(headers: Column) -> Column:
    """Struct version, trace_id, parent_id, flags of a trace header, null if none is valid.

    The whole trimmed blob, or a ``traceparent: value`` (or ``=``) line.
    """
    ws = F.lit(" \t\r\n\x0b\x0c")
    lines = F.filter(F.transform(F.split(headers, "\n"), lambda x: F.btrim(x, ws)), lambda x: F.lower(F.regexp_extract(x, r"^([^:=]*?)\s*[:=]", 1)) == "traceparent")
    values = F.concat(F.array(F.btrim(headers, ws)), F.transform(lines, lambda x: F.btrim(F.regexp_extract(x, r"(?s)^[^:=]*[:=](.*)$", 1), ws)))

    def parsed(v: Column) -> Column:
        p = F.split(F.lower(v), "-", -1)
        ok = (
            (F.size(p) >= 4)
            & F.get(p, F.lit(0)).rlike("^[0-9a-f]{2}$")
            & (F.get(p, F.lit(0)) != "ff")
            & ((F.get(p, F.lit(0)) != "00") | (F.size(p) == 4))
            & F.get(p, F.lit(1)).rlike("^[0-9a-f]{32}$")
            & ~F.get(p, F.lit(1)).rlike("^0+$")
            & F.get(p, F.lit(2)).rlike("^[0-9a-f]{16}$")
            & ~F.get(p, F.lit(2)).rlike("^0+$")
            & F.get(p, F.lit(3)).rlike("^[0-9a-f]{2}$")
        )
        return F.when(ok, F.struct(*[F.get(p, F.lit(k)).alias(n) for k, n in enumerate(("version", "trace_id", "parent_id", "flags"))]))

    return F.try_element_at(F.filter(F.transform(values, parsed), lambda x: x.isNotNull()), F.lit(1))


def did_you_mean(asked: Column, known: list[str]) -> Column:
    """The closest known word, if no farther than a third of the length (2 at least)."""
    each = F.array(*[F.struct(F.levenshtein(asked, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in known])
    best = F.array_min(each)
    return F.when(best["d"] <= F.greatest(F.floor(F.length(asked) / 3), F.lit(2)), best["k"])


def inbox_subject(correlation: Column) -> Column:
    return F.concat(F.lit("_INBOX."), F.lower(F.hex(correlation)))


def flag_set(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0
