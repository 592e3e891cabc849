"""Names of files and folders, error codes, header packing, and made-up payloads, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of outcomes. The first four are not errors.
CODES = [
    "OK",
    "DUPLICATE",
    "OFFSET_TRIMMED",
    "OFFSET_COMPACTED",
    "ERR_CUMULATIVE_ACK_NOT_ALLOWED",
    "ERR_ACK_NOT_OWNED",
    "ERR_CUMULATIVE_ACK_OUT_OF_RANGE",
    "ERR_BROADCAST_GROUP_BUSY",
    "ERR_BROADCAST_GROUP_NOT_NAMED",
    "ERR_TOO_MANY_GROUPS",
    "ERR_EPHEMERAL_GROUP_CONFLICT",
    "ERR_INVALID_GROUP_NAME",
    "ERR_PRODUCER_FENCED",
    "ERR_AT_CAPACITY",
    "ERR_GENERATION_EXHAUSTED",
    "ERR_MISSING_RECORD",
    "ERR_ZERO_MAX_IN_FLIGHT",
    "ERR_STORAGE",
    "ERR_DELAY_TOO_LONG",
    "ERR_INVALID_DELAY_HEADER",
]

# Names on disk.
SEGMENT_NAME = r"^seg-([0-9a-f]{16})\.log$"
PARTITION_NAME = r"^p-([0-9a-f]{8})$"
CURSOR_NAME = r"^cursor-((?:[0-9a-f]{2})+)\.ckpt$"


def is_error(code: Column) -> Column:
    """Whether a code tells of a failure; null for a code that does not exist."""
    return F.when(code.isin(*CODES), code.startswith("ERR_"))


def to_hex(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "utf-8")))


def from_hex(name: Column) -> Column:
    """The bytes of lower-case hex of even length, null for anything else."""
    return F.when(name.rlike("^(?:[0-9a-f]{2})*$"), F.unhex(name))


def segment_file(segment_id: Column) -> Column:
    return F.concat(F.lit("seg-"), F.lpad(F.lower(F.hex(segment_id)), 16, "0"), F.lit(".log"))


def partition_folder(index: Column) -> Column:
    return F.concat(F.lit("p-"), F.lpad(F.lower(F.hex(index)), 8, "0"))


def cursor_file(group: Column) -> Column:
    """The default group has no name, others are spelled in hex."""
    return F.when(group == "", "cursor.ckpt").otherwise(F.concat(F.lit("cursor-"), to_hex(group), F.lit(".ckpt")))


def number_in(name: Column, pattern: str) -> Column:
    """The number a file or folder name holds, null for foreign names."""
    return F.when(name.rlike(pattern), F.conv(F.regexp_extract(name, pattern, 1), 16, 10).cast("decimal(20,0)"))


def group_of(name: Column) -> Column:
    hexed = F.regexp_extract(name, CURSOR_NAME, 1)
    return F.when(name == "cursor.ckpt", "").when(hexed != "", F.decode(F.unhex(hexed), "utf-8"))


def little_endian(value: Column, width: int) -> Column:
    """A non-negative integer as ``width`` bytes, the lowest first."""
    h = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def read_little_endian(blob: Column, at: int, width: int) -> Column:
    """The integer in ``width`` bytes from byte ``at`` on (from 0)."""
    return F.conv(F.concat(*[F.hex(F.substring(blob, at + i + 1, 1)) for i in reversed(range(width))]), 16, 10).cast("long")


def pack_dead_letter(magic: bytes, group: Column, source_offset: Column, attempt: Column, headers: Column) -> Column:
    """Header of a dead letter: magic, offset, attempt, both lengths, group, the record's own headers.

    Null if a length does not go into 16 bits.
    """
    g = F.encode(group, "utf-8")
    fits = (F.octet_length(g) < 65536) & (F.octet_length(headers) < 65536)
    lengths = [little_endian(F.octet_length(x), 2) for x in (g, headers)]
    return F.when(fits, F.concat(F.lit(magic), little_endian(source_offset, 8), little_endian(attempt, 4), *lengths, g, headers))


def unpack_dead_letter(magic: bytes, blob: Column) -> Column:
    """Struct of a packed header's fields, null if the magic or a length is wrong."""
    m = len(magic)
    body = m + 16
    glen, hlen = read_little_endian(blob, m + 12, 2), read_little_endian(blob, m + 14, 2)
    whole = (F.octet_length(blob) >= body) & (F.substring(blob, 1, m) == F.lit(magic))
    fields = F.struct(
        F.decode(F.substring(blob, F.lit(body + 1), glen.cast("int")), "utf-8").alias("group"),
        read_little_endian(blob, m, 8).alias("source_offset"),
        read_little_endian(blob, m + 8, 4).alias("attempt"),
        F.substring(blob, F.lit(body + 1) + glen.cast("int"), hlen.cast("int")).alias("headers"),
    )
    return F.when(whole & (F.octet_length(blob) == body + glen + hlen), fields)


def compressible(seed: Column, size: int, pattern: str = "sensor=edge temp=21.5 batt=98; ") -> Column:
    """A payload of telemetry-like text that repeats."""
    return F.substring(F.concat(seed.cast("string"), F.lit(";"), F.repeat(F.lit(pattern), size // len(pattern) + 1)), 1, size)


def incompressible(seed: Column, size: int) -> Column:
    """Hex digits of hashes of a counter: as good as random, the same for the same seed."""
    parts = [F.sha2(F.concat(seed.cast("string"), F.lit(f"-{i}")), 256) for i in range(size // 64 + 1)]
    return F.substring(F.concat(*parts), 1, size)


def lines_of(text: Column) -> Column:
    """Lines of a text; a last line break ends a line and does not begin one."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def success_envelope(schema: str, stdout: Column) -> Column:
    data = F.struct(stdout.alias("stdout"), lines_of(stdout).alias("lines"))
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(True).alias("ok"), F.lit(0).alias("exit_code"), data.alias("data")))


def error_envelope(schema: str, exit_code: Column, kind: Column, message: Column) -> Column:
    error = F.struct(kind.alias("kind"), message.alias("message"))
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(False).alias("ok"), exit_code.alias("exit_code"), error.alias("error")))
