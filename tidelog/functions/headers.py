"""Blocks in header blobs, payload compression and encryption, admin snapshots."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Magic of header blocks, each followed by a little-endian u64.
TTL, DELAY, DUE = b"TTL1", b"DLY1", b"DUE1"
BLOCK = 12
LONG_MAX = 2**63 - 1


def _swap(hexed: Column) -> Column:
    return F.concat(*[F.substring(hexed, k, 2) for k in range(15, 0, -2)])


def le8(value: Column) -> Column:
    """A long as eight little-endian bytes."""
    return F.unhex(_swap(F.lpad(F.hex(value.cast("long")), 16, "0")))


def _block(headers: Column, at: Column, magic: bytes) -> Column:
    """The number in a block, held to the largest long; null if the block is not there."""
    raw = F.conv(_swap(F.hex(F.substring(headers, at + 5, F.lit(8)))), 16, 10).cast("decimal(20,0)")
    has = (F.substring(headers, at + 1, F.lit(4)) == F.lit(magic)) & (F.octet_length(headers) >= at + BLOCK)
    return F.when(has, F.least(raw, F.lit(LONG_MAX).cast("decimal(20,0)")).cast("long"))


def _delay_at(headers: Column) -> Column:
    """A lifetime block may stand before the delay block."""
    has = (F.substring(headers, F.lit(1), F.lit(4)) == F.lit(TTL)) & (F.octet_length(headers) >= BLOCK)
    return F.when(has, F.lit(BLOCK)).otherwise(F.lit(0))


def ttl_ms(headers: Column) -> Column:
    return _block(headers, F.lit(0), TTL)


def due_ms(headers: Column) -> Column:
    return _block(headers, _delay_at(headers), DUE)


def resolve_delay(headers: Column, now_ms: Column, max_ms: int) -> Column:
    """Struct (verdict, headers): a delay request becomes the time it is due.

    Requests beyond the longest delay (0: none) and due times set by a client are
    refused; headers without a request come back as they are.
    """
    at = _delay_at(headers)
    asked = _block(headers, at, DELAY)
    due = F.coalesce(F.try_add(now_ms.cast("long"), asked), F.lit(LONG_MAX))
    patched = F.concat(F.substring(headers, F.lit(1), at), F.lit(DUE), le8(due), F.substring(headers, at + BLOCK + 1, F.octet_length(headers)))
    none = F.lit(None).cast("binary")
    return (
        F.when(asked.isNull() & due_ms(headers).isNotNull(), F.struct(F.lit("due_injected").alias("verdict"), none.alias("headers")))
        .when(asked.isNull(), F.struct(F.lit("unchanged").alias("verdict"), headers.alias("headers")))
        .when((F.lit(max_ms) != 0) & (asked > max_ms), F.struct(F.lit("too_long").alias("verdict"), none.alias("headers")))
        .otherwise(F.struct(F.lit("delayed").alias("verdict"), patched.alias("headers")))
    )


PACKED = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("compressed", T.BooleanType())])


@F.pandas_udf(PACKED)
def compress(payload: pd.Series) -> pd.DataFrame:
    """zstd, but never larger than the payload: then it stays as it is."""
    c = zstandard.ZstdCompressor(level=3)
    out = [(p, False) if p is None or len(z := c.compress(p)) >= len(p) else (z, True) for p in payload]
    return pd.DataFrame(out, columns=["payload", "compressed"])


MAX_PLAIN = 1 << 30


@F.pandas_udf(T.BinaryType())
def decompress(payload: pd.Series, compressed: pd.Series) -> pd.Series:
    """The inverse; null for damaged bytes or ones that claim to be too large."""
    d = zstandard.ZstdDecompressor()

    def one(p: bytes | None, z: bool) -> bytes | None:
        if p is None or not z:
            return p
        try:
            if not 0 <= zstandard.frame_content_size(p) <= MAX_PLAIN:
                return None
            return d.decompress(p)
        except zstandard.ZstdError:
            return None

    return pd.Series([one(p, z) for p, z in zip(payload, compressed, strict=True)])


def _nonce(segment_id: Column, counter: Column) -> Column:
    """Twelve bytes from a segment and a counter; a pair must not serve twice under one key."""
    return F.concat(le8(segment_id), F.substring(le8(counter), 1, 4))


def encrypt(payload: Column, key: Column, segment_id: Column, counter: Column) -> Column:
    """AES-GCM, the nonce in front and the tag behind."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), _nonce(segment_id, counter))


def decrypt(payload: Column, key: Column) -> Column:
    """The plain bytes; null if the tag does not fit the key."""
    return F.try_aes_decrypt(payload, key, F.lit("GCM"))


SNAPSHOT = "version int, streams array<struct<name:string,earliest:long,head:long>>, groups array<struct<stream:string,name:string,committed:long>>"


def admin_snapshot(lines: DataFrame, column: str = "value") -> DataFrame:
    """Groups of JSON snapshots with the range of their stream, one row a group."""
    s = lines.select(F.from_json(column, SNAPSHOT).alias("s")).select("s.*").filter("version is not null")
    g = s.select(F.explode("groups").alias("g"), "streams")
    of = F.filter("streams", lambda x: x["name"] == F.col("g.stream"))
    return g.select("g.stream", F.col("g.name").alias("group"), "g.committed", F.try_element_at(of, F.lit(1)).alias("r")).select("stream", "group", "committed", "r.earliest", "r.head")
