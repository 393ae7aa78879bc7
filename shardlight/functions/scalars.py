"""Scalar expressions; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardlight.runtime import WHITESPACE


def stable_hash(c: Column) -> Column:
    """First eight bytes of the SHA-256 of a string as an unsigned integer, DECIMAL(20,0)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def shard_of(c: Column, shards: int) -> Column:
    """Shard of a document id."""
    return (stable_hash(c) % F.lit(shards).cast("decimal(20,0)")).cast("int")


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = l2_norm(v)
    return F.transform(as_doubles(v), lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def half_precision(v: Column) -> Column:
    """The vector rounded to the half-precision grid (ties to even), as floats; beyond its range infinite."""

    def to_half(x: Column) -> Column:
        x = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        near = F.rint(x / step) * step
        big = F.when(F.abs(near) > 65504.0, F.signum(x) * F.lit(float("inf"))).otherwise(near)
        return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(big).cast("float")

    return F.transform(v, to_half)


def preview(c: Column, length: int = 50) -> Column:
    """The first characters of a text."""
    return F.substring(c, 1, length)


def memory_string(rss: int, vms: int) -> str:
    """Resident and virtual memory in megabytes."""
    return f"RSS: {rss / 2**20:.1f}MB, VMS: {vms / 2**20:.1f}MB"


def checksum(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def iso_timestamp(c: Column) -> Column:
    return F.to_timestamp_ntz(c)
