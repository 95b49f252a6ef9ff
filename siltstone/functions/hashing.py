"""Deterministic choices from salted digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Salt of the split buckets (fixed value).
SALT = "forge-v1"


def hex_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a number (up to 15 digits fit a bigint)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def digest_number(key: Column, salt: str, digits: int = 12) -> Column:
    """Number from sha-256 of ``key|salt``."""
    return hex_number(F.sha2(F.concat(key, F.lit(f"|{salt}")), 256), digits)


def group_id(doc_id: Column) -> Column:
    return F.concat(F.lit("grp_"), doc_id.cast("string"))


def split_of_group(group: Column, salt: str = SALT) -> Column:
    """train, val or test (80/10/10) by the bucket of the group, so that a group never straddles."""
    bucket = F.pmod(hex_number(F.sha2(F.concat(group, F.lit(salt)), 256), 8), F.lit(10_000))
    return F.when(bucket < 8000, "train").when(bucket < 9000, "val").otherwise("test")


def pick(options: list, number: Column) -> Column:
    """The option at ``number`` modulo their count."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def token_budget(words: Column, grid_max: int) -> Column:
    """Room in tokens for a target in words: 1.35 tokens a word, 1.3 headroom, from 96 to ``grid_max``."""
    return F.greatest(F.lit(96), F.least(F.floor(words * 1.35 * 1.3).cast("int"), F.lit(grid_max)))
