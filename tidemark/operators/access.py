"""Tokens, capabilities and revocation over small record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import sha256_hex

#: A token may be used this long before it becomes valid, in seconds (fixed value).
EARLY_S = 60


def in_force(now: Column, not_before: Column, expires: Column) -> Column:
    """Whether a token is valid: early use is forgiven for a minute, the end is exclusive; 0 means no bound."""
    return ((not_before == 0) | (now >= not_before - EARLY_S)) & ((expires == 0) | (now < expires))


def allows(granted: Column, capability: Column) -> Column:
    """Whether a list grants a capability, by name or by ``*``."""
    return F.array_contains(granted, "*") | F.array_contains(granted, capability)


def authorized(calls: DataFrame, needs: DataFrame, granted: str = "granted") -> DataFrame:
    """Calls (method, granted list) with allowed: methods that ``needs`` (method, capability) does not name are refused.

    The map of methods is small as a rule; Spark chooses the join by its size.
    """
    return calls.join(needs, "method", "left").withColumn("allowed", F.coalesce(F.col("capability").isNotNull() & allows(F.col(granted), F.col("capability")), F.lit(False)))


def redeemed(requests: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """(secret, ordinal, consumes) of requests (secret) that a token (ordinal, hash, expires, consumed, single_use) admits.

    Consumed and expired tokens (at or after ``expires``; 0 never) do not count;
    of several the one with the greatest ordinal is taken.
    """
    open_ = tokens.where(~F.col("consumed") & ((F.col("expires") == 0) | (now < F.col("expires"))))
    asked = requests.select("secret").distinct().withColumn("hash", sha256_hex(F.col("secret")))
    return asked.join(open_, "hash").groupBy("secret").agg(F.max(F.struct("ordinal", "single_use")).alias("m")).select("secret", "m.ordinal", F.col("m.single_use").alias("consumes"))


def revoked(certificates: DataFrame, serials: DataFrame) -> DataFrame:
    """Certificates whose serial (decimal text of any length) is listed."""
    return certificates.join(serials.select("serial").distinct(), "serial", "left_semi")


def sorted_serials(serials: DataFrame) -> DataFrame:
    """Distinct serials in numeric order: by length, then text."""
    return serials.select("serial").distinct().orderBy(F.length("serial"), "serial")


def matching(volumes: DataFrame, text: str) -> DataFrame:
    """Volumes whose path or holder contains a text, whatever its case; a blank text matches all."""
    t = text.strip().lower()
    return volumes if not t else volumes.where(F.contains(F.lower("path"), F.lit(t)) | F.coalesce(F.contains(F.lower("holder"), F.lit(t)), F.lit(False)))
