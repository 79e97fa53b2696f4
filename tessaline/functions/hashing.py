"""Identity and bucketing hashes as Catalyst expressions. Strings are hashed as UTF-8."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000
INNER_PAD, OUTER_PAD, HMAC_BLOCK = 0x36, 0x5C, 64


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def short_hash(text: Column, digits: int = 16) -> Column:
    """The first hex digits of a text's SHA-256."""
    return F.substring(sha256(text), 1, digits)


def synthetic_popularity(item: Column) -> Column:
    """A stable number from 0 to 999 for an id: its first 32 hash bits modulo 1000."""
    return (F.conv(F.substring(sha256(item), 1, 8), 16, 10).cast("long") % 1000).cast("double")


def bucket(salt: Column, user: Column, buckets: int = BUCKETS) -> Column:
    """The 256-bit hash of salt:user modulo buckets: eight 32-bit parts, each times its power of 2^32 modulo buckets."""
    digest = sha256(F.concat_ws(":", salt, user))
    total = F.lit(0).cast("long")
    for i in range(8):
        part = F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long")
        total = total + part % buckets * F.lit(pow(1 << 32, 7 - i, buckets))
    return (total % buckets).cast("int")


def effective_salt(environment: Column, salt: Column, override: Column | None = None) -> Column:
    return F.concat_ws(":", F.coalesce(override, environment) if override is not None else environment, salt)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash in hex; the padded keys are constants of the plan."""
    if not key:
        raise ValueError("an HMAC key must not be empty")
    padded = (hashlib.sha256(key).digest() if len(key) > HMAC_BLOCK else key).ljust(HMAC_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (INNER_PAD, OUTER_PAD))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def event_id(request: Column, index: Column) -> Column:
    return sha256(F.concat_ws(":", request, index.cast("string")))


def exposure_id(experiment: Column, request: Column) -> Column:
    return sha256(F.concat_ws(":", F.lit("exposure"), experiment, request))


def canonical_json(fields: dict) -> str:
    """Sorted keys and compact separators."""
    return json.dumps(fields, sort_keys=True, separators=(",", ":"))


def canonical_json_column(fields: dict[str, Column]) -> Column:
    """The same as a column, for texts and numbers: keys in order, ASCII only, nulls kept."""
    escape = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":|\}$", "")
    parts = [F.concat(F.lit(json.dumps(name) + ":"), F.when(c.isNull(), F.lit("null")).otherwise(_ascii(escape(c)))) for name, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _ascii(text: Column) -> Column:
    """JSON text with every other character as its escape, in pairs beyond 16 bits. Rows of ASCII take no part."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    code = lambda c: F.ascii(c).cast("long")
    pair = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000) % 1024))
    escaped = F.transform(F.split(text, ""), lambda c: F.when(code(c) < 128, c).when(code(c) < 0x10000, unit(code(c))).otherwise(pair(code(c))))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.array_join(escaped, ""))


def index_version(canonical: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("idx-"), short_hash(canonical, digits))


def blake2b_128(text: Column) -> Column:
    """BLAKE2b with 16 bytes; Spark has no built-in, so batches go through Arrow."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=16).hexdigest())

    return digest(text)


def credential_bucket(key: bytes, credential: Column) -> Column:
    """A credential's rate-limit bucket: stripped, cut to 4096 characters, keyed hash of 32 digits; null if empty."""
    from tessaline.functions.text import strip

    text = F.substring(strip(credential), 1, 4096)
    return F.when(F.length(text) > 0, F.substring(hmac_sha256(key, text), 1, 32))


def cache_key(endpoint: str, fields: Column, variant: Column | None = None, prefix: str = "cache:v1") -> Column:
    """Key of a cached candidate list: prefix, endpoint, hash of the canonical request, and the variant if there is one."""
    return F.concat_ws(":", F.lit(prefix), F.lit(endpoint), blake2b_128(fields), *([variant] if variant is not None else []))


def jittered_ttl(base_s: Column, random: Column) -> Column:
    """Whole seconds of a lifetime spread by a tenth either way, at least 1; random lies in 0..1."""
    return F.greatest(F.lit(1), F.floor(base_s * (0.9 + 0.2 * random)).cast("int"))
