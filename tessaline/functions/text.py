"""Text preparation and small parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.functions.hashing import short_hash

#: The longest item text, what stands between title and description, and the characters that count as white space.
MAX_CHARS, SEPARATOR = 512, " | "
SPACE = r"(?U:[\s\x1C-\x1F])"  # \s: the white space of Unicode


def nfkc(text: Column) -> Column:
    """NFKC; only rows with other than ASCII characters go through Arrow."""
    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(normal(F.when(~ascii_only, text)))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def collapse_head(text: Column, most: int) -> Column:
    """collapse(text), of which only the first most characters count: a long text is read no further than it takes."""
    head = collapse(F.substring(text, 1, 4 * most))
    return F.when(F.length(head) > most, head).otherwise(collapse(text))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def item_text(title: Column, description: Column, normalise: bool = True) -> Column:
    """The text that represents an item: title, or title and description, at most MAX_CHARS characters."""
    prepare = lambda c: collapse_head(nfkc(c) if normalise else c, MAX_CHARS)
    title, description = prepare(title), prepare(description)
    both = F.when(F.length(description) > 0, F.concat(title, F.lit(SEPARATOR), description)).otherwise(title)
    return F.trim(F.substring(both, 1, MAX_CHARS))


def content_hash(title: Column, description: Column, normalise: bool = True) -> Column:
    return short_hash(item_text(title, description, normalise))


def query_text(title: Column, description: Column) -> Column:
    return F.concat(strip(title), F.lit(SEPARATOR), strip(description))


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(literal: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(literal, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))


def version_pair(text: Column) -> Column:
    """(major, minor) of a version text with any suffix; (0, 0) if it has none."""
    major, minor = F.regexp_extract(text, r"^(\d+)\.(\d+)", 1), F.regexp_extract(text, r"^(\d+)\.(\d+)", 2)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return F.struct(number(major).alias("major"), number(minor).alias("minor"))


def bounded_request_id(text: Column, most: int = 64) -> Column:
    """The first characters of a request's id; 16 random hex digits if it has none."""
    made = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)
    return F.when(F.length(text) > 0, F.substring(text, 1, most)).otherwise(made)


def too_old(created: Column, now: Column, most_hours: float) -> Column:
    """Whether a report's time lies more than so many hours before now; null for a text that is no time with an offset."""
    return (F.unix_micros(now) - F.unix_micros(iso_timestamp(created))) / 3600e6 > most_hours


def iso_timestamp(text: Column) -> Column:
    """A timestamp from ISO 8601 with an offset; null without one."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


#: Request paths by prefix, in the order they are tried, and paths that no limit applies to.
PATH_CLASSES = (("/v1/recommend", "recommend"), ("/v1/items/", "recommend"), ("/v1/events", "events"), ("/v1/churn/", "churn"))
EXEMPT_PATHS = ("/livez", "/healthz", "/readyz", "/metrics", "/docs", "/redoc", "/openapi.json")
LONGEST_IP = 45


def path_class(path: Column) -> Column:
    """Rate-limit class by the first prefix that fits; null for exempt and other paths."""
    out = F.when(path.isin(*EXEMPT_PATHS), F.lit(None).cast("string"))
    for prefix, name in PATH_CLASSES:
        out = out.when(path.startswith(prefix), F.lit(name))
    return out


def looks_like_ip(text: Column) -> Column:
    return (F.length(text) <= LONGEST_IP) & (text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (text.rlike(r"^[0-9A-Fa-f:]+$") & text.contains(":")))


def client_ip(forwarded: Column, peer: Column, trusted: int) -> Column:
    """The trusted-th address from the right of a forwarding header, else the peer, else unknown."""
    hops = F.transform(F.split(forwarded, ","), lambda hop: F.trim(hop))
    chosen = F.try_element_at(hops, F.lit(-trusted)) if trusted else F.lit(None).cast("string")
    return F.when(looks_like_ip(chosen), chosen).when(looks_like_ip(peer), peer).otherwise("unknown")
