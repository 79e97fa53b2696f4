"""Signal providers: tables of a signal by item, looked up for the ids of a candidate set."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.hashing import synthetic_popularity
from tessaline.functions.vectors import age_days
from tessaline.session import cut

MAX_BATCH = 1000  # ids of one query


class ProviderError(RuntimeError):
    """A signal that cannot be had."""


class Provider(Protocol):
    """A name, and get: (item_id, value) of those of the given item_ids that have one. It raises ProviderError as a whole or not at all."""

    name: str

    def get(self, ids: DataFrame) -> DataFrame: ...


class EmbeddingLookup(Protocol):
    """(item_id, vector) of those of the given item_ids that have a vector."""

    def __call__(self, ids: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SyntheticPopularity:
    """A stand-in: a number from the item's hash."""

    name: str = "synthetic"

    def get(self, ids: DataFrame) -> DataFrame:
        return ids.select("item_id", synthetic_popularity(F.col("item_id")).alias("value"))


@dataclass(frozen=True)
class TableSignal:
    """Values of a table (item_id, value); items without one get the default, or nothing where it is None."""

    table: DataFrame = field(repr=False)
    default: float | None = 0.0
    name: str = "table"

    def get(self, ids: DataFrame) -> DataFrame:
        if self.default is None:
            return ids.join(self.table.select("item_id", "value"), "item_id")
        return ids.join(self.table.select("item_id", "value"), "item_id", "left").select("item_id", F.coalesce("value", F.lit(float(self.default))).alias("value"))


@dataclass(frozen=True)
class CreatedAtRecency:
    """Days since created_at; items without it have no value. The caller gives the time."""

    items: DataFrame = field(repr=False)
    now: Column = field(repr=False)
    name: str = "created_at"

    def get(self, ids: DataFrame) -> DataFrame:
        ages = self.items.select("item_id", age_days(self.now, F.col("created_at")).alias("value")).filter("value IS NOT NULL")
        return ids.join(ages, "item_id")


@dataclass(frozen=True)
class Unavailable:
    """A provider that always fails."""

    name: str = "unavailable"

    def get(self, ids: DataFrame) -> DataFrame:
        raise ProviderError(self.name)


def table_lookup(items: DataFrame) -> EmbeddingLookup:
    return lambda ids: ids.join(items.select("item_id", "vector"), "item_id")


def fetch(provider: Provider, ids: DataFrame, most: int = MAX_BATCH, per_query: int = 0) -> DataFrame | None:
    """The provider's values for distinct ids, or None if it fails, be it when it is asked or when its values are computed; per_query (ids that one query may ask for) beyond most is a failure too. The values, one for each candidate at most, are written, so that a later failure cannot come from here."""
    try:
        if per_query > most:
            raise ProviderError(f"{per_query} ids, {most} at most")
        return cut(provider.get(ids))
    except (ProviderError, PySparkException, Py4JJavaError):
        return None
