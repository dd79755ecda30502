"""Item pipelines: ordered transforms of a DataFrame of items.

Items are JSON texts in one column (``item``), as they come from a crawl; every
step takes a DataFrame and returns one, and steps are applied in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def run_pipeline(items: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        items = step(items)
    return items


def has_field(item: Column, field: str) -> Column:
    """The item is an object with the key, whatever its value; null counts as a value."""
    return F.coalesce(F.array_contains(F.json_object_keys(item), field), F.lit(False))


def field_text(item: Column, field: str) -> Column:
    """A field for a relational column: texts as they are, other values as JSON, null if missing or null."""
    value = F.try_variant_get(F.try_parse_json(item), f"$['{field}']", "variant")
    as_text = F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.when(value.isNotNull() & ~F.is_variant_null(value), as_text)


def canonical(item: Column) -> Column:
    """The item's JSON with keys in order and no blanks; the text itself if it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(item)), item)


@dataclass(frozen=True)
class RequireFields:
    """Drops items that lack one of the keys; a present null passes, and items that are no objects are dropped."""

    fields: tuple[str, ...]
    column: str = "item"

    def __init__(self, *fields: str, column: str = "item"):
        object.__setattr__(self, "fields", fields)
        object.__setattr__(self, "column", column)

    def __call__(self, items: DataFrame) -> DataFrame:
        for f in self.fields:
            items = items.where(has_field(F.col(self.column), f))
        return items


@dataclass(frozen=True)
class FilterItems:
    """Keeps items for which an expression is true; false and null drop."""

    condition: Column

    def __call__(self, items: DataFrame) -> DataFrame:
        return items.where(F.coalesce(self.condition, F.lit(False)))


@dataclass(frozen=True)
class MapItems:
    """Applies a Python function to each item; None drops it, and so does an exception."""

    function: Callable[[object], object | None]
    column: str = "item"

    def __call__(self, items: DataFrame) -> DataFrame:
        function, column = self.function, self.column

        def one(text: str | None) -> str | None:
            try:
                v = function(json.loads(text))
            except Exception:  # a failing item is dropped, the crawl goes on
                return None
            return None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b[column] = [one(x) for x in b[column]]
                yield b[b[column].notna()]

        return items.mapInPandas(run, items.schema)


@dataclass(frozen=True)
class DropDuplicates:
    """Keeps the first item of each key, by the columns ``order``.

    The key is the field's value if that is a JSON string, else the whole item's JSON.
    With ``seen``, a folder of keys of earlier runs, items with those keys are dropped
    and new keys are added by :meth:`remember`.
    """

    field: str
    order: tuple[str, ...]
    column: str = "item"
    seen: str | None = None

    @classmethod
    def by_field(cls, field: str, order: Sequence[str] = ("seq",), column: str = "item") -> DropDuplicates:
        return cls(field, tuple(order), column)

    def with_persistence(self, path: str) -> DropDuplicates:
        return DropDuplicates(self.field, self.order, self.column, path)

    def key(self) -> Column:
        item = F.col(self.column)
        value = F.try_variant_get(F.try_parse_json(item), f"$['{self.field}']", "variant")
        text = F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))
        return F.coalesce(text, canonical(item))

    def _known(self, items: DataFrame) -> DataFrame | None:
        if not self.seen:
            return None
        try:
            return items.sparkSession.read.schema("key string").parquet(self.seen)
        except AnalysisException:  # no run has left keys yet
            return None

    def __call__(self, items: DataFrame) -> DataFrame:
        keyed = items.withColumn("_key", self.key())
        known = self._known(items)
        if known is not None:
            keyed = keyed.join(known.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti")
        first = Window.partitionBy("_key").orderBy(*self.order)
        return keyed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*items.columns)

    def remember(self, kept: DataFrame) -> None:
        """Adds the keys of items that this step kept."""
        kept.select(self.key().alias("key")).distinct().write.mode("append").parquet(self.seen)

    def on_stream(self, items: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
        """For streams: the first of each key to arrive, within a watermark if there is an event time."""
        keyed = items.withColumn("_key", self.key())
        if event_time:
            keyed = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
        else:
            keyed = keyed.dropDuplicates(["_key"])
        return keyed.drop("_key")
