"""Structured Streaming: pages that arrive in a folder, extracted, piped and stored as they come."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import ExtractPlan, ExtractSpec, Rows
from ..operators.items import Step, run_pipeline
from ..sources.stores import Store


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id bigint, url string, html string", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they appear; ``files_per_trigger`` bounds what a batch takes in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def item_stream(pages: DataFrame, selector: str, spec: ExtractSpec, keep: Sequence[str] = ("url",), steps: Sequence[Step] = ()) -> DataFrame:
    """A stream of items (``keep``, ``pos``, ``item``) that pages give, after the pipeline's steps."""
    rows = ExtractPlan({"rows": Rows(selector, spec)}).column(F.col("html"))["rows"]
    items = pages.select(*keep, F.posexplode(rows).alias("pos", "_item"))
    return run_pipeline(items.select(*keep, "pos", F.to_json("_item", {"ignoreNullFields": "false"}).alias("item")), steps)


def into(items: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch to a store; the checkpoint makes a restarted query go on where it stopped."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        store.write(kept)
        kept.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_counts(pages: DataFrame, observe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pages`` with the metrics ``crawl`` (pages, bytes) observed for each batch by query listeners."""
    observed = pages.observe("crawl", F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
    return observe(observed) if observe else observed
