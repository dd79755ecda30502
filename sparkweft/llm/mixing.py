"""Mixing sources to target weights by hierarchical budgets.

Documents are the leaves' stock in a tree, by default domain, language, source.
Each node has an integer weight among its siblings.  The token budget of the
root is handed down level by level: children share their parent's budget by
weight, no child gets more than its subtree can give (its tokens times
``max_epochs``), and what a child cannot use goes to its siblings by weight.
Since a node's own budget was already cut to what its subtree can give, a
shortage is always settled among siblings before it reaches an ancestor.

A leaf spends its budget on whole epochs, and the rest on a prefix of the next:
documents in the order of a seeded hash of epoch and id, until the budget is
reached.  The prefix is found without sorting a leaf: tokens are summed by
leaf and leading bits of the hash, only the bucket in which the budget ends is
ordered, and the outcome is one cut-off hash a leaf.  Taking documents is then a
comparison with the plan of their leaf, so neither texts nor ids are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_enough, stored

LEVELS = ("domain", "lang", "source")
MISSING = "unknown"
BUDGET_PERCENT = 100
MAX_EPOCHS = 2
SEED = 20
BUCKET_BITS = 12

#: Production weights, by level and name; any other node has weight 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"web": 4, "books": 3, "code": 2, "news": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
DOMAINS = ("web", "books", "code", "news")


def domain_of(source: Column) -> Column:
    """The domain of a source called ``src<number>``; ``MISSING`` for any other name."""
    number = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(number != "", F.get(names, (number.try_cast("int") % len(DOMAINS)))).otherwise(F.lit(MISSING))


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A 60-bit hash that orders the documents of an epoch."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _weight(level: str, name: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("bigint")
    for key, w in weights.get(level, {}).items():
        out = F.when(F.col(name) == key, F.lit(int(w)).cast("bigint")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes that have ``capacity``, ``weight`` and ``parent_budget``.

    Siblings are filled in the order of capacity by weight: those whose share
    would exceed their capacity get the capacity, the others divide the rest.
    Shares are whole tokens, rounded down.  Nodes of weight 0 get nothing.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name))
    live = nodes.where("weight > 0")
    ranked = live.withColumn("given", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "heavy", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    full = ranked.withColumn("full", F.col("capacity") * F.col("heavy") <= F.col("weight") * (F.col("parent_budget") - F.col("given")))
    rest = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by)
    open_weight = F.sum(F.when(F.col("full"), F.lit(0).cast("bigint")).otherwise(F.col("weight"))).over(by)
    filled = full.withColumn("rest", rest).withColumn("open_weight", open_weight)
    return filled.withColumn("budget", F.expr("IF(full, capacity, (rest * weight) div open_weight)")).drop(
        "given", "heavy", "full", "rest", "open_weight"
    )


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget_percent: int, max_epochs: int
) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with each leaf's ``budget``, handed down from the root."""
    stock = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    handed = None
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = stock.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(path[-1], path[-1], weights))
        if handed is None:
            root = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(budget_percent)} div 100").alias("parent_budget"))
            nodes = nodes.crossJoin(root)
        else:
            nodes = nodes.join(handed.select(*path[:-1], F.col("budget").alias("parent_budget")), path[:-1])
        handed = share_out(nodes, path[:-1], path[-1])
    return leaves.join(handed.select(*levels, "budget"), list(levels))


def plan(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    bucket_bits: int = BUCKET_BITS,
) -> tuple[DataFrame, DataFrame]:
    """The counted documents (doc_id, levels, n_tokens), and the plan, a row a leaf; both stored.

    The plan has ``whole`` (whole epochs), ``rest`` (tokens of the next), ``cut``
    (the last hash of that epoch that is taken; null for none) and ``before`` (its
    tokens ahead of ``cut``).
    """
    names = list(levels)
    counted = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            *[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in levels.items()],
            count_tokens(F.col("text")).alias("n_tokens"),
        ),
        "counted",
    )
    leaves = counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    budgets = stored(
        leaf_budgets(leaves, names, weights, budget_percent, max_epochs)
        .withColumn("whole", F.expr("IF(tokens > 0, budget div tokens, 0)"))
        .withColumn("rest", F.expr("IF(tokens > 0, budget % tokens, 0)")),
        "budgets",
    )
    keyed = (
        counted.join(small_enough(budgets.where("rest > 0")), names)
        .withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
        .withColumn("bucket", F.shiftright("key", 60 - bucket_bits))
    )
    sums = keyed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    along = Window.partitionBy(*names).orderBy("bucket")
    edge = (
        sums.withColumn("ahead", F.sum("in_bucket").over(along) - F.col("in_bucket"))
        .where("ahead < rest and ahead + in_bucket >= rest")
        .select(*names, "bucket", "ahead")
    )
    within = keyed.join(small_enough(stored(edge, "edge")), [*names, "bucket"])
    by_key = within.groupBy(*names, "key").agg(F.sum("n_tokens").alias("at_key"), F.first("ahead").alias("ahead"), F.first("rest").alias("rest"))
    inside = Window.partitionBy(*names).orderBy("key")
    cuts = (
        by_key.withColumn("before", F.col("ahead") + F.sum("at_key").over(inside) - F.col("at_key"))
        .where("before < rest")
        .groupBy(*names)
        .agg(F.max(F.struct("key", "before")).alias("last"))
        .select(*names, F.col("last.key").alias("cut"), F.col("last.before").alias("before"))
    )
    return counted, stored(budgets.join(cuts, names, "left"), "plan")


def _epochs(rows: DataFrame, names: Sequence[str], planned: DataFrame, seed: int) -> DataFrame:
    """A row for each epoch in which a document is taken, at least in part."""
    many = rows.join(small_enough(planned.select(*names, "whole", "rest", "cut", "before")), list(names))
    return (
        many.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
        .withColumn("order_key", order_key(seed, F.col("epoch"), F.col("doc_id")))
        .where("epoch < whole or order_key <= cut")
    )


def mix(docs: DataFrame, levels: Mapping[str, Column] | None = None, seed: int = SEED, **options) -> DataFrame:
    """``(doc_id, levels..., epoch, order_key, n_tokens, taken)``: what the mixture takes, a row for each document and epoch.

    ``docs`` needs ``doc_id``, ``text`` and what ``levels`` (name to expression, from
    the root down; by default domain, language, source) refers to.  ``taken`` is
    ``n_tokens`` but for the document in which a leaf's budget ends; within an epoch
    documents come by ``order_key``.  Options are those of :func:`plan`.  Null names
    are the node ``unknown``; null ids are ordered as an empty id; texts without
    tokens are taken with whole epochs, or ahead of the cut-off.  Rows of equal
    ``order_key`` (repeated rows) are taken or left together, so a leaf may exceed its
    budget by their tokens.  Budgets are whole tokens: siblings may leave less than
    one token each unspent.  An empty table gives no rows.
    """
    levels = levels or default_levels(docs)
    counted, planned = plan(docs, levels, seed=seed, **options)
    taken = F.when(F.col("order_key") < F.col("cut"), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col("rest") - F.col("before")))
    return _epochs(counted, list(levels), planned, seed).select(
        "doc_id", *levels, "epoch", "order_key", "n_tokens", F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(taken).alias("taken")
    )


def mixed(docs: DataFrame, levels: Mapping[str, Column] | None = None, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` takes, once for each epoch, with the columns of ``docs``.

    The document in which a leaf's budget ends is taken whole.
    """
    levels = levels or default_levels(docs)
    _, planned = plan(docs, levels, seed=seed, **options)
    inner = {f"_level{k}": c for k, c in enumerate(levels.values())}
    row = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs["doc_id"].cast("bigint").alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in inner.items()],
    )
    renamed = planned.withColumnsRenamed(dict(zip(levels, inner)))
    return _epochs(row, list(inner), renamed, seed).select("_row.*")


def default_levels(docs: DataFrame) -> dict[str, Column]:
    return {"domain": domain_of(docs["source"]), "lang": docs["lang"], "source": docs["source"]}
