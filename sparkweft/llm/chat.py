"""Conversations as prefix trees of shared turns.

Conversations that begin with the same turns share those turns' tokens.  A node is
a distinct sequence of first turns, named by a chained digest.  A conversation's
digests, one after another, are its path, and sorting conversations by path is
a depth-first walk of all trees: what a conversation shares with the one ahead of it
is on the stack already, and the rest are new nodes, whose ancestors are the stack.

The sort is one range partitioning by path and id, so a tree that holds any share of
the corpus, or any number of equal conversations, spreads over tasks.  Each
partition is walked on its own, given the last path of the one before it.  Places in a
tree that began in an earlier partition are then shifted by what the partitions
between hold of it: a fold over one short row a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, shared_dir, stored
from .tokens import VOCABULARY, encoding, vocabulary_bytes

#: Bytes of a node's digest.
DIGEST = 16
#: Conversations that end at one node and are listed in one row.
CONVERSATIONS_A_ROW = 10_000
#: Rows of one Arrow batch, and characters of the conversations that they come from.
ROWS_AT_ONCE = 500
BATCH_CHARS = 4 << 20

_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_LAST = pa.struct([("path", pa.binary()), ("tokens", pa.int64()), ("nodes", pa.int64()), ("starts", _INTERVALS), ("inherited", pa.int32())])
_NODES = pa.schema(
    [
        ("pid", pa.int32()),
        ("tree_id", pa.string()),
        ("node_id", pa.string()),
        ("parent_id", pa.string()),
        ("depth", pa.int32()),
        ("place", pa.int64()),
        ("role", pa.string()),
        ("start", pa.int64()),
        ("token_ids", pa.list_(pa.int32())),
        ("base", pa.int64()),
        ("attends", _INTERVALS),
        ("inherited", pa.int32()),
        ("conv_ids", pa.list_(pa.int64())),
        ("last", _LAST),
    ]
)
_INTERVALS_SQL = "array<struct<start: bigint, end: bigint>>"
_NODES_SQL = (
    "pid int, tree_id string, node_id string, parent_id string, depth int, place bigint, role string, start bigint, token_ids array<int>, base bigint,"
    f" attends {_INTERVALS_SQL}, inherited int, conv_ids array<bigint>,"
    f" last struct<path: binary, tokens: bigint, nodes: bigint, starts: {_INTERVALS_SQL}, inherited: int>"
)


def render(role: str, text: str) -> str:
    """A turn as text to tokenise."""
    return f"<|{role}|>\n{text}\n"


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, path, turns)``: the chained digests of a conversation's turns as one binary, and its turns in order."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    chain = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(F.md5(F.concat_ws("\x1f", F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t["role"], t["text"])))),
        lambda acc: F.unhex(F.array_join(acc, "")),
    )
    return whole.select("conv_id", chain.alias("path"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """How many digests two paths have in common from the root."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:  # the first lo digests are equal, the first hi + 1 aren't
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Walk:
    """The walk through one partition's conversations, in order; ``before`` is the last path ahead of it."""

    def __init__(self, pid: int, before: bytes, encode, in_a_row: int):
        self.pid, self.path, self.encode, self.in_a_row = pid, before, encode, in_a_row
        self.stack: list[tuple[int | None, int]] = []  # start (None: in an earlier partition) and tokens of the nodes of the path
        self.tokens = self.nodes = 0  # of the current tree, in this partition
        self.first = True
        self.open: dict | None = None  # the row that lists the conversations which end where the latest does
        self.rows: list[dict] = []

    def _row(self, path: bytes, k: int, role: str) -> dict:
        tree, parent, node = (path[DIGEST * d : DIGEST * (d + 1)].hex() for d in (0, max(0, k - 1), k))
        return {"pid": self.pid, "tree_id": tree, "node_id": node, "parent_id": parent if k else None, "depth": k, "role": role, "conv_ids": []}

    def _turn_to(self, row: dict | None) -> None:
        if self.open:
            self.rows.append(self.open)
        self.open = row

    def add(self, conv_id: int, path: bytes, turns: list[dict]) -> None:
        depth, same = len(path) // DIGEST, _shared(self.path, path)
        if self.first:
            self.stack = [(None, len(self.encode(render(t["role"], t["text"])))) for t in turns[:same]]
        elif not same:
            self.tokens = self.nodes = 0
        del self.stack[same:]
        for k in range(same, depth):
            ids = self.encode(render(turns[k]["role"], turns[k]["text"]))
            spans = [{"start": s or 0, "end": (s or 0) + n} for s, n in self.stack]
            here = {"place": self.nodes, "start": self.tokens, "token_ids": ids, "base": sum(n for _, n in self.stack), "attends": spans, "inherited": sum(s is None for s, _ in self.stack)}
            self._turn_to(self._row(path, k, turns[k]["role"]) | here)
            self.stack.append((self.tokens, len(ids)))
            self.tokens += len(ids)
            self.nodes += 1
        if same == depth and (not self.open or len(self.open["conv_ids"]) >= self.in_a_row):
            self._turn_to(self._row(path, depth - 1, turns[-1]["role"]))
        self.open["conv_ids"].append(conv_id)
        self.path, self.first = path, False

    def end(self) -> None:
        self._turn_to(None)
        if not self.first:
            starts = [{"start": s or 0, "end": (s or 0) + n} for s, n in self.stack]
            last = {"path": self.path, "tokens": self.tokens, "nodes": self.nodes, "starts": starts, "inherited": sum(s is None for s, _ in self.stack)}
            self.rows.append({"pid": self.pid, "last": last})


def _fold(lasts: list) -> list[tuple]:
    """For each partition (pid, tree, tokens, nodes, intervals): what those ahead of it hold of the tree that they end in, and where the nodes of their last path are."""
    shifts, tree, tokens, nodes, spans = [], None, 0, 0, []
    for r in lasts:
        if tree is not None:
            shifts.append((r["pid"], tree, tokens, nodes, spans))
        end = r["last"]
        root = bytes(end["path"])[:DIGEST].hex()
        if root == tree:
            spans = spans[: end["inherited"]] + [(x["start"] + tokens, x["end"] + tokens) for x in end["starts"][end["inherited"] :]]
            tokens, nodes = tokens + end["tokens"], nodes + end["nodes"]
        else:
            spans = [(x["start"], x["end"]) for x in end["starts"]]
            tree, tokens, nodes = root, end["tokens"], end["nodes"]
    return shifts


def prefix_trees(turns: DataFrame, vocabulary: str = VOCABULARY, partitions: int | None = None) -> DataFrame:
    """One row a node, in the packed sequence of its tree.

    Columns: ``tree_id`` and ``node_id``; ``parent_id`` (null at the root), ``depth``;
    ``place`` (from 0, depth-first); ``role``; ``start`` and ``end`` of the node's tokens
    in the tree's sequence; ``token_ids``; ``position_ids`` (a token's place in its own
    conversation); ``attends`` (the intervals of the ancestors' tokens, from the root
    down, which the node's tokens see besides those of the node ahead of them); and
    ``conv_ids``, the conversations that end at the node, in order.

    Where more than ``CONVERSATIONS_A_ROW`` conversations end at one node, or those lie in
    several partitions, further rows of the node list the rest: they have its ids, depth and
    role, and null in the columns of places and tokens.  Each conversation is in one row.

    ``turns`` needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns are
    ignored.  Turns are ordered by number (nulls first), then role and text; repeated rows
    count once.  Null roles and texts are empty, rows without a conversation are left
    out.  Equal conversations share all nodes.  A tree is all conversations with the
    same first turn; children come in the order of their ids.  An empty table gives no
    rows.  A conversation, with all its turns, is held by one task.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    vocab = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    paths = stored(conversation_paths(turns), "paths")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a checkpoint keeps partitions and their order, for both passes
    walked = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    ends = {r["pid"]: bytes(r["path"]) for r in walked.groupBy(F.spark_partition_id().alias("pid")).agg(F.max("path").alias("path")).collect()}
    before, last = {}, b""
    for pid in sorted(ends):
        before[pid], last = last, ends[pid]
    known, in_a_row = spark.sparkContext.broadcast(before), CONVERSATIONS_A_ROW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        walk, seen = _Walk(pid, known.value.get(pid, b""), encoding(vocab.value).encode_ordinary, in_a_row), 0
        for batch in batches:
            for conv_id, path, told in zip(*(batch.column(k) for k in range(3))):
                told = told.as_py()
                walk.add(conv_id.as_py(), path.as_py(), told)
                seen += sum(len(t["text"]) for t in told)
                if len(walk.rows) >= ROWS_AT_ONCE or seen > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(walk.rows, _NODES)
                    walk.rows, seen = [], 0
        walk.end()
        if walk.rows:
            yield pa.RecordBatch.from_pylist(walk.rows, _NODES)

    nodes = stored(walked.mapInArrow(run, _NODES_SQL), "nodes")
    shifts = _fold(nodes.where("last is not null").select("pid", "last").orderBy("pid").collect())
    shift = spark.createDataFrame(shifts, f"pid int, tree_id string, tokens bigint, nodes bigint, above {_INTERVALS_SQL}")
    # at most a row a partition
    found = nodes.where("last is null").join(F.broadcast(shift), ["pid", "tree_id"], "left")
    tokens, size = F.coalesce("tokens", F.lit(0)), F.size("token_ids").cast("bigint")
    below = F.slice("attends", F.col("inherited") + 1, F.size("attends"))
    moved = F.transform(below, lambda x: F.struct((x["start"] + tokens).alias("start"), (x["end"] + tokens).alias("end")))
    above = F.slice(F.coalesce("above", F.array().cast(_INTERVALS_SQL)), F.lit(1), F.col("inherited"))
    placed = F.col("token_ids").isNotNull()
    return found.select(
        "tree_id",
        "node_id",
        "parent_id",
        "depth",
        (F.col("place") + F.coalesce("nodes", F.lit(0))).alias("place"),
        "role",
        (F.col("start") + tokens).alias("start"),
        F.when(placed, F.col("start") + tokens + size).alias("end"),
        "token_ids",
        F.when(placed, F.when(size > 0, F.sequence("base", F.col("base") + size - 1)).otherwise(F.array().cast("array<bigint>"))).alias("position_ids"),
        F.when(placed, F.concat(above, moved)).alias("attends"),
        "conv_ids",
    )
