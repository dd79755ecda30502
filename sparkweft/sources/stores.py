"""Stores: sinks for items, which are JSON texts in a column ``item``.

``write`` takes all items of a run.  Folder stores write a part for each task; the
single-file and SQLite stores pass items over the driver one by one, holding none.
"""

from __future__ import annotations

import json
import re
import sqlite3
import time
from collections.abc import Iterable, Iterator, Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import field_text, has_field

CSV_OPTIONS = {"escape": '"', "quote": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


class Store(Protocol):
    def write(self, items: DataFrame) -> None: ...


class StoreError(ValueError):
    """Items or names that a store can't take."""


def _texts(items: DataFrame, column: str = "item") -> Iterator[str]:
    return (r[0] for r in items.select(column).toLocalIterator(prefetchPartitions=True))


def table_name(name: str) -> str:
    """The name, if it is 1 to 63 ASCII letters, digits and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_]{1,63}", name):
        raise StoreError(f"no valid name: {name!r}")
    return name


class ConsoleStore:
    """A line for each item on standard output."""

    def write(self, items: DataFrame) -> None:
        for text in _texts(items):
            print(text)


class JsonlStore:
    """JSON Lines in a folder, appended; nulls are kept."""

    def __init__(self, path: str):
        self.path = path

    def write(self, items: DataFrame) -> None:
        items.select("item").write.mode("append").text(self.path)


class JsonStore:
    """One file with a JSON array, overwritten; ``[]`` for no items."""

    def __init__(self, path: str):
        self.path = Path(path)

    def write(self, items: DataFrame) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("w", encoding="utf-8") as out:
            out.write("[")
            ahead = "\n"
            for text in _texts(items):
                out.write(ahead + json.dumps(json.loads(text), ensure_ascii=False, indent=2))
                ahead = ",\n"
            out.write("]" if ahead == "\n" else "\n]")


def csv_cell(value: Column) -> Column:
    """A cell as RFC 4180 has it: in quotes, doubled within, if it holds a comma, quote or line break."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_row(item: Column, headers: Sequence[str]) -> Column:
    """An item's line: absent and null values are empty, nested ones JSON."""
    return F.concat_ws(",", *[csv_cell(field_text(item, h)) for h in headers])


class CsvStore:
    """CSV in a folder, overwritten; the columns are ``headers`` or the keys of the first item by ``order``."""

    def __init__(self, path: str, headers: Sequence[str] = (), order: Sequence[str] = ()):
        self.path, self.headers, self.order = path, tuple(headers), tuple(order)

    def write(self, items: DataFrame) -> None:
        headers = self.headers
        if not headers:
            first = (items.orderBy(*self.order) if self.order else items).select("item").first()
            if first is None:
                items.select("item").limit(0).write.mode("overwrite").text(self.path)
                return
            head = json.loads(first[0])
            if not isinstance(head, dict):
                raise StoreError("an item is no object")
            headers = tuple(sorted(head))
        whole = F.col("item").rlike(r"^\s*\{")
        cells = [field_text(F.col("item"), h).alias(h) for h in headers]
        checked = items.where(F.when(whole, True).otherwise(F.raise_error(F.lit("an item is no object")).cast("boolean")))
        checked.select(*cells).write.mode("overwrite").options(header=True, **CSV_OPTIONS).csv(self.path)


def promoted(items: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``data`` (the item) and a text column for each promoted field: null if missing or null, nested as JSON."""
    return items.select(F.col("item").alias("data"), *[field_text(F.col("item"), table_name(c)).alias(c) for c in columns])


class SqliteStore:
    """A table of a SQLite file: id, data, created_at and promoted columns; rows are appended."""

    def __init__(self, path: str, table: str = "items", create_table: bool = True, columns: Sequence[tuple[str, str]] = ()):
        self.path, self.table, self.create_table = path, table_name(table), create_table
        self.columns = [(table_name(c), t) for c, t in columns]

    def write(self, items: DataFrame) -> None:
        names = [c for c, _ in self.columns]
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        with sqlite3.connect(self.path) as db:
            if self.create_table:
                extra = "".join(f', "{c}" {t}' for c, t in self.columns)
                db.execute(f'CREATE TABLE IF NOT EXISTS "{self.table}" (id INTEGER PRIMARY KEY AUTOINCREMENT, data TEXT NOT NULL, created_at TEXT NOT NULL{extra})')
            into = ", ".join(f'"{c}"' for c in ["data", "created_at", *names])
            rows = ((r[0], now, *r[1:]) for r in promoted(items, names).toLocalIterator(prefetchPartitions=True))
            db.executemany(f'INSERT INTO "{self.table}" ({into}) VALUES ({", ".join("?" * (2 + len(names)))})', rows)


class JdbcStore:
    """A table of a database with a JDBC driver on the class path; rows are appended by all tasks.

    With ``create_table`` the table is made if it is absent: a number that the database
    assigns, ``data`` as the database's JSON type, ``created_at``, and ``columns`` (name, type).
    """

    #: By database: number, JSON, time, and quotes.
    TYPES = {
        "postgresql": ("BIGSERIAL PRIMARY KEY", "JSONB NOT NULL", "TIMESTAMPTZ NOT NULL", '"'),
        "mysql": ("BIGINT AUTO_INCREMENT PRIMARY KEY", "JSON NOT NULL", "DATETIME NOT NULL", "`"),
        "derby": ("BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY", "CLOB NOT NULL", "TIMESTAMP NOT NULL", '"'),
    }

    def __init__(self, url: str, table: str = "items", columns: Sequence[tuple[str, str]] = (), properties: dict[str, str] | None = None, create_table: bool = True):
        self.url, self.table, self.properties, self.create_table = url, table_name(table), properties or {}, create_table
        self.columns = [(table_name(c), t) for c, t in columns]
        self.database = url.split(":")[1] if url.startswith("jdbc:") else ""
        if self.database not in self.TYPES:
            raise StoreError(f"unknown database {url!r}")

    def ddl(self) -> str:
        number, data, time_, q = self.TYPES[self.database]
        extra = "".join(f", {q}{c}{q} {t}" for c, t in self.columns)
        name = f"{q}{self.table}{q}"
        absent = "" if self.database == "derby" else "IF NOT EXISTS "
        return f"CREATE TABLE {absent}{name} ({q}id{q} {number}, {q}data{q} {data}, {q}created_at{q} {time_}{extra})"

    def _create(self, items: DataFrame) -> None:
        jvm = items.sparkSession._jvm
        options = jvm.java.util.Properties()
        for k, v in self.properties.items():
            options.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, options)
        try:
            there = connection.getMetaData().getTables(None, None, self.table, None)
            if not there.next():
                connection.createStatement().execute(self.ddl())
        finally:
            connection.close()

    def write(self, items: DataFrame) -> None:
        if self.create_table:
            self._create(items)
        rows = promoted(items, [c for c, _ in self.columns]).withColumn("created_at", F.current_timestamp())
        q = self.TYPES[self.database][3]
        # texts go to JSON columns untyped where the database asks for it
        properties = {"stringtype": "unspecified"} | self.properties if self.database == "postgresql" else self.properties
        rows.write.mode("append").jdbc(self.url, f"{q}{self.table}{q}", properties=properties)


class ObjectStore:
    """JSON Lines or a JSON array as an object under a Hadoop path (``s3a://``, ``gs://``, ``file://``).

    No items, no object.  Lines go into a folder of the object's name, a part a task;
    an array is written by one task, which holds none of it.  Either has an item a line,
    so that :meth:`read` spreads over tasks.
    """

    def __init__(self, root: str, prefix: str = "", kind: str = "jsonl", filename: str | None = None):
        if kind not in ("jsonl", "json"):
            raise StoreError(f"unknown format {kind}")
        self.root, self.prefix, self.kind = root.rstrip("/"), prefix.rstrip("/"), kind
        self.filename = filename or f"items-{int(time.time() * 1000)}.{kind}"

    @property
    def path(self) -> str:
        return "/".join(x for x in (self.root, self.prefix, self.filename) if x)

    def write(self, items: DataFrame) -> None:
        if items.isEmpty():
            return
        lines = items.select(F.translate("item", "\r\n", "  ").alias("item"))  # within JSON these are white space
        if self.kind == "jsonl":
            lines.write.mode("overwrite").text(self.path)
        else:
            lines.coalesce(1).mapInArrow(_as_array, "value string").write.mode("overwrite").text(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """The items of an object that :meth:`write` made, as they were given; none if there is no object."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], "item string")
        lines = spark.read.text(self.path)
        if self.kind == "json":  # an element is a line, after a bracket or a comma
            lines = lines.where("value <> ']'").select(F.expr("substring(value, 2)").alias("value"))
        return lines.select(F.col("value").alias("item"))


def _as_array(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a JSON array of all texts."""
    ahead = "["
    for b in batches:
        lines = []
        for text in b.column(0).to_pylist():
            lines.append(ahead + text)
            ahead = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["]" if ahead == "," else "[]"]})


__all__ = ["ConsoleStore", "CsvStore", "JdbcStore", "JsonStore", "JsonlStore", "ObjectStore", "SqliteStore", "Store", "StoreError", "csv_row", "has_field", "promoted", "table_name"]
