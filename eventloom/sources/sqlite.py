"""Tables of SQLite files as a Spark data source.

One task reads one database, inside one read transaction, so all its rows are
of one moment. Columns that a database doesn't have come as null; types are
taken as text, which the dialects parse.
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .jsonl import open_fs


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Database(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class SqliteTable(DataSource):
    """Options: ``table``, ``columns`` (comma separated), ``suffix`` for folders."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        columns = [c.strip() for c in self.options["columns"].split(",")]
        return ", ".join(["`database` string", "`row_number` long", *[f"`{c}` string" for c in columns]])

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options["table"]
        self.columns = [c.strip() for c in options["columns"].split(",")]
        self.suffix = options.get("suffix", ".db")

    def partitions(self) -> list[Database]:
        from pyarrow import fs as pafs

        fs, root = open_fs(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Database(root)]
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(self.suffix)]
        return [Database(f) for f in sorted(found)] or [Database("")]

    def read(self, partition: Database) -> Iterator[tuple]:
        if not partition.file:
            return
        link = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            link.execute("BEGIN")
            have = {row[1] for row in link.execute(f"PRAGMA table_info({_quoted(self.table)})")}
            if not have:
                return
            listed = ", ".join(f"CAST({_quoted(c)} AS TEXT)" if c in have else "NULL" for c in self.columns)
            for i, row in enumerate(link.execute(f"SELECT {listed} FROM {_quoted(self.table)}")):
                yield (partition.file, i, *row)
        finally:
            link.close()


def read_table(spark: SparkSession, path: str, table: str, columns: list[str], suffix: str = ".db") -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(table=table, columns=",".join(columns), suffix=suffix).load(path)


@dataclass(frozen=True)
class Joined:
    """A table joined to the base: ``on`` pairs its columns with the base's, ``columns``
    maps output names to its columns. ``required``: base rows without a match go."""

    table: str
    on: tuple[tuple[str, str], ...]
    columns: dict[str, str]
    required: bool = False


class SqliteJoin(DataSource):
    """Several tables of each database, joined there in one read transaction.

    Options: ``base``, ``columns`` and ``joins`` (JSON), ``suffix``. A database
    without the base or a required table has no rows; other missing tables and
    columns give nulls. Comparisons of output columns with constants are pushed
    down to the database; ``spark.sql.python.filterPushdown.enabled`` has to be set.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_join"

    def _outputs(self) -> list[str]:
        return [*json.loads(self.options["columns"]), *(c for j in json.loads(self.options["joins"]) for c in j["columns"])]

    def schema(self) -> str:
        return ", ".join(["`database` string", "`row_number` long", *[f"`{c}` string" for c in self._outputs()]])

    def reader(self, schema) -> DataSourceReader:
        return SqliteJoinReader(self.options)


PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteJoinReader(SqliteReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".db")
        self.base, self.base_columns, self.joins = options["base"], json.loads(options["columns"]), json.loads(options["joins"])
        self.pushed: list[tuple[str, str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of one output column with a text; the rest is left to Spark."""
        outputs = {*self.base_columns, *(c for j in self.joins for c in j["columns"])}
        for f in filters:
            sign = PUSHED.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in outputs and isinstance(f.value, str):
                self.pushed.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def statement(self, have: dict[str, set[str]]) -> tuple[str, list[str]] | None:
        """The query over the tables and columns that there are, and its parameters."""
        if self.base not in have:
            return None
        value = lambda alias, table, column: f"CAST({alias}.{_quoted(column)} AS TEXT)" if column in have.get(table, ()) else "NULL"
        selected = {name: value("b", self.base, column) for name, column in self.base_columns.items()}
        source = f"{_quoted(self.base)} b"
        for i, j in enumerate(self.joins):
            keys = all(own in have.get(j["table"], ()) and of in have[self.base] for own, of in j["on"])
            if not keys and j["required"]:
                return None
            if keys:
                on = " AND ".join(f"j{i}.{_quoted(own)} = b.{_quoted(of)}" for own, of in j["on"])
                source += f" {'JOIN' if j['required'] else 'LEFT JOIN'} {_quoted(j['table'])} j{i} ON {on}"
            selected |= {name: value(f"j{i}", j["table"], column) if keys else "NULL" for name, column in j["columns"].items()}
        columns = ", ".join(f"{sql} AS {_quoted(name)}" for name, sql in selected.items())
        # rows are numbered before anything is left out, so a filter changes no number
        names = ", ".join(_quoted(n) for n in selected)
        where = " AND ".join(f"{_quoted(name)} {sign} ?" for name, sign, _ in self.pushed)
        numbered = f"SELECT row_number() OVER (ORDER BY b.rowid) - 1 AS __n, {columns} FROM {source}"
        return f"SELECT __n, {names} FROM ({numbered}) {'WHERE ' + where if where else ''} ORDER BY __n", [v for _, _, v in self.pushed]

    def read(self, partition: Database) -> Iterator[tuple]:
        if not partition.file:
            return
        link = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            link.execute("BEGIN")
            tables = {self.base, *(j["table"] for j in self.joins)}
            have = {t: {row[1] for row in link.execute(f"PRAGMA table_info({_quoted(t)})")} for t in tables}
            found = self.statement({t: c for t, c in have.items() if c})
            for row in link.execute(*found) if found else ():
                yield (partition.file, *row)
        finally:
            link.close()


def read_joined(spark: SparkSession, path: str, base: str, columns: dict[str, str], joins: list[Joined], suffix: str = ".db") -> DataFrame:
    """(database, row_number, outputs as text): ``columns`` maps output names to the base's columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when the query is planned
    spark.dataSource.register(SqliteJoin)
    described = json.dumps([{"table": j.table, "on": j.on, "columns": j.columns, "required": j.required} for j in joins])
    return spark.read.format("sqlite_join").options(base=base, columns=json.dumps(columns), joins=described, suffix=suffix).load(path)


def schema_fingerprint(file: str) -> str:
    """SHA-256 over the tables, columns and types of one database."""
    link = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
    try:
        tables = [r[0] for r in link.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        shape = {t: [[r[1], r[2]] for r in link.execute(f"PRAGMA table_info({_quoted(t)})")] for t in tables}
    finally:
        link.close()
    return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()
