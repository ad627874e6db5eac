"""Fact tables of a database, by any DB-API driver.

    register(spark)
    spark.read.format("dbapi").schema("app_id string, id long, name string")
        .options(driver="sqlite3", connect='{"database": "/kb.db"}', table="app_tables", partition="id", partitions=8).load()

Comparisons of a column with a value run in the database, which returns only the columns
asked for; the rows are cut into ranges of a whole-number column, one query a task.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

_OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _name(c: str) -> str:
    """A quoted identifier, schema and table apart."""
    return ".".join('"' + part.replace('"', '""') + '"' for part in c.split("."))


def condition(f) -> tuple[str, list] | None:
    """SQL and its values for a filter, or None where the database can't be asked."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    c = _name(f.attribute[0])
    if isinstance(f, ds.IsNotNull):
        return f"{c} IS NOT NULL", []
    if isinstance(f, ds.IsNull):
        return f"{c} IS NULL", []
    if isinstance(f, ds.In):
        values = [v for v in f.value if v is not None]
        return (f"{c} IN ({', '.join(['?'] * len(values))})", values) if values and all(isinstance(v, (int, float, str)) for v in values) else None
    if type(f) in _OPERATORS and isinstance(f.value, (int, float, str)):
        return f"{c} {_OPERATORS[type(f)]} ?", [f.value]
    return None


@dataclass
class Range(ds.InputPartition):
    """Rows from ``first`` to before ``last``; the first range also takes those without a value."""

    first: int | None = None
    last: int | None = None


class DbReader(ds.DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.options, self.names = dict(options), [f.name for f in schema.fields]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        for f in filters:
            asked = condition(f)
            if asked is None:
                yield f
            else:
                self.where.append(asked[0])
                self.values += asked[1]

    def query(self, columns: str, more: list[str], values: list):
        """Rows of a query, a few at a time."""
        driver = importlib.import_module(self.options["driver"])
        sql = f"SELECT {columns} FROM {_name(self.options['table'])}"
        if self.where + more:
            sql += " WHERE " + " AND ".join(f"({w})" for w in [*self.where, *more])
        if driver.paramstyle in ("format", "pyformat"):
            sql = sql.replace("%", "%%").replace("?", "%s")
        elif driver.paramstyle != "qmark":
            raise ValueError(f"parameters in style {driver.paramstyle} aren't known")
        connection = driver.connect(**json.loads(self.options.get("connect", "{}")))
        try:
            cursor = connection.cursor()
            cursor.execute(sql, [*self.values, *values])
            while rows := cursor.fetchmany(10_000):
                yield from rows
        finally:
            connection.close()

    def partitions(self):
        column, n = self.options.get("partition"), int(self.options.get("partitions", "1"))
        if not column or n < 2:
            return [Range()]
        low, high = next(self.query(f"MIN({_name(column)}), MAX({_name(column)})", [], []))
        if low is None:
            return [Range()]
        edges = sorted({low + (high + 1 - low) * k // n for k in range(1, n)})
        return [Range(a, b) for a, b in zip([None, *edges], [*edges, None])]

    def read(self, partition):
        column, more, values = self.options.get("partition"), [], []
        if partition.first is not None:
            more, values = [f"{_name(column)} >= ?"], [partition.first]
            if partition.last is not None:
                more, values = [f"{more[0]} AND {_name(column)} < ?"], [partition.first, partition.last]
        elif partition.last is not None:
            more, values = [f"{_name(column)} < ? OR {_name(column)} IS NULL"], [partition.last]
        for row in self.query(", ".join(map(_name, self.names)), more, values):
            yield tuple(row)


class DbSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "dbapi"

    def reader(self, schema):
        return DbReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Python sources take filters."""
    spark.dataSource.register(DbSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_kb_table(spark: SparkSession, table: str, app: str, schema: str, driver: str, connect: dict, partition: str | None = None, partitions: int = 1) -> DataFrame:
    """One application's rows of a fact table; the application is asked for in the database."""
    register(spark)
    options = {"driver": driver, "connect": json.dumps(connect), "table": table, "partitions": str(partitions)} | ({"partition": partition} if partition else {})
    return spark.read.format("dbapi").schema(schema).options(**options).load().filter(F.col("app_id") == app)
