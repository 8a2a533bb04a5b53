"""Row policies: which rows of a table a user may see and write, in one registry that every read goes through.

A table's policy is that its rows are owned (a column holds the user), that they belong to rows of another table that has
a policy itself, or that all may read it. Tables without a policy are not there. install() makes a view for each table
whose predicate is on the session variable `row_user`; a view is read anew for each query, so as_user() changes what
all of them show, and a query that was made for one user stays that user's. Without a user no owned row is seen."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER = "row_user"
RAW = "_unpoliced_"


@dataclass(frozen=True)
class Policy:
    column: str | None = None
    parent: str | None = None
    parent_key: str | None = None


class Policies:
    def __init__(self) -> None:
        self.rules: dict[str, Policy] = {}

    def owned(self, table: str, column: str = "user_id") -> Policies:
        self.rules[table] = Policy(column)
        return self

    def through(self, table: str, column: str, parent: str, parent_key: str = "id") -> Policies:
        """Rows belong to whoever the row of `parent` with that key belongs to."""
        if parent not in self.rules:
            raise ValueError(f"{parent} has no policy")
        self.rules[table] = Policy(column, parent, parent_key)
        return self

    def open(self, table: str) -> Policies:
        """All may read it; no user writes it."""
        self.rules[table] = Policy()
        return self

    def view(self, table: str) -> str:
        """The SQL of a table's view."""
        p, raw = self.rules[table], f"`{RAW}{table}`"
        if p.column is None:
            return f"SELECT * FROM {raw}"
        if p.parent is None:
            return f"SELECT * FROM {raw} WHERE CAST(`{p.column}` AS STRING) = session.{USER}"
        return f"SELECT * FROM {raw} WHERE `{p.column}` IN (SELECT `{p.parent_key}` FROM `{p.parent}`)"

    def install(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        """Makes the views of all tables that have a policy."""
        spark.sql(f"DECLARE OR REPLACE VARIABLE {USER} STRING DEFAULT NULL")
        for table in self.rules:
            tables[table].createOrReplaceTempView(f"{RAW}{table}")
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{table}` AS {self.view(table)}")

    def refused(self, spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
        """The rows that the user may not write."""
        p = self.rules[table]
        if p.column is None:
            return rows
        if p.parent is None:
            return rows.filter(F.coalesce(F.col(p.column).cast("string") != F.expr(f"session.{USER}"), F.lit(True)))
        known = spark.table(p.parent).select(F.col(p.parent_key).alias(p.column))
        return rows.join(known, p.column, "left_anti")


@contextmanager
def as_user(spark: SparkSession, user: object) -> Iterator[None]:
    """Queries that are made within are those of `user`."""
    before = spark.sql(f"SELECT session.{USER}").first()[0]
    put = lambda v: spark.sql(f"SET VARIABLE {USER} = :v", args={"v": v})
    put(None if user is None else str(user))
    try:
        yield
    finally:
        put(before)
