"""Registry of the page-pipeline queries: each has a DataFrame plan and, where SQL can say it, a SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.views import JOB_ID, PAGE_BLOCK, PAGE_NUMBER, SPARK_BLOCKS, SPARK_PAGES, VIEWS, spark_sql, twin_sql

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Lines of which one task makes pages; the number of tasks follows from it, not the memory of one.
LINES_A_TASK = 250_000


class Tables:
    """The driver's tables as ``t.<name>`` and the views over them as ``t.<view>``; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name == "v_pages":
                self._known[name] = self.spark.sql(SPARK_PAGES, lines=self._lines(PAGE_NUMBER))
            elif name in VIEWS:
                sql, needs = spark_sql(name)
                self._known[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name.removeprefix('base_')}.parquet")
        return self._known[name]

    @cached_property
    def page_parts(self) -> int:
        """Parts in which lines meet by page or block, and blocks by job: as many as the number of lines asks for."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // LINES_A_TASK))

    @cached_property
    def page_blocks(self) -> DataFrame:
        """``v_pages`` with ``page_block``, laid out by job and block instead of by page; for what is counted by job."""
        return self.spark.sql(SPARK_BLOCKS, lines=self._lines(PAGE_BLOCK))

    def _lines(self, by: str) -> DataFrame:
        """Lines laid out by the job and the page or block that they belong to."""
        return self.lineitem.repartition(self.page_parts, F.expr(JOB_ID), F.expr(by))


def query(sql: str | None = None):
    """Register ``plan(tables)`` under its name; ``sql`` may name the views."""

    def put(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[plan.__name__] = with_views(sql)
        return plan

    return put


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the views that it names, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(twin_sql(name))
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({twin_sql(n)})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"
