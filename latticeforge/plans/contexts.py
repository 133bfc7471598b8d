"""The contexts that the registered queries work on, as SQL over the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.context import Context
from ..operators.scaling import encode


@dataclass(frozen=True)
class Source:
    """A table expression with text columns: row_id, attributes, labels.

    `duck` is the same SELECT for DuckDB where its functions differ.
    """

    tables: tuple[str, ...]
    attributes: tuple[str, ...]
    labels: tuple[str, ...]
    spark: str
    duck: str = ""

    @property
    def duck_sql(self) -> str:
        return self.duck or self.spark.replace("AS STRING", "AS VARCHAR")

    def table(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.spark
        for t in self.tables:
            sql = sql.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
        return spark.sql(sql)

    def context(self, spark: SparkSession, sf_dir: str) -> Context:
        return encode(self.table(spark, sf_dir), list(self.labels), attribute_columns=list(self.attributes))


CUSTOMER = Source(
    ("customer",), ("a0", "a1"), ("l0",),
    "SELECT c_custkey AS row_id, concat('n', CAST(c_nationkey AS STRING)) AS a0, c_mktsegment AS a1, CASE WHEN c_acctbal >= 0 THEN 'credit' ELSE 'debit' END AS l0 FROM {customer}",
)
EVENTS = Source(
    ("events",), ("a0", "a1", "a2", "a3"), ("l0",),
    "SELECT event_id AS row_id, event_type AS a0, CAST(hour(ts) div 6 AS STRING) AS a1, CAST(dayofweek(ts) - 1 AS STRING) AS a2, CAST(user_id % 7 AS STRING) AS a3, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS l0 FROM {events}",
    "SELECT event_id AS row_id, event_type AS a0, CAST(hour(ts) // 6 AS VARCHAR) AS a1, CAST(dayofweek(ts) AS VARCHAR) AS a2, CAST(user_id % 7 AS VARCHAR) AS a3, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS l0 FROM {events}",
)
LINEITEM = Source(
    ("lineitem",), ("a0", "a1", "a2", "a3"), ("l0",),
    "SELECT l_orderkey * 100 + l_linenumber AS row_id, l_returnflag AS a0, CAST(l_linenumber AS STRING) AS a1, concat('d', CAST(CAST(round(l_discount * 100) AS INT) AS STRING)) AS a2, CAST(CAST(round(l_tax * 100) AS INT) AS STRING) AS a3, l_linestatus AS l0 FROM {lineitem}",
)
PART = Source(
    ("part",), ("a0", "a1", "a2"), ("l0",),
    "SELECT p_partkey AS row_id, p_brand AS a0, p_type AS a1, CAST(p_size div 10 AS STRING) AS a2, CASE WHEN p_retailprice >= 950 THEN 'dear' ELSE 'cheap' END AS l0 FROM {part}",
    "SELECT p_partkey AS row_id, p_brand AS a0, p_type AS a1, CAST(p_size // 10 AS VARCHAR) AS a2, CASE WHEN p_retailprice >= 950 THEN 'dear' ELSE 'cheap' END AS l0 FROM {part}",
)
ORDERS = Source(
    ("orders",), ("a0", "a1", "a2"), ("l0",),
    "SELECT o_orderkey AS row_id, o_orderpriority AS a0, concat('m', CAST(month(o_orderdate) AS STRING)) AS a1, CAST(o_custkey % 5 AS STRING) AS a2, o_orderstatus AS l0 FROM {orders}",
)
GRADED = Source(
    ("documents", "labels"), ("a0", "a1", "a2"), ("l0", "l1"),
    "SELECT d.doc_id AS row_id, lang AS a0, source AS a1, CAST(least(n_chars div 500, 5) AS STRING) AS a2, CAST(quality AS STRING) AS l0, CAST(toxic AS STRING) AS l1 FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    "SELECT d.doc_id AS row_id, lang AS a0, source AS a1, CAST(least(n_chars // 500, 5) AS VARCHAR) AS a2, CAST(quality AS VARCHAR) AS l0, CAST(toxic AS VARCHAR) AS l1 FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
)
#: A label with as many values as there are customers.
BUYERS = Source(
    ("orders",), ("a0", "a1"), ("l0",),
    "SELECT o_orderkey AS row_id, o_orderpriority AS a0, concat('m', CAST(month(o_orderdate) AS STRING)) AS a1, CAST(o_custkey AS STRING) AS l0 FROM {orders}",
)
#: Two numeric columns, which are cut into intervals.
PRICES = Source(
    ("lineitem",), ("a0", "a1"), ("l0",),
    "SELECT l_orderkey * 100 + l_linenumber AS row_id, CAST(l_quantity AS STRING) AS a0, CAST(l_extendedprice AS STRING) AS a1, l_returnflag AS l0 FROM {lineitem}",
)
