"""Registration of a query together with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import bindings
from cardwatch.bindings import SCORED_VERSION_ORDER
from cardwatch.schemas import TS
from cardwatch.session import configure

DIGITS = 6
# Means of amounts in cents often end in an exact half at the last digit; this
# shift, far above the noise of summation order, makes both sides round it up.
SHIFT = 3e-9

EVALUATED_BY = {"newest": SCORED_VERSION_ORDER, "within": ("order_id",)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The bound inputs of one data folder."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return bindings.table(self.spark, self.folder, name)

    @property
    def tx(self) -> DataFrame:
        return bindings.transactions(self.spark, self.folder)

    @property
    def pred(self) -> DataFrame:
        return bindings.predictions(self.spark, self.folder)

    @property
    def by_order(self) -> DataFrame:
        return bindings.predictions(self.spark, self.folder, by_order=True)

    @property
    def scored(self) -> DataFrame:
        """Transactions scored by amount: many distinct scores."""
        return self.tx.withColumns({"risk_score": F.col("amt") / 500, "prediction": F.col("amt") >= 150})

    @property
    def truth(self) -> DataFrame:
        """Ground truth of the bound predictions: the newest version's return flag."""
        from cardwatch.operators.versions import latest_predictions

        newest = latest_predictions(self.by_order, **EVALUATED_BY)
        return newest.select("trans_num", F.when(F.col("return_flag") == "R", 1).otherwise(0).alias("is_fraud"))

    @property
    def evaluated(self) -> DataFrame:
        """Truth and newest prediction: eleven distinct scores, hence many ties."""
        from cardwatch.operators.evaluate import evaluation_frame

        return evaluation_frame(self.truth, self.by_order, **EVALUATED_BY)

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").withColumn("is_minority", (F.col("label") == 0).cast("int"))

    @property
    def placed(self) -> DataFrame:
        """Transactions with positions derived from their keys."""
        k = F.regexp_extract("trans_num", "([0-9]+)", 1).cast("long")
        return self.tx.withColumns(
            {
                "lat": (F.col("cc_num") % 50 - 25).cast("double"),
                "long": (F.col("cc_num") % 90 - 45).cast("double"),
                "merch_lat": (F.col("cc_num") % 50 - 25) + (k % 13) * 0.25,
                "merch_long": (F.col("cc_num") % 90 - 45) + (k % 7) * 0.25,
                "zip": (F.col("cc_num") % 997).cast("int"),
                "city_pop": (F.col("cc_num") % 77 * 100).cast("int"),
            }
        )


def digits(columns: str) -> dict[str, int]:
    """``"a b:2"`` -> {"a": 6, "b": 2}."""
    parts = [c.split(":") for c in columns.split()]
    return {p[0]: int(p[1]) if len(p) > 1 else DIGITS for p in parts}


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(SHIFT), d) + F.lit(0.0) for c, d in columns.items()})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Decimals as doubles, so that both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, r: str = "") -> None:
    """Register a query; ``r`` names the floating columns rounded on both sides."""
    columns = digits(r)

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(run(Tables(configure(spark), folder)), columns)

    QUERIES[name] = query
    if sql is not None:
        if columns:
            swaps = ", ".join(f'round("{c}" + {SHIFT}::DOUBLE, {d}) + 0.0::DOUBLE AS "{c}"' for c, d in columns.items())
            sql = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS checked"
        ORACLE[name] = sql


# --- SQL views of the bindings -----------------------------------------------------

TX = f"""(SELECT CAST(event_id AS VARCHAR(20)) AS trans_num, user_id AS cc_num, ts AS {TS},
 value AS amt, event_type AS category, concat('m_', CAST(k % 20 AS VARCHAR(4))) AS merchant,
 concat('c_', CAST(k % 7 AS VARCHAR(4))) AS city, concat('s_', CAST(k % 3 AS VARCHAR(4))) AS state,
 CASE WHEN value >= 150 AND k % 3 = 0 THEN 1 ELSE 0 END AS is_fraud
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e)"""

PRED = f"""(SELECT concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(4))) AS trans_num,
 l.l_shipdate AS created_at, l.l_partkey AS id1, l.l_suppkey AS id2, l.l_extendedprice AS id3,
 o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS {TS},
 o.o_custkey AS cc_num, s.s_name AS merchant, o.o_orderpriority AS category, l.l_extendedprice AS amt,
 n.n_name AS city, r.r_name AS state, CAST(l.l_discount * 10 AS DECIMAL(12,6)) AS risk_score,
 CAST(l.l_discount * 10 AS DECIMAL(12,6)) >= 0.8 AS prediction, l.l_returnflag AS return_flag
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
 JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
 JOIN region r ON r.r_regionkey = n.n_regionkey)"""

LATEST = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trans_num
 ORDER BY created_at DESC, id1 DESC, id2 DESC, id3 DESC) AS rn FROM {PRED} p) v WHERE rn = 1)"""

SCORED = f"(SELECT *, amt / 500 AS risk_score, amt >= 150 AS prediction FROM {TX} t)"

EVALUATED = f"""(SELECT trans_num, CASE WHEN return_flag = 'R' THEN 1 ELSE 0 END AS is_fraud, prediction,
 risk_score, created_at FROM {LATEST} lp)"""

PLACED = f"""(SELECT *, CAST(cc_num % 50 - 25 AS DOUBLE) AS lat, CAST(cc_num % 90 - 45 AS DOUBLE) AS long,
 (cc_num % 50 - 25) + (CAST(trans_num AS BIGINT) % 13) * 0.25::DOUBLE AS merch_lat,
 (cc_num % 90 - 45) + (CAST(trans_num AS BIGINT) % 7) * 0.25::DOUBLE AS merch_long,
 CAST(cc_num % 997 AS INTEGER) AS zip, CAST(cc_num % 77 * 100 AS INTEGER) AS city_pop FROM {TX} t)"""


def shuffled_sql(seed: int) -> str:
    """Every transaction with its place in the seeded order of its class, and the size of the class."""
    return f"""(SELECT trans_num, is_fraud, count(*) OVER (PARTITION BY is_fraud) AS n, count(*) OVER () AS total,
 row_number() OVER (PARTITION BY is_fraud ORDER BY sha256(trans_num || '|{seed}'), trans_num) - 1 AS pos FROM {TX} t)"""


def sample_sql(n: int, seed: int) -> str:
    """The stratified sample of n rows: frauds keep their share, rounded down."""
    return f"""SELECT trans_num, is_fraud FROM {shuffled_sql(seed)} x WHERE total <= {n} OR pos < CASE is_fraud WHEN 1 THEN {n} * n // total
 ELSE {n} - {n} * (total - n) // total END"""
