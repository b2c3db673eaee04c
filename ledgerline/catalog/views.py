"""Statement, label and prediction views over the given tables.

Each view exists twice: as a DataFrame for the jobs and as SQL text for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scores import sigmoid
from ledgerline.roles import Roles

ROLES = Roles(tie="seq", day_grain=True, tie_bits=42, categoricals=("B_30", "D_63", "D_64"))
NUMERIC = ["P_2", "D_39", "B_1", "R_1", "S_3"]
CATEGORICAL = ["B_30", "D_63", "D_64"]
SPLIT = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements_from(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One statement per order, with its line items summed up."""
    lines = lineitem.groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_discount") * 100)).alias("disc"),
        F.sum("l_quantity").alias("qty"),
        F.max(F.round(F.col("l_tax") * 100)).alias("tax"),
        F.sum(F.floor("l_extendedprice").cast("double")).alias("ext"),
        F.max("l_linenumber").alias("maxline"),
    )
    o = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    code = F.when(F.col("maxline") <= 2, 0).when(F.col("maxline") <= 4, 1).when(F.col("maxline") > 4, 2)
    return o.select(
        F.col("o_custkey").cast("string").alias("customer_ID"),
        F.col("o_orderdate").alias("S_2"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("double")).alias("P_2"),
        F.when(F.col("o_orderstatus") != "P", F.col("disc").cast("double")).alias("D_39"),
        F.col("qty").cast("double").alias("B_1"),
        F.col("tax").cast("double").alias("R_1"),
        F.col("ext").cast("double").alias("S_3"),
        code.cast("float").alias("B_30"),
        F.substring("o_orderpriority", 1, 1).alias("D_63"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderstatus")).alias("D_64"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def train_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).where(F.col("S_2") < F.to_timestamp_ntz(F.lit(SPLIT)))


def test_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).where(F.col("S_2") >= F.to_timestamp_ntz(F.lit(SPLIT)))


def stmt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels exist for every market segment but one."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_ID"),
        F.when(F.col("c_acctbal") < 1500, 1).otherwise(0).cast("int").alias("target"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stand-ins for model outputs; ``p_b`` has many ties."""
    s = statements(spark, sf_dir).groupBy("customer_ID").agg(
        F.avg("P_2").alias("mp"), F.count("S_2").alias("n"), F.avg("S_3").alias("ms")
    )
    j = s.join(stmt_labels(spark, sf_dir), "customer_ID")
    t = F.col("target")
    shift = {
        "p_a": 2.0 * t + (F.coalesce("mp", F.lit(250000.0)) - 250000.0) / 40000.0 - 1.0,
        "p_b": 1.5 * t + (F.col("n") - 10.0) / 3.0 - 1.0,
        "p_c": 1.0 * t + (F.coalesce("ms", F.lit(200000.0)) - 200000.0) / 50000.0 - 1.0,
    }
    return j.select(
        "customer_ID", "target", *[F.round(sigmoid(z), 9).alias(n) for n, z in shift.items()]
    )


WIDE_NUMERIC = [f"N_{i}" for i in range(177)]
WIDE_CATEGORICAL = [f"C_{i}" for i in range(11)]
WIDE_ROLES = Roles(tie="seq", day_grain=True, tie_bits=42, categoricals=tuple(WIDE_CATEGORICAL))


def _wide_columns() -> list[str]:
    """177 numeric and 11 categorical columns from the narrow ones, with gaps; the same text in both engines."""
    out = [f"CASE WHEN (seq + {i}) % 7 <> 0 THEN {NUMERIC[i % 5]} + {3 * i} END AS {c}" for i, c in enumerate(WIDE_NUMERIC)]
    return out + [f"CASE WHEN (seq + {i}) % 5 <> 0 THEN CAST((seq + {i}) % {i + 2} AS STRING) END AS {c}" for i, c in enumerate(WIDE_CATEGORICAL)]


def wide_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements at the full width of a card portfolio, a customer's rows together as in such tables.

    The narrow rows are moved, before they are widened.
    """
    narrow = statements(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "customer_ID")
    return narrow.selectExpr("customer_ID", "S_2", "seq", *_wide_columns())


# --- the same in SQL -------------------------------------------------------------

STATEMENTS_SQL = """
statements AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS customer_ID, o.o_orderdate AS S_2, o.o_orderkey AS seq,
    CASE WHEN o.o_orderpriority <> '5-LOW' THEN CAST(FLOOR(o.o_totalprice) AS DOUBLE) END AS P_2,
    CASE WHEN o.o_orderstatus <> 'P' THEN l.disc END AS D_39,
    l.qty AS B_1, l.tax AS R_1, l.ext AS S_3,
    CAST(CASE WHEN l.maxline <= 2 THEN 0 WHEN l.maxline <= 4 THEN 1 WHEN l.maxline > 4 THEN 2 END AS FLOAT) AS B_30,
    SUBSTR(o.o_orderpriority, 1, 1) AS D_63,
    CASE WHEN o.o_orderpriority <> '2-HIGH' THEN o.o_orderstatus END AS D_64
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, CAST(SUM(ROUND(l_discount * 100)) AS DOUBLE) AS disc, SUM(l_quantity) AS qty,
      CAST(MAX(ROUND(l_tax * 100)) AS DOUBLE) AS tax,
      CAST(SUM(FLOOR(l_extendedprice)) AS DOUBLE) AS ext, MAX(l_linenumber) AS maxline
    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey)"""

LABELS_SQL = """
stmt_labels AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_ID,
    CAST(CASE WHEN c_acctbal < 1500 THEN 1 ELSE 0 END AS INT) AS target
  FROM customer WHERE c_mktsegment <> 'MACHINERY')"""

PREDICTIONS_SQL = f"""{STATEMENTS_SQL},{LABELS_SQL},
predictions AS (
  SELECT s.customer_ID, target,
    ROUND(1e0 / (1e0 + EXP(-(2e0 * target + (COALESCE(mp, 250000e0) - 250000e0) / 40000e0 - 1e0))), 9) AS p_a,
    ROUND(1e0 / (1e0 + EXP(-(15e-1 * target + (n - 10e0) / 3e0 - 1e0))), 9) AS p_b,
    ROUND(1e0 / (1e0 + EXP(-(1e0 * target + (COALESCE(ms, 200000e0) - 200000e0) / 50000e0 - 1e0))), 9) AS p_c
  FROM (SELECT customer_ID, AVG(P_2) AS mp, COUNT(S_2) AS n, AVG(S_3) AS ms FROM statements GROUP BY customer_ID) s
  JOIN stmt_labels USING (customer_ID))"""


def wide_sql() -> str:
    columns = ", ".join(_wide_columns()).replace("AS STRING", "AS VARCHAR")
    return f"{STATEMENTS_SQL}, wide AS (SELECT customer_ID, S_2, seq, {columns} FROM statements)"


def features_sql(source: str, name: str = "features", numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL) -> str:
    """CTE with every feature of a statement CTE, categorical last values raw."""
    num = []
    for c in numeric:
        present = f"FILTER (WHERE {c} IS NOT NULL)"
        num += [
            f"AVG({c}) AS {c}_mean", f"ROUND(STDDEV_SAMP({c}), 4) AS {c}_std", f"MIN({c}) AS {c}_min",
            f"MAX({c}) AS {c}_max", f"ARG_MIN({c}, ord) {present} AS {c}_first",
            f"ARG_MAX({c}, ord) {present} AS {c}_last",
        ]
    cat = []
    for c in categorical:
        cat += [
            f"ARG_MAX({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}_last",
            f"COUNT(DISTINCT {c}) AS {c}_nunique", f"COUNT({c}) AS {c}_count",
        ]
    trend = []
    for c in numeric:
        trend += [
            f"{c}_last - {c}_mean AS {c}_last_mean_diff", f"{c}_last - {c}_first AS {c}_last_first_diff",
            f"{c}_max - {c}_min AS {c}_range",
        ]
    return f"""
{name} AS (
  SELECT *, {', '.join(trend)} FROM (
    SELECT customer_ID, {', '.join(num + cat)}, COUNT(S_2) AS statement_count,
      CAST(DATE_DIFF('day', MIN(S_2), MAX(S_2)) AS BIGINT) AS history_days
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY S_2, seq) AS ord FROM {source})
    GROUP BY customer_ID))"""


TRAIN_TEST_SQL = f"""{STATEMENTS_SQL},
train AS (SELECT * FROM statements WHERE S_2 < TIMESTAMP '{SPLIT}'),
test AS (SELECT * FROM statements WHERE S_2 >= TIMESTAMP '{SPLIT}')"""
