"""Deterministic molecule, label and weight tables derived from the supplied test tables.

Each table exists twice: as DataFrame code, used by the registered queries, and as SQL text,
used by the independent SQL checks. Integer arithmetic only, so both agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(c) -> F.Column:
    return F.concat(F.lit("c"), c.cast("string"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = lambda *names: F.concat_ws("-", *[F.col(n).cast("string") for n in names])
    part, line, supp, order, cust = (F.col(c) for c in (
        "l_partkey", "l_linenumber", "l_suppkey", "l_orderkey", "o_custkey"))
    lost_before = (part + line) % 8 == 0
    lost_after = (part + line) % 16 == 0
    fragment = supp % 11 == 0
    return l.join(o, order == F.col("o_orderkey")).select(
        key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transcript_id"),
        ((cust * 37) % 1000 + (part * 13 + line * 5) % 9).cast("double").alias("x"),
        ((cust * 91) % 1000 + (supp * 7 + order * 3) % 9).cast("double").alias("y"),
        line.cast("double").alias("z"),
        F.concat(F.lit("GENE"), F.lpad(((part * (cust % 5 + 1)) % 60).cast("string"), 3, "0"))
        .alias("feature_name"),
        F.when(lost_before, "UNASSIGNED").otherwise(_entity(cust)).alias("original_cell_id"),
        F.when(lost_after, "UNASSIGNED")
        .when(fragment, F.concat(_entity(cust), F.lit("-1")))
        .otherwise(_entity(cust)).alias("cell_id"),
        F.when(lost_after, "unknown").when(fragment, "partial").otherwise("cell").alias("etype"),
        F.col("l_quantity").alias("qv"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("overlaps_nucleus"),
        F.when(F.col("l_returnflag") == "A", "method_a")
        .when(F.col("l_returnflag") == "R", "method_b").otherwise("method_c").alias("method"))


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _entity(F.col("c_custkey")).alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"),
        F.when(F.col("c_custkey") % 2 == 0, "query").otherwise("reference").alias("side"),
        F.col("c_nationkey").cast("string").alias("donor"))


def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cell_type, weight): shares of the status classes among an entity's molecules."""
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(_entity(F.col("o_custkey")).alias("cell_id"),
                     F.concat("l_returnflag", "l_linestatus").alias("cell_type"))
            .agg(F.sum(F.col("l_quantity") - 3).alias("weight")))


MOLECULES_SQL = """
SELECT
  concat(CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR), '-',
         CAST(l.l_partkey AS VARCHAR), '-', CAST(l.l_suppkey AS VARCHAR)) AS transcript_id,
  CAST((o.o_custkey * 37) % 1000 + (l.l_partkey * 13 + l.l_linenumber * 5) % 9 AS DOUBLE) AS x,
  CAST((o.o_custkey * 91) % 1000 + (l.l_suppkey * 7 + l.l_orderkey * 3) % 9 AS DOUBLE) AS y,
  CAST(l.l_linenumber AS DOUBLE) AS z,
  concat('GENE', lpad(CAST((l.l_partkey * (1 + o.o_custkey % 5)) % 60 AS VARCHAR), 3, '0')) AS feature_name,
  CASE WHEN (l.l_partkey + l.l_linenumber) % 8 = 0 THEN 'UNASSIGNED'
       ELSE concat('c', CAST(o.o_custkey AS VARCHAR)) END AS original_cell_id,
  CASE WHEN (l.l_partkey + l.l_linenumber) % 16 = 0 THEN 'UNASSIGNED'
       WHEN l.l_suppkey % 11 = 0 THEN concat('c', CAST(o.o_custkey AS VARCHAR), '-1')
       ELSE concat('c', CAST(o.o_custkey AS VARCHAR)) END AS cell_id,
  CASE WHEN (l.l_partkey + l.l_linenumber) % 16 = 0 THEN 'unknown'
       WHEN l.l_suppkey % 11 = 0 THEN 'partial' ELSE 'cell' END AS etype,
  l.l_quantity AS qv,
  CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS overlaps_nucleus,
  CASE l.l_returnflag WHEN 'A' THEN 'method_a' WHEN 'R' THEN 'method_b' ELSE 'method_c' END AS method
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

CELL_LABELS_SQL = """
SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS cell_id, c_mktsegment AS cell_type,
       CASE WHEN c_custkey % 2 = 0 THEN 'query' ELSE 'reference' END AS side,
       CAST(c_nationkey AS VARCHAR) AS donor
FROM customer
"""

WEIGHTS_SQL = """
SELECT concat('c', CAST(o.o_custkey AS VARCHAR)) AS cell_id,
       concat(l.l_returnflag, l.l_linestatus) AS cell_type, sum(l.l_quantity - 3) AS weight
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2
"""

# Shared building blocks of the SQL checks; each check names the ones it needs.
SQL_PARTS = {
    "molecules": MOLECULES_SQL,
    "cell_labels": CELL_LABELS_SQL,
    "weights": WEIGHTS_SQL,
    "assigned": "SELECT * FROM molecules WHERE cell_id <> 'UNASSIGNED'",
    "orig": "SELECT * FROM molecules WHERE original_cell_id <> 'UNASSIGNED'",
    "cg": ("SELECT cell_id, feature_name, count(*) AS count FROM molecules "
           "WHERE cell_id <> 'UNASSIGNED' GROUP BY 1, 2"),
    "og": ("SELECT original_cell_id AS cell_id, feature_name, count(*) AS count FROM molecules "
           "WHERE original_cell_id <> 'UNASSIGNED' GROUP BY 1, 2"),
}
SQL_NEEDS = {"assigned": ["molecules"], "orig": ["molecules"], "cg": ["molecules"],
             "og": ["molecules"]}


def with_parts(sql: str, needs: str = "molecules", **extra: str) -> str:
    """Prefix a check with the common table expressions it names, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in SQL_NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS ({SQL_PARTS[n].strip()})" for n in order]
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    body = sql.strip()
    if not parts:
        return body
    # A check that opens with a comma continues the list of table expressions.
    joint = "" if body.startswith(",") else "\n"
    return "WITH " + ",\n".join(parts) + joint + body
