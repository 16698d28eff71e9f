"""Inventory layouts derived from the driver tables (TPC-H-like star schema).

The driver tables carry no medical vocabulary, so the inventory columns are
derived deterministically from their keys.  Both a DataFrame form and the same
definition in portable SQL (for the DuckDB oracle) are given.

* ``lineitem_inventory``: lineitem joined to part and supplier; one row per
  lineitem.  ``ITEM_NO`` is not unique here.
* ``part_inventory``: part alone, ``p_partkey`` is the unique key and the
  row order (``_row`` = position in ``p_partkey`` order).
* ``document_inventory``: documents as inventory rows (``DESCRIPTION`` = whole
  text, ``VENDOR_NAME`` = source) -- the large-text input for the matchers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_str

# ---------------------------------------------------------------------------
# FIXED VALUES of the derived view (the expected counts depend on them)
# ---------------------------------------------------------------------------
PHRASES = [
    "exam table", "nitrile glove", "face mask", "bleach wipe", "rapid test kit",
    "patient monitor", "syringe pump", "expired catheter", "autoclave", "x-ray film",
    "aspirin tablet", "label printer", "stopper, rubber", "bandage dressing",
    "advanced widget", "spare bracket", "oxygen concentrator", "foam cushion",
]
SUBCATEGORIES = [None, "", "Furniture cart", "Lab goods", "Misc"]
NULL_EVERY = 97
EMPTY_EVERY = 89
# ---------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _phrase(n: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHRASES]), F.pmod(n, F.lit(len(PHRASES))).cast("int"))


def _subcategory(n: Column) -> Column:
    arr = F.array(*[F.lit(s).cast("string") for s in SUBCATEGORIES])
    return F.get(arr, F.pmod(n, F.lit(len(SUBCATEGORIES))).cast("int"))


def _description(name: Column, n: Column) -> Column:
    return (
        F.when(F.pmod(n, F.lit(NULL_EVERY)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(n, F.lit(EMPTY_EVERY)) == 0, F.lit(""))
        .otherwise(F.concat(F.upper(name), F.lit(" "), _phrase(n)))
    )


def lineitem_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # plain equi-joins: the planner broadcasts a side only when its statistics
    # are under spark.sql.autoBroadcastJoinThreshold, else shuffles both.
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    n = (
        F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + F.col("l_linenumber") + F.col("l_orderkey")
    )
    return j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias(
            "ITEM_NO"
        ),
        _description(F.col("p_name"), n).alias("DESCRIPTION"),
        F.col("s_name").alias("VENDOR_NAME"),
        F.col("p_type").alias("CATEGORY"),
        _subcategory(n).alias("SUBCATEGORY"),
        F.col("l_quantity").cast("double").alias("AVAILABILITY_QTY"),
        F.col("p_retailprice").cast("double").alias("COST"),
        F.col("l_extendedprice").cast("double").alias("EXT_COST"),
    )


def part_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique-key layout; ``KEY`` (= p_partkey) orders the rows."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    n = F.col("p_partkey")
    return part.select(
        F.col("p_partkey").alias("KEY"),
        F.col("p_partkey").cast("string").alias("ITEM_NO"),
        _description(F.col("p_name"), n).alias("DESCRIPTION"),
        F.col("p_brand").alias("VENDOR_NAME"),
        F.col("p_type").alias("CATEGORY"),
        _subcategory(n).alias("SUBCATEGORY"),
        F.col("p_retailprice").cast("double").alias("COST"),
    )


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return docs.select(
        F.col("doc_id").alias("KEY"),
        F.col("doc_id").cast("string").alias("ITEM_NO"),
        F.col("text").alias("DESCRIPTION"),
        F.col("source").alias("VENDOR_NAME"),
        F.col("lang").alias("CATEGORY"),
    )


# --- SQL twins (DuckDB; lists are 1-based there) -----------------------------------

def _sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


def _description_sql(name: str, n: str) -> str:
    return (
        f"CASE WHEN {n} % {NULL_EVERY} = 0 THEN NULL WHEN {n} % {EMPTY_EVERY} = 0 THEN '' "
        f"ELSE upper({name}) || ' ' || ({_sql_list(PHRASES)})[{n} % {len(PHRASES)} + 1] END"
    )


def _subcategory_sql(n: str) -> str:
    return f"({_sql_list(SUBCATEGORIES)})[{n} % {len(SUBCATEGORIES)} + 1]"


LINEITEM_INVENTORY_SQL = f"""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ITEM_NO,
       {_description_sql('p_name', 'n')} AS DESCRIPTION,
       s_name AS VENDOR_NAME,
       p_type AS CATEGORY,
       {_subcategory_sql('n')} AS SUBCATEGORY,
       CAST(l_quantity AS DOUBLE) AS AVAILABILITY_QTY,
       CAST(p_retailprice AS DOUBLE) AS COST,
       CAST(l_extendedprice AS DOUBLE) AS EXT_COST
FROM (SELECT l.*, p.p_name, p.p_type, p.p_retailprice, s.s_name,
             l_partkey * 13 + l_suppkey * 7 + l_linenumber + l_orderkey AS n
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                      JOIN supplier s ON l.l_suppkey = s.s_suppkey) b
"""

PART_INVENTORY_SQL = f"""
SELECT p_partkey AS KEY,
       CAST(p_partkey AS VARCHAR) AS ITEM_NO,
       {_description_sql('p_name', 'p_partkey')} AS DESCRIPTION,
       p_brand AS VENDOR_NAME,
       p_type AS CATEGORY,
       {_subcategory_sql('p_partkey')} AS SUBCATEGORY,
       CAST(p_retailprice AS DOUBLE) AS COST
FROM part
"""

DOCUMENT_INVENTORY_SQL = """
SELECT doc_id AS KEY, CAST(doc_id AS VARCHAR) AS ITEM_NO, text AS DESCRIPTION,
       source AS VENDOR_NAME, lang AS CATEGORY
FROM documents
"""
