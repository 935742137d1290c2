"""Derived tables: the clean test tables with the mess that real exports have, once as a
Spark frame and once as SQL, and queries that read and write tables."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltascope import export_csv, preview, scan, write_snapshot
from deltascope.catalog import query, rounded, table
from deltascope.sources.materialize import shared_folder


def messy_orders(spark, folder) -> DataFrame:
    """Orders as an export: spelling variants, text that means null, amounts and dates as
    text, an empty column, and some rows twice."""
    orders = table(spark, folder, "orders")
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    spelled = (
        F.when(key % 10 == 0, F.lower(F.concat(F.lit(" "), priority, F.lit(" "))))
        .when(key % 10 == 1, F.lower(priority))
        .when(key % 50 == 7, F.lit("N/A"))
        .when(key % 50 == 13, F.lit(None).cast("string"))
        .when(key % 50 == 23, F.lit("-"))
        .otherwise(priority)
    )
    amount = F.format_number("o_totalprice", 2)
    price = (
        F.when(key % 40 == 3, F.concat(F.lit("("), amount, F.lit(")")))
        .when(key % 40 == 5, F.lit("pending"))
        .otherwise(F.concat(F.lit("$"), amount))
    )
    day = F.when(key % 60 == 9, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    flag = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).when(F.col("o_orderstatus") == "F", F.lit(" YES")).otherwise(F.lit("No"))
    messy = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus",
        spelled.alias("priority"), price.alias("price"), day.alias("day"), flag.alias("finished"),
        F.lit(None).cast("string").alias("Unnamed: 9"),
    )
    return messy.unionByName(messy.filter(F.col("o_orderkey") % 50 == 0))


MESSY = """messy_once AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus,
    CASE WHEN o_orderkey % 10 = 0 THEN lower(' ' || o_orderpriority || ' ')
         WHEN o_orderkey % 10 = 1 THEN lower(o_orderpriority)
         WHEN o_orderkey % 50 = 7 THEN 'N/A'
         WHEN o_orderkey % 50 = 13 THEN NULL
         WHEN o_orderkey % 50 = 23 THEN '-'
         ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 40 = 3 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
         WHEN o_orderkey % 40 = 5 THEN 'pending'
         ELSE '$' || format('{:,.2f}', o_totalprice) END AS price,
    CASE WHEN o_orderkey % 60 = 9 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS day,
    CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN ' YES' ELSE 'No' END AS finished,
    CAST(NULL AS VARCHAR) AS "Unnamed: 9"
  FROM orders),
messy AS (SELECT * FROM messy_once UNION ALL SELECT * FROM messy_once WHERE o_orderkey % 50 = 0)"""

# amounts and dates of the messy table parsed
PARSED = MESSY + """,
parsed AS (
  SELECT *,
    CASE WHEN price LIKE '(%' THEN -TRY_CAST(regexp_replace(price, '[$,()]', '', 'g') AS DOUBLE)
         ELSE TRY_CAST(regexp_replace(price, '[$,()]', '', 'g') AS DOUBLE) END AS amount,
    try_strptime(day, '%m/%d/%Y') AS parsed_day
  FROM messy)"""


def _scratch(spark, label: str, suffix: str) -> str:
    return f"{shared_folder(spark)}/deltascope-{label}-{uuid.uuid4().hex}{suffix}"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_table(spark, folder):
    return scan(spark, f"{folder}/customer.parquet")


@query(f"""WITH {MESSY}
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
  CASE WHEN priority IN ('N/A') THEN NULL ELSE priority END AS priority, price, day, finished FROM messy""")
def csv_round_trip(spark, folder):
    """Written as CSV and read back: types inferred, `N/A` read as null."""
    path = _scratch(spark, "export", ".csv")
    messy = messy_orders(spark, folder).drop("o_orderdate")
    export_csv(messy, path)
    return scan(spark, path).drop("Unnamed: 9")


@query("""SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", ' || c_nationkey || chr(10) || chr(10) AS note,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || chr(10) ELSE c_mktsegment END AS segment, c_acctbal FROM customer""")
def csv_quoted_breaks(spark, folder):
    """Line breaks, quotes and delimiters inside quoted fields; the files are split all the same."""
    path, segment = _scratch(spark, "quoted", ".csv"), F.col("c_mktsegment")
    note = F.concat("c_name", F.lit('\n"'), segment, F.lit('", '), F.col("c_nationkey").cast("string"), F.lit("\n\n"))
    export_csv(table(spark, folder, "customer").select(
        "c_custkey", note.alias("note"), F.when(F.col("c_custkey") % 3 == 0, F.concat(segment, F.lit("\n"))).otherwise(segment).alias("segment"), "c_acctbal",
    ), path)
    return scan(spark, path)


ORDER_JSON = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def _dated(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(ORDER_JSON)
def json_round_trip(spark, folder):
    path = _scratch(spark, "export", ".jsonl")
    _dated(table(spark, folder, "orders")).write.json(path)
    return scan(spark, path)


@query(ORDER_JSON.replace(" FROM orders", ", '}' || o_orderkey || ' [\"' AS note, o_orderpriority || '|]' AS parts FROM orders"))
def json_documents(spark, folder):
    """Files that hold one JSON array each, without a line break between its objects."""
    def as_array(batches):
        opened = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_pydict({"value": ["," * (opened or i > 0) + "[" * (not opened and i == 0) + t for i, t in enumerate(texts)]})
                opened = True
        yield pa.RecordBatch.from_pydict({"value": ["]" if opened else "[]"]})

    path = _scratch(spark, "documents", ".json")
    extra = F.struct(
        F.concat(F.lit("}"), F.col("o_orderkey").cast("string"), F.lit(' ["')).alias("note"), F.array("o_orderpriority", F.lit("]")).alias("parts")
    )
    orders = _dated(table(spark, folder, "orders")).withColumn("extra", extra)
    orders.select(F.to_json(F.struct(*orders.columns)).alias("value")).mapInArrow(as_array, "value string").write.option("lineSep", " ").text(path)
    found = scan(spark, path)
    return found.withColumn("note", F.col("extra.note")).withColumn("parts", F.array_join("extra.parts", "|")).drop("extra")


@query(f"""WITH {PARSED} SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, o_orderstatus,
  priority, price, day, finished, round(amount, 2) AS amount FROM parsed""")
def snapshot_round_trip(spark, folder):
    from deltascope import coerce_numeric

    messy = messy_orders(spark, folder)
    snapshot = write_snapshot(messy.withColumn("amount", coerce_numeric(F.col("price"))), _scratch(spark, "snapshot", ".parquet"))
    return _dated(rounded(snapshot, 2, ["amount"])).drop("Unnamed: 9")


@query("""SELECT c_custkey, c_name, c_mktsegment, 'tab' AS read_as FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'bar' FROM customer
UNION ALL SELECT NULL, 'Unsupported file type: .xml', NULL, 'error'""")
def scan_by_suffix(spark, folder):
    """Delimiters by suffix and by the header line; an unknown suffix is an error."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    tab, bar = _scratch(spark, "tabs", ".tsv"), _scratch(spark, "bars", ".txt")
    customer.write.options(header=True, sep="\t").csv(tab)
    customer.write.options(header=True, sep="|").csv(bar)
    try:
        scan(spark, f"{folder}/customer.xml")
        message = "read"
    except ValueError as error:
        message = str(error)
    failed = spark.createDataFrame([(None, message, None)], customer.schema)
    frames = {"tab": scan(spark, tab), "bar": scan(spark, bar), "error": failed}
    return reduce(DataFrame.unionByName, [f.withColumn("read_as", F.lit(name)) for name, f in frames.items()])


@query("""SELECT 'rows' AS fact, least(1000, count(*)) AS n FROM lineitem UNION ALL SELECT 'rows of the table', least(1000, count(*)) FROM lineitem
UNION ALL SELECT 'rows of a short table', count(*) FROM nation""")
def preview_rows(spark, folder):
    """As many rows as asked for or there are, and every one of them a row of the table."""
    lineitem = table(spark, folder, "lineitem")
    shown = preview(lineitem)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    found = [
        ("rows", shown.count()), ("rows of the table", shown.join(lineitem.select(*keys).distinct(), keys, "left_semi").count()),
        ("rows of a short table", preview(table(spark, folder, "nation")).count()),
    ]
    return spark.createDataFrame(found, "fact string, n bigint")
