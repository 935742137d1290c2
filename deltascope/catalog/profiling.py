"""Profiles, roles, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltascope import coerce_numeric, parse_dates, prepare, profile, quality_issues, time_axes
from deltascope.catalog import query, rounded, table
from deltascope.catalog.tables import MESSY, PARSED, messy_orders
from deltascope.functions import fixed
from deltascope.operators.profile import NOTES, candidate_keys, rollup_levels
from deltascope.operators.roles import dimension_candidates, granularity, metric_candidates, time_axis_candidates

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
NUMERIC = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
}


def counts_sql(name: str) -> str:
    parts = [
        f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct,"
        f" count(DISTINCT {c}) AS unique_count, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_key FROM {name}"
        for c in COLUMNS[name]
    ]
    return " UNION ALL ".join(parts)


# how the columns are stored; all others are text
DTYPES = {
    "bigint": [*COLUMNS["lineitem"][:3], "o_orderkey", "o_custkey", "c_custkey", "doc_id", "n_chars", "event_id", "user_id"],
    "int": ["l_linenumber", "c_nationkey"],
    "double": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "value"],
    "timestamp_ntz": ["o_orderdate", "l_shipdate", "ts"],
}


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def four(value: str) -> str:
    """Rounded to four digits from the exact binary value, as Python rounds."""
    return f"format('{{:.4f}}', ({value})::DOUBLE)::DOUBLE"


def _cells_sql(source: str, position: int, name: str, dtype: str) -> str:
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    c, stripped = f'"{name}"', f"trim(\"{name}\", {white})"
    kind = {"string": "text", "timestamp_ntz": "datetime"}.get(dtype, "number")
    shown, place, number, clean = f"{c}::VARCHAR", f"{c}::DOUBLE", f"{c}::DOUBLE", "NULL::VARCHAR"
    if kind == "text":
        place = "NULL::DOUBLE"
        number = f"TRY_CAST(regexp_extract({stripped}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$', 0) AS DOUBLE)"
        clean = f"CASE WHEN lower({stripped}) NOT IN ({_listed(fixed.NULL_TOKENS)}) THEN {stripped} END"
    elif kind == "datetime":
        place, number = f"epoch({c})::DOUBLE", "NULL::DOUBLE"
    return f"""
    SELECT {position} AS position, '{name}' AS name, '{dtype}' AS dtype, '{kind}' AS kind, value, place, number, clean, count(*) AS rows
    FROM (SELECT {shown} AS value, {place} AS place, {number} AS number, {clean} AS clean FROM {source}) GROUP BY value, place, number, clean"""


def profile_sql(source: str, columns: dict[str, str], prefix: str = "") -> str:
    """All fields of a profile: facts are counted, and the rules and limits spelled out over them.

    `columns` has the stored type of each column; `prefix` holds common tables that `source` needs.
    """
    parts = [_cells_sql(source, i, name, dtype) for i, (name, dtype) in enumerate(columns.items())]
    code, year = (f"regexp_matches(name, '{p}')" for p in (fixed.CODE_NAME_PATTERN, fixed.YEAR_NAME_PATTERN))
    many = f"uniq > {fixed.KEY_MIN_RATIO} * present"
    return f"""
    WITH {prefix} cells AS ({" UNION ALL ".join(parts)}),
    judged AS (SELECT *, try_strptime(clean, ['%m/%d/%Y', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%SZ']) IS NOT NULL AS is_date,
        regexp_matches(clean, '{fixed.AMOUNT_PATTERN}') AS is_amount, lower(clean) IN ({_listed(fixed.BOOLEAN_WORDS)}) AS is_flag FROM cells),
    spread AS (SELECT position, sum(number * rows) / sum(rows) AS mean FROM cells WHERE number IS NOT NULL GROUP BY position),
    running AS (SELECT position, number, sum(rows) OVER (PARTITION BY position ORDER BY number, value) AS seen, sum(rows) OVER (PARTITION BY position) AS every
        FROM cells WHERE number IS NOT NULL AND kind = 'number'),
    middle AS (SELECT position, (min(number) FILTER (seen >= (every + 1) // 2) + min(number) FILTER (seen >= every // 2 + 1)) / 2 AS median FROM running GROUP BY position),
    facts AS (
        SELECT j.position, name, dtype, kind, sum(rows) AS n, coalesce(sum(rows) FILTER (value IS NOT NULL), 0) AS present,
            count(*) FILTER (value IS NOT NULL) AS uniq, min(number) AS low, max(number) AS high, coalesce(sum(rows) FILTER (number IS NOT NULL), 0) AS numbers,
            coalesce(bool_and(number % 1 = 0), false) AS whole, coalesce(sum(rows) FILTER (clean IS NOT NULL), 0) AS clean,
            coalesce(sum(rows) FILTER (is_date), 0) AS days, coalesce(sum(rows) FILTER (is_amount), 0) AS amounts, coalesce(bool_and(is_flag), false) AS flags,
            sum(length(clean) * rows) AS characters, min(value) AS first, max(value) AS last, coalesce(sum(rows) FILTER (number = 0), 0) AS zeros,
            coalesce(bool_or(number < 0), false) AS negatives, any_value(mean) AS mean,
            sqrt(sum((number - mean) * (number - mean) * rows) / nullif(coalesce(sum(rows) FILTER (number IS NOT NULL), 0) - 1, 0)) AS std
        FROM judged j LEFT JOIN spread s ON j.position = s.position GROUP BY j.position, name, dtype, kind),
    typed AS (SELECT *, CASE WHEN present = 0 THEN 'empty' WHEN uniq = 1 THEN 'constant' WHEN kind = 'datetime' THEN 'date'
        WHEN uniq BETWEEN 2 AND {fixed.YEAR_MAX_DISTINCT} AND numbers >= 0.99 * present AND whole AND low >= {fixed.YEAR_MIN} AND high <= {fixed.YEAR_MAX}
            AND ({year} OR (uniq >= 3 AND high - low + 1 <= 2 * uniq)) THEN 'year'
        WHEN kind = 'number' AND {code} AND {many} THEN 'identifier' WHEN kind = 'number' THEN 'numeric'
        WHEN clean > 0 AND days >= {fixed.TYPE_SHARE} * clean THEN 'date_as_string'
        WHEN clean > 0 AND amounts >= {fixed.TYPE_SHARE} * clean THEN 'numeric_as_string' WHEN flags THEN 'boolean'
        WHEN {many} AND ({code} OR uniq > {fixed.KEY_MIN_DISTINCT}) THEN 'identifier'
        WHEN characters >= {fixed.FREE_TEXT_MIN_LENGTH} * clean THEN CASE WHEN clean > 0 THEN 'free_text' ELSE 'categorical' END
        WHEN uniq <= {fixed.CATEGORY_MAX_DISTINCT} OR uniq <= {fixed.CATEGORY_MAX_RATIO} * present THEN 'categorical' ELSE 'free_text' END AS semantic FROM facts),
    smallest AS (SELECT position, string_agg(value, ' | ' ORDER BY r) AS samples, min(value) AS one FROM (
        SELECT position, value, row_number() OVER (PARTITION BY position ORDER BY place, value) AS r FROM cells WHERE value IS NOT NULL)
        WHERE r <= {fixed.SAMPLE_VALUES} GROUP BY position),
    commonest AS (SELECT position, string_agg(value || '=' || rows, ' | ' ORDER BY r) AS top FROM (
        SELECT position, value, rows, row_number() OVER (PARTITION BY position ORDER BY rows DESC, value) AS r FROM cells WHERE value IS NOT NULL)
        WHERE r <= {fixed.TOP_VALUES} GROUP BY position)
    SELECT t.position, name, dtype, semantic AS semantic_type, (n - present)::BIGINT AS null_count, round(100.0 * (n - present) / n, 2) AS null_pct, uniq AS unique_count,
        coalesce(samples, '') AS samples, CASE WHEN semantic IN ('categorical', 'boolean') THEN coalesce(top, '') ELSE '' END AS top_values,
        CASE semantic WHEN 'numeric' THEN {four('low')}::VARCHAR WHEN 'date' THEN first WHEN 'year' THEN low::BIGINT::VARCHAR END AS low,
        CASE semantic WHEN 'numeric' THEN {four('high')}::VARCHAR WHEN 'date' THEN last WHEN 'year' THEN high::BIGINT::VARCHAR END AS high,
        CASE semantic WHEN 'numeric' THEN {four('mean')} END AS mean, CASE semantic WHEN 'numeric' THEN {four('median')} END AS median,
        CASE semantic WHEN 'numeric' THEN {four('std')} END AS std, semantic = 'numeric' AND negatives AS has_negatives,
        CASE semantic WHEN 'numeric' THEN zeros::BIGINT ELSE 0 END AS zero_count,
        CASE WHEN semantic = 'constant' THEN 'single value: ' || one WHEN semantic = 'identifier' AND kind = 'number' THEN '{NOTES["identifier_number"]}'
            WHEN semantic = 'numeric' AND {code} THEN 'a code by its name, with ' || format('{{:,}}', uniq) || ' distinct values: rather a category, not a quantity to sum'
            WHEN semantic = 'boolean' AND kind = 'text' THEN '{NOTES["boolean_text"]}' WHEN semantic = 'empty' THEN '{NOTES["empty"]}'
            WHEN semantic = 'year' THEN '{NOTES["year"]}' WHEN semantic = 'date_as_string' THEN '{NOTES["date_as_string"]}'
            WHEN semantic = 'numeric_as_string' THEN '{NOTES["numeric_as_string"]}' END AS note
    FROM typed t LEFT JOIN smallest s ON t.position = s.position LEFT JOIN commonest c ON t.position = c.position LEFT JOIN middle m ON t.position = m.position"""


def dtype_of(column: str) -> str:
    return next((t for t, names in DTYPES.items() if column in names), "string")


def _every_field(prof) -> DataFrame:
    """All fields of a profile, lists as text."""
    frame = prof.to_frame().withColumnsRenamed({"min": "low", "max": "high"})
    top = F.transform("top_values", lambda v: F.concat_ws("=", v["value"], v["n"]))
    return frame.withColumn("samples", F.array_join("samples", " | ")).withColumn("top_values", F.array_join(top, " | "))


for _name in COLUMNS:
    query(profile_sql(_name, {c: dtype_of(c) for c in COLUMNS[_name]}), f"profile_{_name}")(
        lambda spark, folder, name=_name: _every_field(profile(table(spark, folder, name), duplicates=False))
    )


def figures_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, {four(f'min({c})')} AS low, {four(f'max({c})')} AS high, {four(f'avg({c})')} AS mean, {four(f'median({c})')} AS median,"
        f" {four(f'stddev_samp({c})')} AS std, count(*) FILTER ({c} = 0) AS zero_count, coalesce(bool_or({c} < 0), false) AS has_negatives FROM {name}"
        for c in NUMERIC[name]
    )


def _figures(spark, folder, name: str) -> DataFrame:
    found = profile(table(spark, folder, name), duplicates=False).to_frame().where("semantic_type = 'numeric'")
    return found.select(
        "name", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"), "mean", "median", "std", "zero_count", "has_negatives"
    )


for _name in NUMERIC:
    query(figures_sql(_name), f"profile_{_name}_figures")(lambda spark, folder, name=_name: _figures(spark, folder, name))

TEXT_COLUMNS = ["o_orderstatus", "o_orderpriority"]


@query(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS rows,"
    f" CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 6"
    for c in TEXT_COLUMNS) + " UNION ALL SELECT * FROM (SELECT 'o_custkey' AS name, 'c' || o_custkey AS value, count(*) AS rows,"
    " CAST(row_number() OVER (ORDER BY count(*) DESC, 'c' || o_custkey) AS INTEGER) AS rank FROM orders GROUP BY o_custkey) WHERE rank <= 6")
def profile_top_values(spark, folder):
    """Commonest values as the profile has them, also of a column with thousands."""
    orders = table(spark, folder, "orders").select(*TEXT_COLUMNS, F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("o_custkey"))
    found = profile(orders, duplicates=False).to_frame().select("name", F.posexplode("top_values").alias("rank", "v"))
    return found.select("name", "v.value", F.col("v.n").alias("rows"), (F.col("rank") + 1).alias("rank"))


@query(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS name, {c} AS value, count(*) AS rows, CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS rank FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 4"
    for c in ["text", "lang", "source"]))
def profile_sample_values(spark, folder):
    """The smallest values as the profile has them, of whole documents too, with the rows that hold each."""
    documents = table(spark, folder, "documents")
    found = profile(documents, duplicates=False).to_frame().where("dtype = 'string'")
    samples = found.select("name", F.posexplode("samples").alias("rank", "value"))
    names = [r["name"] for r in found.select("name").collect()]
    cells = documents.select(*names).unpivot([], names, "name", "value")
    rows = cells.join(F.broadcast(samples.select("name", "value")), ["name", "value"], "left_semi").groupBy("name", "value").agg(F.count("*").alias("rows"))
    return samples.join(rows, ["name", "value"]).select("name", "value", "rows", (F.col("rank") + 1).alias("rank"))


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, name FROM ({counts_sql(t)}) WHERE is_key" for t in COLUMNS))
def profile_keys(spark, folder):
    found = [(t, key) for t in COLUMNS for key in candidate_keys(table(spark, folder, t))]
    return spark.createDataFrame(found, "table_name string, name string")


@query(f"""WITH {MESSY} SELECT 'messy_orders' AS table_name, (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS duplicate_rows
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))
UNION ALL SELECT 'documents without id', (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents))
UNION ALL SELECT 'labels without id', (SELECT count(*) FROM labels) - (SELECT count(*) FROM (SELECT DISTINCT quality, toxic FROM labels))""")
def profile_duplicates(spark, folder):
    from deltascope import count_duplicates

    tables = {
        "messy_orders": messy_orders(spark, folder), "lineitem": table(spark, folder, "lineitem"),
        "documents without id": table(spark, folder, "documents").drop("doc_id"),
        "labels without id": table(spark, folder, "labels").drop("doc_id"),
    }
    return spark.createDataFrame([(k, count_duplicates(v)) for k, v in tables.items()], "table_name string, duplicate_rows bigint")


@query("""SELECT 'orders' AS table_name, 'o_orderdate' AS name, 'date' AS semantic_type, strftime(min(o_orderdate), '%Y-%m-%d') AS low, strftime(max(o_orderdate), '%Y-%m-%d') AS high FROM orders
UNION ALL SELECT 'orders', 'order_year', 'year', min(year(o_orderdate))::VARCHAR, max(year(o_orderdate))::VARCHAR FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', 'date', strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem""")
def profile_ranges(spark, folder):
    """First and last value of date and year columns."""
    frames = {
        "orders": table(spark, folder, "orders").select("o_orderdate", F.year("o_orderdate").alias("order_year")),
        "lineitem": table(spark, folder, "lineitem").select("l_shipdate"),
    }
    rows = [
        (name, c.name, c.semantic_type, c.min[:10], c.max[:10])
        for name, frame in frames.items() for c in profile(frame, duplicates=False).columns
    ]
    return spark.createDataFrame(rows, "table_name string, name string, semantic_type string, low string, high string")


MESSY_COLUMNS = {
    **{c: dtype_of(c) for c in ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")},
    **dict.fromkeys(("priority", "price", "day", "finished", "Unnamed: 9"), "string"),
}
MESSY_PROFILE = profile_sql("messy", MESSY_COLUMNS, f"{MESSY},")


@query(f"SELECT name, semantic_type, note, samples, top_values FROM ({MESSY_PROFILE})")
def profile_semantic_types(spark, folder):
    return _every_field(profile(messy_orders(spark, folder), duplicates=False)).select("name", "semantic_type", "note", "samples", "top_values")


SURPLUS = f"(WITH {MESSY} SELECT (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS surplus, (SELECT count(*) FROM messy) AS n)"


@query(f"""SELECT 'duplicates' AS kind, format('{{:,}}', surplus) || ' repeated rows, ' || format('{{:.1f}}', 100.0 * surplus / n) || '% of all' AS warning FROM {SURPLUS} WHERE surplus > 0
UNION ALL SELECT 'unnamed', count(*) || ' column(s) without a name, probably left over from a spreadsheet' FROM ({MESSY_PROFILE}) WHERE name ILIKE 'unnamed:%' HAVING count(*) > 0
UNION ALL SELECT 'all_null', format('''{{}}'' is entirely null', name) FROM ({MESSY_PROFILE}) WHERE semantic_type = 'empty'
UNION ALL SELECT 'mostly_null', format('''{{}}'' is {{}}% null', name, null_pct) FROM ({MESSY_PROFILE}) WHERE semantic_type <> 'empty' AND null_pct > 50
UNION ALL SELECT 'stored_as_text', format('''{{}}'' holds {{}} as text', name, CASE semantic_type WHEN 'date_as_string' THEN 'dates' ELSE 'numbers' END)
FROM ({MESSY_PROFILE}) WHERE semantic_type IN ('date_as_string', 'numeric_as_string')""")
def profile_warnings(spark, folder):
    return profile(messy_orders(spark, folder)).warnings_frame().select("kind", "warning")


@query("""WITH named AS (SELECT 'level' AS name, 'Level ' || n_regionkey AS value FROM nation UNION ALL SELECT 'place', n_name || ' region ' || n_regionkey % 2 FROM nation
  UNION ALL SELECT 'number', 'Place ' || n_regionkey FROM nation),
counted AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value) AS rank FROM named GROUP BY name, value),
shown AS (SELECT name, count(*) AS n, count(*) FILTER (regexp_matches(value, '(?i)^level\\b')) AS levels FROM counted WHERE rank <= 6 GROUP BY name)
SELECT name, levels >= greatest(1, n // 2) AS is_rollup FROM shown""")
def profile_rollup_levels(spark, folder):
    """A column that names levels of aggregation, and two that name peers."""
    nation = table(spark, folder, "nation")
    region = F.col("n_regionkey").cast("string")
    named = nation.select(
        F.concat(F.lit("Level "), region).alias("level"),
        F.concat("n_name", F.lit(" region "), (F.col("n_regionkey") % 2).cast("string")).alias("place"),
        F.concat(F.lit("Place "), region).alias("number"),
    )
    return spark.createDataFrame(
        [(c.name, rollup_levels(c)) for c in profile(named, duplicates=False).columns], "name string, is_rollup boolean"
    )


# Cells padded to several hundred characters: the same rules as for short ones. Missing
# amounts stand as padded tokens; every share that a rule asks for is counted by the SQL.
@query("""WITH cells AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag, strftime(o_orderdate, '%m/%d/%Y') AS day,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '$' || round(o_totalprice)::BIGINT END AS amount,
    o_orderpriority AS word, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderstatus END AS mixed FROM orders),
shares AS (SELECT name, count(value) AS n, count(DISTINCT value) AS d,
    count(*) FILTER (lower(value) IN ('yes', 'no')) AS flags, count(try_strptime(value, ['%m/%d/%Y', '%Y-%m-%d'])) AS days,
    count(*) FILTER (regexp_matches(value, '^[$]?[0-9]+$')) AS amounts
  FROM (UNPIVOT cells ON flag, day, amount, word, mixed INTO NAME name VALUE value) GROUP BY name)
SELECT name, CASE WHEN days >= 0.9 * n THEN 'date_as_string' WHEN amounts >= 0.9 * n THEN 'numeric_as_string' WHEN flags = n THEN 'boolean'
  WHEN d <= 25 OR d <= 0.5 * n THEN 'categorical' ELSE 'free_text' END AS semantic_type FROM shares""")
def profile_long_cells(spark, folder):
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    cells = orders.select(
        F.when(key % 2 == 0, "Yes").otherwise("no").alias("flag"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.when(key % 9 == 0, "N/A").otherwise(F.concat(F.lit("$"), F.round("o_totalprice").cast("bigint").cast("string"))).alias("amount"),
        F.col("o_orderpriority").alias("word"),
        F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderstatus")).alias("mixed"),
    )
    padded = cells.select(*[F.concat(F.repeat(F.lit(" "), 300), c, F.repeat(F.lit(" "), 40 + i)).alias(c) for i, c in enumerate(cells.columns)])
    return profile(padded, duplicates=False).to_frame().select("name", "semantic_type")


@query("""WITH v AS (SELECT 'item ' || l_partkey AS value, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT 'top' AS part, value, row_number() OVER (ORDER BY rows DESC, value)::INTEGER AS rank FROM v QUALIFY rank <= 6
UNION ALL SELECT 'sample', value, row_number() OVER (ORDER BY value)::INTEGER AS rank FROM v QUALIFY rank <= 4""")
def profile_screening(spark, folder):
    """A screening run finds the same commonest and smallest values, also of columns with thousands."""
    items = table(spark, folder, "lineitem").select(F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("item"))
    column = profile(items, exact=False).columns[0]
    rows = [("top", v, i) for i, (v, _) in enumerate(column.top_values, 1)] + [("sample", v, i) for i, v in enumerate(column.samples, 1)]
    return spark.createDataFrame(rows, "part string, value string, rank int")


@query(f"""SELECT 'duplicates' AS kind, format('{{:,}}', surplus) || ' duplicate rows removed' AS issue FROM {SURPLUS} WHERE surplus > 0
UNION ALL SELECT 'missing', format('''{{}}'': {{:,}} missing values, {{}}% of the rows', name, null_count, null_pct) FROM ({MESSY_PROFILE}) WHERE null_count > 0
UNION ALL SELECT 'stored_as', format('''{{}}'': {{}}', name, CASE semantic_type WHEN 'empty' THEN 'no values' WHEN 'date_as_string' THEN 'dates stored as text' ELSE 'numbers stored as text' END)
FROM ({MESSY_PROFILE}) WHERE semantic_type IN ('empty', 'date_as_string', 'numeric_as_string')""")
def quality_issues_messy(spark, folder):
    prof = profile(messy_orders(spark, folder))
    return spark.createDataFrame(quality_issues(prof, prof.duplicate_rows), "kind string, issue string")


def lines_sql(profiled: str) -> str:
    """The profile as text: up to five lines a column."""
    figures = ", ".join(f"'{name} ' || {column}" for name, column in (("min", "low"), ("max", "high"), ("mean", "mean"), ("median", "median"), ("std", "std")))
    return f"""SELECT position * 10 AS line, format('  {{}} [{{}}, {{}}] nulls {{}} ({{}}%), {{:,}} distinct', name, semantic_type, dtype, null_count, null_pct, unique_count) AS text FROM ({profiled})
UNION ALL SELECT position * 10 + 1, '    top: ' || array_to_string(list_transform(string_split(top_values, ' | '),
    lambda v: format('{{}} ({{:,}})', string_split(v, '=')[1], string_split(v, '=')[2]::BIGINT)), ', ') FROM ({profiled}) WHERE top_values <> ''
UNION ALL SELECT position * 10 + 2, '    ' || array_to_string(list_filter([{figures}], lambda x: x IS NOT NULL), ', ') FROM ({profiled}) WHERE low IS NOT NULL
UNION ALL SELECT position * 10 + 3, '    e.g. ' || samples FROM ({profiled}) WHERE samples <> ''
UNION ALL SELECT position * 10 + 4, '    note: ' || note FROM ({profiled}) WHERE note IS NOT NULL"""


@query(f"""SELECT -1 AS line, 'customer: ' || format('{{:,}}', count(*)) || ' rows, {len(COLUMNS["customer"])} columns, duplicates not counted' AS text FROM customer
UNION ALL {lines_sql(profile_sql("customer", {c: dtype_of(c) for c in COLUMNS["customer"]}))}""")
def profile_summary(spark, folder):
    """The profile as text, line by line; keys and warnings have queries of their own."""
    prof = profile(table(spark, folder, "customer"), duplicates=False)
    first, *others = prof.summary("customer").split("\n")
    lines, line = [(-1, first)], -10
    kinds = {"top": 1, "min": 2, "e.g": 3, "not": 4}
    for text in others:
        if text.startswith(("keys: ", "warning: ")):
            continue
        if text.startswith("    "):
            lines.append((line + kinds[text.strip()[:3]], text))
        else:
            line += 10
            lines.append((line, text))
    return spark.createDataFrame(lines, "line int, text string")


# Words about as long as the limit for free text: the mean length over the values that are there decides.
LENGTHS = """lengths AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE repeat('x', 36 + (o_orderkey % 9)::INT) END AS above,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE repeat('y', 35 + (o_orderkey % 9)::INT) END AS below,
  CASE WHEN o_orderkey % 7 = 0 THEN '  -  ' ELSE '  ' || repeat('z', 36 + (o_orderkey % 8)::INT) || '  ' END AS padded FROM orders)"""


@query(f"""SELECT name, semantic_type FROM ({profile_sql("lengths", dict.fromkeys(("above", "below", "padded"), "string"), LENGTHS + ",")})""")
def profile_text_lengths(spark, folder):
    key = F.col("o_orderkey")

    def words(letter, least, spread, missing, pad=""):
        text = F.concat(F.lit(pad), F.repeat(F.lit(letter), least + (key % spread).cast("int")), F.lit(pad))
        return F.when(key % 7 == 0, missing).otherwise(text)

    lengths = table(spark, folder, "orders").select(
        words("x", 36, 9, "n/a").alias("above"), words("y", 35, 9, "").alias("below"), words("z", 36, 8, "  -  ", "  ").alias("padded")
    )
    return profile(lengths, duplicates=False).to_frame().select("name", "semantic_type")


@query(" UNION ALL ".join(
    f"SELECT '{t}.{c}' AS name, count(DISTINCT {c}) AS unique_count, count(*) AS n_rows, count(DISTINCT {c}) > 1000 AND count(DISTINCT {c}) > 0.05 * count(*) AS too_granular FROM {t}"
    for t in ("orders", "events") for c in COLUMNS[t]))
def too_granular(spark, folder):
    frames = [
        granularity(profile(table(spark, folder, t), duplicates=False)).withColumn("name", F.concat(F.lit(f"{t}."), "name"))
        for t in ("orders", "events")
    ]
    return frames[0].unionByName(frames[1])


@query("""SELECT 'events' AS table_name, 'ts' AS axis, 'date' AS kind, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM events
UNION ALL SELECT 'orders', 'o_orderdate', 'date', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
UNION ALL SELECT 'orders', 'fiscal_year', 'annual', CAST(min(year(o_orderdate)) AS VARCHAR), CAST(max(year(o_orderdate)) AS VARCHAR) FROM orders""",
       "time_axes")
def time_axes_of_tables(spark, folder):
    orders = table(spark, folder, "orders").withColumn("fiscal_year", F.year("o_orderdate"))
    frames = [
        time_axes(profile(df, duplicates=False), df).withColumn("table_name", F.lit(name))
        for name, df in (("events", table(spark, folder, "events")), ("orders", orders))
    ]
    return frames[0].unionByName(frames[1])


LINE_TEXT = ["l_returnflag", "l_linestatus"]


@query(" UNION ALL ".join(
    [f"SELECT 'metric' AS role, '{c}' AS name FROM lineitem HAVING count(DISTINCT {c}) > 200 OR min({c}) < 1900 OR max({c}) > 2100" for c in NUMERIC["lineitem"]]
    + ["SELECT 'time', 'l_shipdate' FROM lineitem HAVING count(DISTINCT l_shipdate) > 1"]
    + [f"SELECT 'dimension', '{c}' FROM lineitem HAVING count(DISTINCT {c}) BETWEEN 2 AND 25 AND avg(length({c})) < 40" for c in LINE_TEXT]))
def column_roles(spark, folder):
    prof = profile(table(spark, folder, "lineitem"), duplicates=False)
    roles = {"metric": metric_candidates(prof), "time": time_axis_candidates(prof), "dimension": dimension_candidates(prof)}
    return spark.createDataFrame([(role, name) for role, names in roles.items() for name in names], "role string, name string")


# ---------------------------------------------------------------- cleaning


@query(f"WITH {PARSED} SELECT o_orderkey, round(amount, 2) AS amount FROM parsed")
def coerce_numeric_price(spark, folder):
    messy = messy_orders(spark, folder)
    return rounded(messy.select("o_orderkey", coerce_numeric(F.col("price")).alias("amount")), 2, ["amount"])


# how an order writes its date, by its key
FORMS = (
    "MM/dd/yyyy",
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "MMM dd, yyyy",
    "dd MMMM yyyy",
    "'not a date'",
    "yyyyMMdd",
    "MM/dd/yyyy hh:mm:ss a",
    "M/d/yy H:mm",
    "dd-MMM-yy",
    "dd/MMM/yyyy",
    "yyyy-MM-dd hh:mm a",
    "yyyy/MM/dd H:mm",
    "MMM d yyyy",
    "EEE MMM d yyyy",
    "EEEE, MMMM d, yyyy",
    "d MMM yyyy H:mm",
)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(FORMS)} <> {FORMS.index("'not a date'")} THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_dates_text(spark, folder):
    """Many notations mixed in one column; one of them is no date."""
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(FORMS):
        text = F.when(F.col("o_orderkey") % len(FORMS) == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("written"))
    return orders.select("o_orderkey", F.date_format(parse_dates(F.col("written")), "yyyy-MM-dd").alias("day"))


@query(f"""WITH {PARSED} SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, o_orderstatus, priority, round(amount, 2) AS price,
  strftime(parsed_day, '%Y-%m-%d') AS day, finished FROM parsed""")
def prepare_dedup(spark, folder):
    frame = prepare(messy_orders(spark, folder)).frame
    return rounded(frame, 2, ["price"]).withColumn("day", F.date_format("day", "yyyy-MM-dd")).drop("o_orderdate")


@query(f"""WITH {PARSED}, f AS (SELECT count(*) AS n, count(*) FILTER (amount IS NULL AND price IS NOT NULL) AS prices,
  count(*) FILTER (parsed_day IS NULL AND day IS NOT NULL) AS days FROM parsed),
d AS (SELECT (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS n)
SELECT 'parse_numbers' AS kind, 'Read the text in ''price'' as numbers; ' || format('{{:,}}', prices) || ' value(s) did not parse and are now missing' AS description, n AS rows_affected, TRUE AS reversible FROM f
UNION ALL SELECT 'parse_dates', 'Read the text in ''day'' as dates; ' || format('{{:,}}', days) || ' value(s) did not parse and are now missing', n, TRUE FROM f
UNION ALL SELECT 'drop_column', 'Dropped ''Unnamed: 9'', which holds no value', 0, TRUE
UNION ALL SELECT 'drop_duplicates', 'Removed ' || format('{{:,}}', n) || ' repeated row(s)', n, FALSE FROM d""")
def cleaning_log(spark, folder):
    return prepare(messy_orders(spark, folder)).actions_frame().drop("position")


@query(f"WITH {MESSY} SELECT (SELECT count(*) FROM messy) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS rows_after,"
       " (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS rows_removed")
def rows_removed(spark, folder):
    done = prepare(messy_orders(spark, folder))
    return spark.createDataFrame([(done.rows_before, done.rows_after, done.rows_removed)], "rows_before bigint, rows_after bigint, rows_removed bigint")


@query(f"""WITH {MESSY}, d AS (SELECT (SELECT count(*) FROM messy) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS n)
SELECT 'Kept ' || format('{{:,}}', n) || ' repeated row(s), which totals count more than once' AS description FROM d""")
def keep_duplicates(spark, folder):
    done = prepare(messy_orders(spark, folder), drop_duplicate_rows=False)
    return done.actions_frame().filter(F.col("kind") == "keep_duplicates").select("description")
