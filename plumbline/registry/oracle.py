"""ANSI SQL for the registered queries, written against the same tables.

Queries about random draws, sketches or files return facts that SQL can state: bounds
that hold, and the counts they are compared with.
"""

from __future__ import annotations

from itertools import combinations

from plumbline.registry.queries import (
    ALIKE,
    ALIKE_TEXTS,
    BUDGET_BYTES,
    ENVIRONMENTS,
    HEAD_ROWS,
    OVERSIZE_BYTES,
    QUANTILES,
)


def ceil_sql(column: str, minutes: int) -> str:
    into_hour = f"(epoch_us({column}) - epoch_us(date_trunc('hour', {column})))"
    steps = f"ceil({into_hour} / ({minutes} * 60000000.0))"
    return f"date_trunc('hour', {column}) + to_minutes(cast({minutes} * {steps} AS BIGINT))"


def ts_ceil_sql(minutes: int) -> str:
    return f"SELECT event_id, {ceil_sql('ts', minutes)} AS rounded FROM events"


ROUNDED_EVENTS = (
    f"SELECT * EXCLUDE (ts), {ceil_sql('ts', 15)} AS rounded_15, "
    f"{ceil_sql('ts', 30)} AS rounded_30 FROM events"
)

FEATURE_LOOKUP = f"""
WITH e AS ({ROUNDED_EVENTS}),
f15 AS (SELECT event_type, rounded_15, count(*) AS events_15, max(value) AS max_value_15
        FROM e GROUP BY event_type, rounded_15),
f30 AS (SELECT event_type, rounded_30, count(*) AS events_30
        FROM e GROUP BY event_type, rounded_30)
SELECT e.event_id, e.event_type, e.rounded_15, e.rounded_30, events_15, max_value_15, events_30
FROM e
LEFT JOIN f15 ON e.event_type = f15.event_type AND e.rounded_15 = f15.rounded_15
LEFT JOIN f30 ON e.event_type = f30.event_type AND e.rounded_30 = f30.rounded_30
"""

FEATURE_LOOKUP_MISSING = f"""
WITH r AS ({ROUNDED_EVENTS}),
e AS (SELECT event_id, nullif(event_type, 'error') AS event_type, rounded_30 FROM r),
f AS (SELECT event_type, rounded_30, count(*) AS events_30 FROM e
      WHERE event_type IN ('purchase', 'view') GROUP BY event_type, rounded_30)
SELECT e.event_id, e.event_type, e.rounded_30, f.events_30
FROM e LEFT JOIN f ON e.event_type = f.event_type AND e.rounded_30 = f.rounded_30
"""

# Bytes of one row per table and layout: fixed part, text columns.
ROW_BYTES = {
    ("events", "pandas"): "130 + strlen(event_type) + strlen(props)",
    ("events", "wire"): "48 + strlen(event_type) + strlen(props)",
    ("documents", "pandas"): "163 + strlen(text) + strlen(lang) + strlen(source)",
    ("documents", "wire"): "40 + strlen(text) + strlen(lang) + strlen(source)",
    ("embeddings", "pandas"): "132 + 4 * len(embedding)",
    ("embeddings", "wire"): "20 + 4 * len(embedding)",
    ("orders", "pandas"): "130 + strlen(o_orderstatus) + strlen(o_orderpriority)",
    ("lineitem", "pandas"): "166 + strlen(l_returnflag) + strlen(l_linestatus)",
    ("customer", "pandas"): "118 + strlen(c_name) + strlen(c_mktsegment)",
}


def bytes_sql(table: str, layout: str = "pandas") -> str:
    return f"CAST(sum({ROW_BYTES[table, layout]}) AS BIGINT)"


SIZE_EXACT = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{layout}' AS layout, count(*) AS n_rows, "
    f"{bytes_sql(name, layout)} AS n_bytes FROM {name}"
    for name in ("events", "documents", "embeddings")
    for layout in ("pandas", "wire")
)

OVERSIZED = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, {bytes_sql(name)} > {OVERSIZE_BYTES} AS oversized FROM {name}"
    for name in ("events", "documents", "lineitem", "customer")
)

SAMPLE_BY_KEY = f"""
WITH s AS (SELECT least(1.0, {BUDGET_BYTES}::DOUBLE / {bytes_sql('events')}) AS share FROM events)
SELECT events.* FROM events, s
WHERE ('0x' || substr(md5(cast(event_id AS VARCHAR)), 1, 8))::BIGINT < share * 4294967296.0
"""

ORDERS_THAT_FIT = (
    f"SELECT least(count(*), count(*) * {BUDGET_BYTES} // {bytes_sql('orders')}) AS k FROM orders"
)

LIMIT_ORDERED = f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= ({ORDERS_THAT_FIT})
"""

CENSUS = """
SELECT lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS extension,
       count(*) AS n_files, CAST(sum(length) AS BIGINT) AS n_bytes
FROM (SELECT concat_ws('/', 'store.v1', p_brand, concat_ws('.', p_name, p_type)) AS path,
             p_size AS length FROM part)
GROUP BY 1
"""

PROVISION = " UNION ALL ".join(
    f"SELECT '{environment}' AS environment, rounded_30, count(*) AS n "
    f"FROM ({ROUNDED_EVENTS}) GROUP BY rounded_30"
    for environment in ENVIRONMENTS
)

EVENTS_WITH_GAPS = """
SELECT event_id, ts, nullif(user_id, 7) AS user_id, nullif(event_type, 'error') AS event_type,
       CASE WHEN value > 50 THEN 'nan'::DOUBLE ELSE value END AS value, props
FROM events
"""

MEASURES_WITH_GAPS = """
SELECT * REPLACE (nullif(l_quantity, 7) AS l_quantity, nullif(l_discount, 0) AS l_discount)
FROM lineitem
"""

WHOLE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
MEASURES = (*WHOLE, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM = (*MEASURES, "l_returnflag", "l_linestatus", "l_shipdate")
PAIRS = list(combinations(sorted(MEASURES), 2))
MEASURES_CTE = f"WITH m AS MATERIALIZED ({MEASURES_WITH_GAPS})"


def overview_sql(source: str, columns: tuple[str, ...], compared: tuple[str, ...]) -> str:
    missing = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in columns)
    listed = ", ".join(compared)
    return f"""
    WITH src AS ({source})
    SELECT count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns,
           CAST(sum({missing}) AS BIGINT) AS n_missing_cells,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM src))
               AS n_duplicate_rows
    FROM src
    """


OVERVIEW = overview_sql(MEASURES_WITH_GAPS, LINEITEM, ALIKE)
OVERVIEW_TEXT = overview_sql("SELECT * FROM documents", ("doc_id", *ALIKE_TEXTS), ALIKE_TEXTS)

MISSING = f"WITH e AS ({EVENTS_WITH_GAPS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({v}) AS n_missing, "
    f"round((count(*) - count({v})) / count(*), 6) AS share_missing FROM e"
    for c, v in [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("user_id", "user_id"),
        ("event_type", "event_type"),
        ("value", "CASE WHEN isnan(value) THEN NULL ELSE value END"),
        ("props", "props"),
    ]
)


def exact_sql(c: str, whole: bool) -> str:
    return ", ".join(
        f"CAST({f'{f}({c})' if whole else 'NULL'} AS VARCHAR) AS {f}_exact" for f in ("min", "max", "sum")
    )


def numeric_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    moments = (
        f"(avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) "
        f"+ 2 * avg({x}) * avg({x}) * avg({x}))"
    )
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({x}), 6) AS mean, "
        f"round(stddev_samp({x}), 6) AS stddev, min({x}) AS min, max({x}) AS max, "
        f"round(sum({x}), 2) AS sum, count(*) FILTER ({c} = 0) AS n_zeros, "
        f"round({moments} / pow(var_pop({x}), 1.5), 6) AS skewness, "
        f"round(kurtosis_pop({x}), 6) AS kurtosis, {exact_sql(c, c in WHOLE)} FROM m"
    )


NUMERIC = MEASURES_CTE + " UNION ALL ".join(numeric_sql(c) for c in MEASURES)

QUANTILE = MEASURES_CTE + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS quantile, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS value FROM m"
    for c in MEASURES
    for p in QUANTILES
)

DISTINCT = f"WITH e AS ({EVENTS_WITH_GAPS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM e WHERE {keep}"
    for c, keep in [
        ("event_id", "true"),
        ("ts", "true"),
        ("user_id", "true"),
        ("event_type", "true"),
        ("value", "NOT isnan(value)"),
        ("props", "true"),
    ]
)


AS_OF = """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS event_type, ts FROM events),
f AS (SELECT event_type, ts AS dear_ts, max(value) AS dear_value, max(event_id) AS dear_event
      FROM events WHERE value > 300 GROUP BY event_type, ts)
SELECT e.event_id, e.event_type, e.ts, f.dear_value, f.dear_event, f.dear_ts
FROM e ASOF LEFT JOIN f ON e.event_type = f.event_type AND e.ts >= f.dear_ts
"""

DISTINCT_WHOLE = (
    f"WITH m AS ({MEASURES_WITH_GAPS}), w AS (SELECT l_orderkey, l_suppkey, l_quantity, l_returnflag, "
    "l_partkey * 1000000007 AS far, nullif(50 - l_linenumber, 45) AS small FROM m) "
) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM w"
    for c in ("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "far", "small")
)


def top_sql(source: str, columns: list[str], k: int) -> str:
    counted = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )
    return f"""
    SELECT "column", value, n, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
        FROM ({counted}))
    WHERE rank <= {k}
    """


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TOP = top_sql("orders", ORDERS, 5)


def bucket_sql(c: str, bins: int = 10) -> str:
    low, high = f"(SELECT min({c})::DOUBLE FROM m)", f"(SELECT max({c})::DOUBLE FROM m)"
    position = f"floor(({c}::DOUBLE - {low}) / ({high} - {low}) * {bins}.0::DOUBLE)"
    return f"CASE WHEN {c} IS NOT NULL THEN least(CAST({position} AS BIGINT) + 1, {bins}) END"


BUCKETS_CTE = (
    MEASURES_CTE
    + ", b AS MATERIALIZED (SELECT "
    + ", ".join(f"{bucket_sql(c)} AS {c}" for c in MEASURES)
    + " FROM m) "
)


def histogram_sql(c: str, bins: int = 10) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS bucket, "
        f"round(lo + (hi - lo) / {bins}.0::DOUBLE * ({c} - 1), 4) AS lower, "
        f"round(lo + (hi - lo) / {bins}.0::DOUBLE * {c}, 4) AS upper, count(*) AS n "
        f"FROM b, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM m) "
        f"WHERE {c} IS NOT NULL GROUP BY {c}, lo, hi"
    )


HISTOGRAM = BUCKETS_CTE + " UNION ALL ".join(histogram_sql(c) for c in MEASURES)

CORRELATION = MEASURES_CTE + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM m"
    for a, b in PAIRS
)

def _rank(c: str) -> str:
    among = f"OVER (PARTITION BY {c} IS NULL ORDER BY {c})"
    return f"CASE WHEN {c} IS NOT NULL THEN rank() {among} + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END AS {c}"


RANK_CORRELATION = MEASURES_CTE + f", r AS MATERIALIZED (SELECT {', '.join(map(_rank, MEASURES))} FROM m) " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM r" for a, b in PAIRS
)

PAIR_BINS = BUCKETS_CTE + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS BIGINT) AS bucket_a, "
    f"CAST({b} AS BIGINT) AS bucket_b, count(*) AS n FROM b "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
    for a, b in PAIRS
)

DATETIME = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min_ts, max({c}) AS max_ts, "
    f"CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 1000000) AS BIGINT) AS span_seconds "
    f"FROM {name}"
    for c, name in (("ts", "events"), ("o_orderdate", "orders"), ("l_shipdate", "lineitem"))
)


def _metric(section: str, column: str, detail: str, metric: str, value: str, rest: str) -> str:
    return (
        f"SELECT '{section}' AS section, {column} AS \"column\", {detail} AS detail, "
        f"'{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM {rest}"
    )


def _report() -> str:
    """All sections of the lines with a boolean column beside them."""
    columns = (*LINEITEM, "large")
    listed = ", ".join(columns)
    parts = [
        _metric("overview", "''", "''", "n_rows", "count(*)", "m"),
        _metric(
            "overview",
            "''",
            "''",
            "n_duplicate_rows",
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM m))",
            "m",
        ),
    ]
    for c in columns:
        distinct = f"count(DISTINCT {c})"
        parts += [
            _metric("missing", f"'{c}'", "''", "n_missing", f"count(*) - count({c})", "m"),
            _metric("distinct", f"'{c}'", "''", "n_distinct", distinct, "m"),
        ]
    span = "floor((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1000000)"
    parts += [
        _metric("datetime", "'l_shipdate'", "''", "n", "count(l_shipdate)", "m"),
        _metric("datetime", "'l_shipdate'", "''", "span_seconds", span, "m"),
    ]
    for c in MEASURES:
        parts += [
            _metric(
                "quantiles",
                f"'{c}'",
                f"'{p}'",
                "value",
                f"round(quantile_cont({c}::DOUBLE, {p}), 6)",
                "m",
            )
            for p in QUANTILES
        ]
        parts += [
            _metric("numeric", f"'{c}'", "''", "mean", f"round(avg({c}::DOUBLE), 6)", "m"),
            _metric("numeric", f"'{c}'", "''", "stddev", f"round(stddev({c}::DOUBLE), 6)", "m"),
            _metric(
                "histogram",
                f"'{c}'",
                f"CAST({c} AS VARCHAR)",
                "n",
                "count(*)",
                f"b WHERE {c} IS NOT NULL GROUP BY {c}",
            ),
        ]
    for a, b in PAIRS:
        parts += [
            _metric(
                "correlations",
                f"'{a}|{b}'",
                "''",
                "correlation",
                f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6)",
                "m",
            ),
            _metric(
                "pair_bins",
                f"'{a}|{b}'",
                f"{a} || '|' || {b}",
                "n",
                "count(*)",
                f"b WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}",
            ),
        ]
    for c in ("l_returnflag", "l_linestatus"):
        figures = {
            "n": f"count({c})", "n_empty": f"count(*) FILTER ({c} = '')", "min_length": f"min(length({c}))",
            "mean_length": f"round(avg(length({c})), 6)", "max_length": f"max(length({c}))",
        }
        parts += [_metric("text", f"'{c}'", "''", name, value, "m") for name, value in figures.items()]
    figures = {
        "n_true": "count(*) FILTER (large)", "n_false": "count(*) FILTER (NOT large)", "n_missing": "count(*) FILTER (large IS NULL)",
    }
    parts += [_metric("boolean", "'large'", "''", name, value, "m") for name, value in figures.items()]
    top = top_sql("m", list(columns), 10)
    parts.append(_metric("top_values", '"column"', "CAST(rank AS VARCHAR)", "n", "n", f"({top})"))
    return BUCKETS_CTE.replace(MEASURES_CTE, FLAGGED_CTE) + " UNION ALL ".join(parts)


SAMPLE_BY_KEY_NULLS = f"""
WITH s AS (SELECT least(1.0, {BUDGET_BYTES}::DOUBLE / {bytes_sql('events')}) AS share FROM events),
k AS (SELECT *, coalesce(cast(CASE WHEN event_id % 3 <> 0 THEN event_id END AS VARCHAR), 'NULL') AS key FROM events)
SELECT k.* EXCLUDE (key) FROM k, s
WHERE ('0x' || substr(md5(key), 1, 8))::BIGINT < share * 4294967296.0
"""

LIMIT_NARROWED = " UNION ALL ".join(
    f"(SELECT '{label}' AS \"lead\", o_orderkey, o_custkey, o_orderpriority FROM orders "
    f"ORDER BY {order}, o_orderkey LIMIT {HEAD_ROWS})"
    for label, order in (
        ("number", "o_custkey"), ("string", "o_orderpriority"), ("ties", "year(o_orderdate)"),
    )
)

FEATURE_LOOKUP_HOT = """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS event_type FROM events),
f AS (SELECT event_type, count(*) AS n_of_type FROM e WHERE event_type <> 'click' GROUP BY event_type)
SELECT event_id, e.event_type, n_of_type FROM e LEFT JOIN f ON e.event_type = f.event_type
"""

EXACT_TYPES = f"""
WITH m AS (SELECT o_orderkey + 9007199254740993 AS large_key,
                  CAST(o_totalprice AS DECIMAL(20, 2)) AS price FROM orders)
SELECT 'large_key' AS "column", count(large_key) AS n, {exact_sql('large_key', True)} FROM m
UNION ALL SELECT 'price', count(price), {exact_sql('price', True)} FROM m
"""

LARGE_CTE = """
WITH a AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(30, 10)) - CAST(100000 AS DECIMAL(30, 10)) AS amount FROM orders),
m AS MATERIALIZED (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 9007199254740993 ELSE -9007199254740993 - o_orderkey END AS large_key,
         CAST(amount + CAST('12345678901234567.0123456789' AS DECIMAL(30, 10)) AS DECIMAL(38, 10)) AS amount,
         CAST(nullif(amount, 0) AS DECIMAL(38, 10)) AS signed FROM a)
"""


def _around(column: str, point: float) -> str:
    placed = (
        f"SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS place, "
        f"CAST({point} AS DOUBLE) * (count(*) OVER () - 1) AS wanted FROM m WHERE {column} IS NOT NULL"
    )
    return (
        f"SELECT '{column}' AS \"column\", CAST({point} AS DOUBLE) AS quantile, "
        f"CAST(max(v) FILTER (place = floor(wanted)) AS VARCHAR) AS lower, "
        f"CAST(max(v) FILTER (place = ceil(wanted)) AS VARCHAR) AS upper FROM ({placed})"
    )


TYPED_QUANTILES = LARGE_CTE + " UNION ALL ".join(_around(c, p) for c in ("large_key", "amount", "signed") for p in QUANTILES)

FLAGGED_CTE = (
    f"WITH m AS MATERIALIZED (SELECT *, CASE WHEN l_discount > 0.02 THEN l_quantity > 25 END AS large "
    f"FROM ({MEASURES_WITH_GAPS}))"
)

TEXT = "WITH d AS (SELECT *, nullif(lang, 'en') AS gap FROM documents) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER ({c} = '') AS n_empty, "
    f"CAST(min(length({c})) AS BIGINT) AS min_length, round(avg(length({c})), 6) AS mean_length, "
    f"CAST(max(length({c})) AS BIGINT) AS max_length FROM d"
    for c in ("text", "lang", "source", "gap")
)

BOOLEAN = (
    FLAGGED_CTE + " SELECT 'large' AS \"column\", count(*) FILTER (large) AS n_true, "
    "count(*) FILTER (NOT large) AS n_false, count(*) FILTER (large IS NULL) AS n_missing FROM m"
)

SHOWN = {
    "l_returnflag": "l_returnflag",
    "l_linestatus": "l_linestatus",
    "large": "CAST(large AS VARCHAR)",
    "l_quantity": f"CAST({bucket_sql('l_quantity')} AS VARCHAR)",
    "l_tax": f"CAST({bucket_sql('l_tax')} AS VARCHAR)",
}

PAIR_BINS_MIXED = (
    FLAGGED_CTE
    + ", v AS MATERIALIZED (SELECT "
    + ", ".join(f"{shown} AS {c}" for c, shown in SHOWN.items())
    + " FROM m) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {a} AS value_a, {b} AS value_b, count(*) AS n "
        f"FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
        for a, b in combinations(sorted(SHOWN), 2)
    )
)

SKETCHED_QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS quantile, true AS near"
    for c in MEASURES
    for p in QUANTILES
)

TEMP_VIEW = (
    f"SELECT o_orderstatus, {ceil_sql('o_orderdate', 30)} AS order_slot, count(*) AS n "
    "FROM orders GROUP BY ALL"
)

ORACLE_SQL: dict[str, str] = {
    "ts_ceil_15": ts_ceil_sql(15),
    "ts_ceil_30": ts_ceil_sql(30),
    "ts_ceil_7": ts_ceil_sql(7),
    "ts_ceil_90": ts_ceil_sql(90),
    "ts_ceil_seconds": (
        f"SELECT event_id, epoch_us({ceil_sql('ts', 15)}) // 1000000 AS rounded_seconds FROM events"
    ),
    "round_two_grids": ROUNDED_EVENTS,
    "epoch_to_ts": "SELECT event_id, date_trunc('second', ts) AS ts_seconds FROM events",
    "drop_columns": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "temp_view": TEMP_VIEW,
    "feature_lookup": FEATURE_LOOKUP,
    "feature_lookup_missing": FEATURE_LOOKUP_MISSING,
    "feature_lookup_shuffle": FEATURE_LOOKUP,
    "feature_lookup_hot": FEATURE_LOOKUP_HOT,
    "feature_lookup_hot_shuffle": FEATURE_LOOKUP_HOT,
    "reduce_sample_by_key_nulls": SAMPLE_BY_KEY_NULLS,
    "reduce_limit_narrowed": LIMIT_NARROWED,
    "scan_nested": "SELECT * FROM customer",
    "scan_mixed": "SELECT * FROM customer",
    "size_estimate": (
        f"SELECT 'documents' AS table_name, {bytes_sql('documents')} AS n_bytes, true AS near FROM documents"
    ),
    "reduce_sample": "SELECT count(*) AS n_rows, true AS subset, true AS near FROM orders",
    "sample_fixed_fraction": "SELECT count(*) AS n_rows, true AS subset, true AS near FROM events",
    "file_inventory": "SELECT count(*) AS n_rows, true AS sizes_agree FROM lineitem",
    "path_summary": (
        "SELECT count(*) AS n_rows, 'parquet' AS format, true AS bytes_agree FROM lineitem"
    ),
    "profile_quantiles_narrowed": QUANTILE,
    "profile_quantiles_approx": SKETCHED_QUANTILES,
    "profile_distinct_approx": f'SELECT "column", n_distinct, true AS near FROM ({DISTINCT})',
    "profile_quantiles_typed": TYPED_QUANTILES,
    "profile_quantiles_typed_narrowed": TYPED_QUANTILES,
    "profile_exact_types": EXACT_TYPES,
    "profile_text": TEXT,
    "profile_boolean": BOOLEAN,
    "pair_bins_mixed": PAIR_BINS_MIXED,
    "feature_lookup_as_of": AS_OF,
    "feature_lookup_as_of_hot": AS_OF,
    "row_count": "SELECT count(*) AS n_rows FROM events",
    "size_exact": SIZE_EXACT,
    "is_oversized": OVERSIZED,
    "reduce_sample_by_key": SAMPLE_BY_KEY,
    "reduce_sample_exact": """
        SELECT event_id, user_id, value FROM events
        ORDER BY ('0x' || substr(md5('5:' || event_id), 1, 15))::BIGINT LIMIT 777""",
    "reduce_sample_exact_ties": """
        SELECT customer, o_orderkey FROM (SELECT nullif(o_custkey, 7) AS customer, o_orderkey FROM orders)
        ORDER BY ('0x' || substr(md5('0:' || coalesce(customer::VARCHAR, 'NULL')), 1, 15))::BIGINT, customer, o_orderkey LIMIT 500""",
    "save_overwrite_partitions": """
        SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_acctbal > 1000""",
    "reduce_limit_ordered": LIMIT_ORDERED,
    "scan_table": "SELECT * FROM orders",
    "scan_parquet": "SELECT * FROM orders",
    "scan_csv": "SELECT * FROM customer",
    "scan_tsv": "SELECT * FROM customer",
    "scan_compressed": "SELECT * FROM customer",
    "scan_partitions_beside": """
        SELECT *, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS kept_c_mktsegment,
               CASE WHEN c_custkey % 3 = 2 THEN c_nationkey END AS kept_c_nationkey FROM customer
        UNION ALL SELECT *, NULL, NULL FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 50""",
    "scan_json": "SELECT * FROM customer",
    "scan_orc": "SELECT * FROM customer",
    "scan_text": "SELECT c_name AS value FROM customer",
    "csv_roundtrip": "SELECT * FROM documents",
    "format_census": CENSUS,
    "route_lazy": "SELECT *, 'spark' AS kind FROM supplier",
    "route_within": "SELECT * FROM supplier",
    "route_over": "SELECT *, 'pandas_on_spark' AS kind FROM orders",
    "route_forced": f"SELECT 'pandas' AS kind, k AS n_rows FROM ({ORDERS_THAT_FIT})",
    "save_roundtrip": "SELECT * FROM customer",
    "save_append_twice": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "save_partitioned": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "export_roundtrip": "SELECT * FROM lineitem",
    "provision_counts": PROVISION,
    "profile_overview": OVERVIEW,
    "profile_overview_text": OVERVIEW_TEXT,
    "profile_overview_exact": OVERVIEW_TEXT,
    "profile_overview_shuffled": OVERVIEW_TEXT,
    "profile_overview_suspects": OVERVIEW_TEXT,
    "profile_topk_proved": TOP,
    "profile_distinct_whole": DISTINCT_WHOLE,
    "profile_missing": MISSING,
    "profile_numeric": NUMERIC,
    "profile_quantiles": QUANTILE,
    "profile_distinct": DISTINCT,
    "profile_topk": TOP,
    "profile_histogram": HISTOGRAM,
    "profile_correlation": CORRELATION,
    "profile_rank_correlation": RANK_CORRELATION,
    "profile_rank_correlation_joined": RANK_CORRELATION,
    "profile_datetime": DATETIME,
    "pair_bins": PAIR_BINS,
    "profile_report": _report(),
}
