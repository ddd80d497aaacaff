"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

from sparkrecon.plans.pairs import ADDED, KEYS

ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""
ORDERS_DST = f"""SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice,
  o_orderdate, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM ({ORDERS}) WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey + {ADDED}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM ({ORDERS}) WHERE o_orderkey % 13 = 0"""
LINEITEM = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice,
  CAST(l_discount AS DECIMAL(18,2)) AS l_discount, CAST(l_tax AS DECIMAL(18,2)) AS l_tax,
  l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem"""
LINEITEM_DST = f"""SELECT * REPLACE (CAST(CASE WHEN l_partkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END
  AS DECIMAL(18,2)) AS l_quantity) FROM ({LINEITEM}) WHERE (l_orderkey + l_linenumber) % 7 <> 0
UNION ALL SELECT * REPLACE (l_orderkey + {ADDED} AS l_orderkey) FROM ({LINEITEM}) WHERE l_orderkey % 13 = 0"""
CUSTOMER = """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal,
  c_mktsegment FROM customer"""
CUSTOMER_DST = f"""SELECT * REPLACE (
  CAST(CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS DECIMAL(18,2)) AS c_acctbal,
  CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment)
  FROM ({CUSTOMER}) WHERE c_custkey % 10 <> 3
UNION ALL SELECT * REPLACE (c_custkey + {ADDED} AS c_custkey) FROM ({CUSTOMER}) WHERE c_custkey % 20 = 0"""
SUPPLIER = """SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(18,2)) AS s_acctbal FROM supplier"""
SUPPLIER_DST = f"""SELECT * REPLACE (CASE WHEN s_suppkey % 4 = 0 THEN s_name || ' Ltd' ELSE s_name END AS s_name)
  FROM ({SUPPLIER}) WHERE s_suppkey % 9 <> 0"""
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
PART = """SELECT p_partkey, p_name, p_brand, p_type, p_size,
  CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice FROM part"""
PART_DST = f"""SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size)
  FROM ({PART}) WHERE p_partkey % 8 <> 0"""

DEEP = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
  repeat('f(', CAST(c_custkey % 200 + 1 AS INTEGER)) || c_custkey || repeat(')', CAST(c_custkey % 200 + 1 AS INTEGER))
  AS call, c_name FROM customer"""

COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "orders": (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    ),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}
SIDES = {
    "customer": (CUSTOMER, CUSTOMER_DST),
    "lineitem": (LINEITEM, LINEITEM_DST),
    "nation": (NATION, NATION),
    "orders": (ORDERS, ORDERS_DST),
    "part": (PART, PART_DST),
    "supplier": (SUPPLIER, SUPPLIER_DST),
}
BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"


def _equal(names) -> str:
    return " AND ".join(f"s.{c} IS NOT DISTINCT FROM d.{c}" for c in names)


def differing(table: str) -> str:
    """Number of columns that differ between the rows s and d."""
    parts = [f"CAST(s.{c} IS DISTINCT FROM d.{c} AS INTEGER)" for c in COLUMNS[table]]
    return f"{' + '.join(parts)} AS fields"


def _ranked(sql: str, key: str, names, last: bool) -> str:
    """Rows with their rank within the key, ordered by all columns."""
    way = " DESC" if last else ""
    order = ", ".join(f"{c}{way}" for c in names)
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({sql})"
    )


def indexed_rows(table: str, key: str | None = None, keep: str = "") -> str:
    """``(k, status)`` and the columns of both sides as s_*, d_* if asked for."""
    names, (src, dst) = COLUMNS[table], SIDES[table]
    key = key or names[0]
    return f"""SELECT CAST(coalesce(s.{key}, d.{key}) AS VARCHAR) AS key,
  CASE WHEN s.rn IS NULL THEN 'extra' WHEN d.one IS NULL THEN 'missing'
       WHEN {_equal(names)} THEN 'match' ELSE 'different' END AS status {keep}
FROM (SELECT * FROM ({_ranked(src, key, names, True)}) WHERE rn = 1) s
FULL OUTER JOIN (SELECT *, 1 AS one FROM ({dst})) d ON s.{key} = d.{key}"""


def first_match_rows(table: str, key: str | None = None) -> str:
    names, (src, dst) = COLUMNS[table], SIDES[table]
    key = key or names[0]
    return f"""WITH d0 AS ({_ranked(dst, key, names, False)}), s0 AS ({src})
SELECT CAST(s.{key} AS VARCHAR) AS key, CASE WHEN d.rn IS NULL THEN 'missing'
  WHEN {_equal(names)} THEN 'match' ELSE 'different' END AS status
FROM s0 s LEFT JOIN (SELECT * FROM d0 WHERE rn = 1) d ON s.{key} = d.{key}
UNION ALL SELECT CAST({key} AS VARCHAR), 'extra' FROM d0
WHERE rn > 1 OR {key} NOT IN (SELECT {key} FROM s0)"""


def summary(table: str, rows: str, name: str | None = None) -> str:
    src, dst = SIDES[table]
    return f"""SELECT *, different_rows + missing_rows + extra_rows > 0 AS has_differences,
  different_rows + missing_rows + extra_rows = 0 AS success FROM (SELECT '{name or table}' AS "table",
  (SELECT count(*) FROM ({src})) AS rows_in_source, (SELECT count(*) FROM ({dst})) AS rows_in_destination,
  count(*) FILTER (status = 'match') AS matching_rows, count(*) FILTER (status = 'different') AS different_rows,
  count(*) FILTER (status = 'missing') AS missing_rows, count(*) FILTER (status = 'extra') AS extra_rows
  FROM ({rows}))"""


def summaries(tables=tuple(sorted(KEYS))) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({summary(t, indexed_rows(t))})" for t in tables)


def overall(tables=tuple(sorted(KEYS))) -> str:
    return f"""SELECT count(*) AS total_tables, CAST(sum(rows_in_source) AS BIGINT) AS total_rows_source,
  CAST(sum(rows_in_destination) AS BIGINT) AS total_rows_destination,
  CAST(sum(matching_rows) AS BIGINT) AS total_matching_rows,
  CAST(sum(different_rows) AS BIGINT) AS total_different_rows,
  CAST(sum(missing_rows) AS BIGINT) AS total_missing_rows,
  CAST(sum(extra_rows) AS BIGINT) AS total_extra_rows, bool_and(NOT has_differences) AS all_matched,
  round(sum(matching_rows) / sum(rows_in_source) * 100, 1) AS match_percentage
FROM ({summaries(tables)})"""


OVERALL = overall()


def diff_listing(table: str, names=None, source: str | None = None, destination: str | None = None,
                 key: str | None = None) -> str:
    """One row per differing field of keys that are unique on both sides."""
    names = names or COLUMNS[table]
    src, dst = source or SIDES[table][0], destination or SIDES[table][1]
    key = key or names[0]
    return " UNION ALL ".join(
        f"""SELECT CAST(s.{key} AS VARCHAR) AS row_id, '{c}' AS field,
  CAST(s.{c} AS VARCHAR) AS source_value, CAST(d.{c} AS VARCHAR) AS destination_value
FROM ({src}) s JOIN ({dst}) d ON s.{key} = d.{key} WHERE s.{c} IS DISTINCT FROM d.{c}"""
        for c in names
    )


def as_text(sql: str, names) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in names) + f" FROM ({sql})"


def missing_fields(table: str) -> str:
    src, dst = SIDES[table]
    key = COLUMNS[table][0]
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", CAST({key} AS VARCHAR) AS key, '{c}' AS field,
  CAST({c} AS VARCHAR) AS value FROM ({src}) WHERE {key} NOT IN (SELECT {key} FROM ({dst}))"""
        for c in COLUMNS[table]
    )


def unique_key(table: str, names) -> str:
    """First unique column, those with id in their name first."""
    order = [c for c in names if "id" in c] + [c for c in names if "id" not in c]
    picks = " ".join(f"WHEN count(DISTINCT {c}) = count(*) THEN '{c}'" for c in order)
    return f"""SELECT '{table}' AS "table", CASE {picks} END AS primary_key FROM {table}"""


# Tables named by the data: one per three customers, if a side has any of them.
SOURCE_TABLES = """SELECT DISTINCT 'batch_' || c_custkey // 3 AS "table" FROM customer
  WHERE c_acctbal > 5000"""
DESTINATION_TABLES = """SELECT DISTINCT 'batch_' || c_custkey // 3 AS "table" FROM customer
  WHERE c_acctbal < 6000"""


def chunk_content(table: str) -> str:
    pairs = ", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in COLUMNS[table])
    return f"""SELECT '{table}' AS "table", row_number() OVER (ORDER BY {COLUMNS[table][0]}) - 1 AS row_id,
  CAST(json_object({pairs}) AS VARCHAR) AS content FROM ({SIDES[table][0]})"""


CHUNKED = ("customer", "nation", "supplier")
CHUNKS = " UNION ALL ".join(f"SELECT * FROM ({chunk_content(t)})" for t in CHUNKED)

# Value rules of the checked tables, by type and name of the column.
TYPES = {
    "customer": ("numeric", "text", "numeric", "numeric", "text"),
    "orders": ("numeric", "numeric", "text", "numeric", "date", "text"),
    "supplier": ("numeric", "text", "numeric", "numeric"),
}
RULES = {"numeric": "numeric_type", "text": "text_type", "date": "date_format"}


def suite(table: str) -> str:
    src = SIDES[table][0]
    parts = []
    for c, kind in zip(COLUMNS[table], TYPES[table]):
        parts.append(f"""SELECT '{table}' AS "table", '{c}' AS "column", 'column_exists' AS rule""")
        parts.append(
            f"""SELECT '{table}', '{c}', '{RULES[kind]}' WHERE EXISTS
            (SELECT 1 FROM ({src}) WHERE {c} IS NOT NULL)"""
        )
    return " UNION ALL ".join(parts)


# Orders whose dates are partly written the other way round or left out.
CHECKED_ORDERS = f"""SELECT * REPLACE (CASE WHEN o_orderkey % 19 = 0 THEN NULL
  WHEN o_orderkey % 9 = 0 THEN substr(o_orderdate, 9, 2) || '/' || substr(o_orderdate, 6, 2) || '/' || substr(o_orderdate, 1, 4)
  ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice)
  FROM ({ORDERS})"""


def checked(table: str, dst: str, bad: dict[str, str]) -> str:
    parts = []
    for c, kind in zip(COLUMNS[table], TYPES[table]):
        parts.append(
            f"""SELECT '{table}' AS "table", '{c}' AS "column", 'column_exists' AS rule, TRUE AS success,
            CAST(0 AS BIGINT) AS element_count, CAST(0 AS BIGINT) AS missing_count,
            CAST(0 AS BIGINT) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_percent"""
        )
        wrong = bad.get(c, "FALSE")
        parts.append(
            f"""SELECT '{table}', '{c}', '{RULES[kind]}', u = 0, n, n - h, u,
            CASE WHEN h > 0 THEN u / h * 100 ELSE 0 END FROM (SELECT count(*) AS n, count({c}) AS h,
            count(*) FILTER ({c} IS NOT NULL AND ({wrong})) AS u FROM ({dst}))"""
        )
    return " UNION ALL ".join(parts)


VALIDATED = checked(
    "orders",
    CHECKED_ORDERS,
    {
        "o_orderdate": r"NOT regexp_full_match(o_orderdate, '\d{4}-\d{2}-\d{2}')",
        "o_totalprice": "TRY_CAST(o_totalprice AS DOUBLE) IS NULL",
    },
)
COMPARED = f"{VALIDATED} UNION ALL {checked('customer', CUSTOMER_DST, {})}"

STORED = """SELECT 'docs_labels_' || doc_id AS id, 'f' || doc_id % 7 AS file_id, quality AS value FROM labels"""
FRESH_NUMBERED = """SELECT doc_id, 'docs_labels_' || (doc_id + 1) AS id, 'f' || doc_id % 3 AS file_id,
  toxic AS value FROM labels WHERE doc_id % 2 = 0"""
FRESH = f"SELECT * EXCLUDE (doc_id) FROM ({FRESH_NUMBERED})"


def oracle_sql() -> dict[str, str]:
    o_cols = COLUMNS["orders"]
    c_text = as_text(CUSTOMER, COLUMNS["customer"])
    union_dst = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
      CAST(NULL AS VARCHAR) AS o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'n' END AS o_note
      FROM ({ORDERS_DST})"""
    trimmed = f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN chr(9) || c_name || chr(160) || ' '
      WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name,
      CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'None' ELSE c_mktsegment END AS c_mktsegment
      FROM customer"""
    base = """SELECT c_custkey, CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE c_name END AS c_name,
      CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"""
    norm = f"""SELECT CAST(s.c_custkey AS VARCHAR) AS key, CASE WHEN
      trim(s.c_name, {BLANKS}) IS NOT DISTINCT FROM trim(d.c_name, {BLANKS})
      AND trim(s.c_mktsegment, {BLANKS}) IS NOT DISTINCT FROM trim(d.c_mktsegment, {BLANKS})
      THEN 'match' ELSE 'different' END AS status FROM ({base}) s JOIN ({trimmed}) d USING (c_custkey)"""
    literal = f"""SELECT CAST(s.c_custkey AS VARCHAR) AS key, CASE WHEN
      coalesce(s.c_name, 'None') = coalesce(d.c_name, 'None')
      AND coalesce(s.c_mktsegment, 'None') = coalesce(d.c_mktsegment, 'None')
      THEN 'match' ELSE 'different' END AS status FROM ({base}) s JOIN ({trimmed}) d USING (c_custkey)"""
    excluded = f"""SELECT o_orderkey AS record_id, o_orderstatus AS state FROM ({ORDERS})"""
    excluded_dst = f"""SELECT o_orderkey AS record_id, o_orderstatus AS state FROM ({ORDERS_DST})"""
    doc_first = """SELECT text, lang, source, min(doc_id) AS first_id FROM documents
      WHERE doc_id % 3 <> 0 GROUP BY text, lang, source"""
    status_ddl = f"""SELECT "table", CASE WHEN count(DISTINCT side) = 2 THEN 'both'
      WHEN min(side) = 'd' THEN 'destination_only' ELSE 'source_only' END AS status
      FROM (SELECT "table", 's' AS side FROM ({SOURCE_TABLES})
      UNION ALL SELECT "table", 'd' FROM ({DESTINATION_TABLES})) GROUP BY "table" """
    hot = indexed_rows("lineitem", "l_returnflag")
    two_tables = overall(("customer", "supplier"))
    return {
        "recon_indexed_summary": summary("orders", indexed_rows("orders")),
        "recon_indexed_summary_digest": summary("orders", indexed_rows("orders")),
        "recon_first_match_summary": summary("orders", first_match_rows("orders")),
        "recon_indexed_status": indexed_rows("orders"),
        "recon_first_match_status": first_match_rows("orders"),
        "recon_indexed_dupkeys": indexed_rows("lineitem"),
        "recon_first_match_dupkeys": first_match_rows("lineitem"),
        "recon_first_match_dupkeys_summary": summary("lineitem", first_match_rows("lineitem")),
        "recon_indexed_hot_key": summary("lineitem", hot),
        "recon_first_match_hot_key": f"""SELECT status, count(*) AS row_count FROM
          ({first_match_rows("lineitem", "l_returnflag")}) GROUP BY status""",
        "recon_empty_side": f"""SELECT 'orders' AS "table", count(*) AS rows_in_source,
          CAST(0 AS BIGINT) AS rows_in_destination, CAST(0 AS BIGINT) AS matching_rows,
          CAST(0 AS BIGINT) AS different_rows, count(*) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows,
          count(*) > 0 AS has_differences, count(*) = 0 AS success FROM ({ORDERS})""",
        "recon_compat_empty_side": f"""SELECT 'orders' AS "table", count(*) AS rows_in_source,
          CAST(0 AS BIGINT) AS rows_in_destination, CAST(0 AS BIGINT) AS matching_rows,
          CAST(0 AS BIGINT) AS different_rows, CAST(0 AS BIGINT) AS missing_rows,
          CAST(0 AS BIGINT) AS extra_rows, FALSE AS has_differences, TRUE AS success FROM ({ORDERS})""",
        "missing_rows": f"""SELECT {', '.join(o_cols)} FROM ({ORDERS}) WHERE o_orderkey NOT IN
          (SELECT o_orderkey FROM ({ORDERS_DST}))""",
        "extra_rows": f"""SELECT {', '.join(o_cols)} FROM ({ORDERS_DST}) WHERE o_orderkey NOT IN
          (SELECT o_orderkey FROM ({ORDERS}))""",
        "extra_rows_first_match": f"""SELECT key, count(*) AS extra_rows FROM
          ({first_match_rows('lineitem')}) WHERE status = 'extra' GROUP BY key""",
        "field_diff_long": diff_listing("orders"),
        "field_diff_excluded": diff_listing(
            "orders", ("record_id", "state"), excluded, excluded_dst
        ),
        "field_diff_union_columns": diff_listing(
            "orders", (*o_cols, "o_note"),
            f"SELECT *, CAST(NULL AS VARCHAR) AS o_note FROM ({ORDERS})", union_dst,
        ),
        "field_diff_common_columns": diff_listing(
            "orders", tuple(c for c in o_cols if c != "o_orderpriority"), ORDERS, union_dst
        ),
        "norm_trim_null": norm,
        "norm_literal_null": literal,
        "detail_cap_topn": f"""SELECT key, status FROM (SELECT *, row_number() OVER
          (PARTITION BY status ORDER BY key) AS rn FROM ({indexed_rows('orders')})) WHERE rn <= 100""",
        "detail_cap_long": f"""SELECT "table", key, status FROM (SELECT *, row_number() OVER
          (PARTITION BY "table", status ORDER BY key) AS rn FROM
          (SELECT 'customer' AS "table", * FROM ({indexed_rows('customer')})
          UNION ALL SELECT 'supplier', * FROM ({indexed_rows('supplier')}))) WHERE rn <= 20""",
        "missing_listing": f"{missing_fields('customer')} UNION ALL {missing_fields('supplier')}",
        "multi_table_summary": summaries(),
        "multi_table_summary_long": summaries(),
        "multi_table_details_long": f"""SELECT 'customer' AS "table", * FROM ({indexed_rows('customer')})
          UNION ALL SELECT 'supplier', * FROM ({indexed_rows('supplier')})""",
        "overall_rollup": OVERALL,
        "match_percentage": f"""SELECT "table", round(matching_rows / rows_in_source * 100, 1)
          AS match_percentage FROM ({summaries()})""",
        "status_text": f"""SELECT "table" AS table_name, rows_in_source AS source_count,
          rows_in_destination AS destination_count, NOT has_differences AS match, matching_rows,
          different_rows, missing_rows, extra_rows, CASE WHEN NOT has_differences THEN 'Match'
          WHEN different_rows + missing_rows = 0 THEN 'No Match' ELSE concat_ws(', ',
          CASE WHEN different_rows > 0 THEN different_rows || ' different' END,
          CASE WHEN missing_rows > 0 THEN missing_rows || ' missing' END) END AS status_text
          FROM ({summaries()})""",
        "success_flags": f"""SELECT "table", success FROM ({summaries()})""",
        "detect_primary_key": " UNION ALL ".join(
            unique_key(t, c)
            for t, c in {
                "conversations": ("conv_id", "turn", "role", "text"),
                "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
                "labels": ("doc_id", "quality", "toxic"),
                "lineitem": COLUMNS["lineitem"],
                "nation": COLUMNS["nation"],
            }.items()
        ),
        "column_uniqueness": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS n, count({c}) AS non_null,
            count(DISTINCT {c}) AS "distinct" FROM orders""" for c in o_cols
        ),
        "choose_key": " UNION ALL ".join(
            f"""SELECT '{t}' AS "table", '{k}' AS key_column, '{d}' AS display_column
            WHERE EXISTS (SELECT 1 FROM {t})"""
            for t, k, d in (
                ("conversations", "conv_id", "conv_id"),
                ("events", "event_id", "event_id"),
                ("labels", "doc_id", "doc_id"),
                ("orders", "o_orderkey", "o_orderkey"),
            )
        ),
        "match_by_key": """SELECT e.event_id AS row_id, f.first_id AS matched_row_id FROM events e
          JOIN (SELECT user_id, min(event_id) AS first_id FROM events WHERE event_id % 3 <> 0
          GROUP BY user_id) f ON e.user_id = f.user_id""",
        "row_hash_match": f"""SELECT d.doc_id AS row_id, f.first_id AS matched_row_id FROM documents d
          JOIN ({doc_first}) f ON d.text IS NOT DISTINCT FROM f.text AND d.lang IS NOT DISTINCT FROM f.lang
          AND d.source IS NOT DISTINCT FROM f.source""",
        "row_hash_distinct": """SELECT lang, count(*) AS rows_total, count(DISTINCT (text, source)) AS rows_distinct
          FROM documents GROUP BY lang""",
        "list_tables": SOURCE_TABLES,
        "common_tables": f"{SOURCE_TABLES} INTERSECT {DESTINATION_TABLES}",
        "source_only_tables": f"{SOURCE_TABLES} EXCEPT {DESTINATION_TABLES}",
        "destination_only_tables": f"{DESTINATION_TABLES} EXCEPT {SOURCE_TABLES}",
        "table_status": status_ddl,
        "mismatched_tables": f"SELECT * FROM ({status_ddl}) WHERE status <> 'both'",
        "schema_from_filename": """SELECT url, CASE WHEN contains(lower(stem), 'example') THEN 'example'
          WHEN contains(lower(stem), 'item') THEN 'Item' ELSE lower(stem) END AS schema_name FROM
          (SELECT url, regexp_replace(split_part(url, '/', -1), '(.)[.][^.]*$', '\\1') AS stem FROM pages)""",
        "first_values": """SELECT arg_min(l_shipdate_t, (l_orderkey, l_partkey, l_linenumber, l_extendedprice))
            FILTER (l_shipdate_t IS NOT NULL) AS first_date,
          arg_min(q, (l_orderkey, l_partkey, l_linenumber, l_extendedprice)) FILTER (q IS NOT NULL) AS first_quantity
          FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS l_shipdate_t,
          CASE WHEN l_orderkey % 5 = 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS q FROM lineitem)""",
        "ingest_rows": c_text,
        "scan_dump_files": c_text,
        "scan_documents": c_text,
        "scan_mixed_files": """SELECT 'customer' AS "table", 'docx' AS kind, count(*) AS row_count FROM customer
          UNION ALL SELECT 'supplier', 'txt', count(*) FROM supplier""",
        "scan_dump_statements": c_text,
        "ingest_quoted_text": f"""SELECT CAST(page_id AS VARCHAR) AS page_id, trim(url, {BLANKS}) AS url,
          trim(html, {BLANKS}) AS html FROM pages""",
        "ingest_long_text": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
          trim(text, {BLANKS}) AS text FROM documents""",
        "scan_dump_quoted": f"""SELECT CAST(page_id AS VARCHAR) AS page_id, trim(url, {BLANKS}) AS url,
          trim(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {BLANKS}) AS html FROM pages""",
        "ingest_deep_nesting": DEEP,
        "ingest_deep_nesting_historic": DEEP,
        "run_rejects": """SELECT s AS "schema", 'customer' AS "table",
          CASE WHEN k % 3 = 0 THEN 'arity_mismatch' ELSE 'unclosed_tuple' END AS reason,
          CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS tuple,
          'INSERT INTO ' || s || '.customer (c_custkey, c_name) VALUES ' || good || ', ' ||
          CASE WHEN k % 3 = 0 THEN '(' || name || '), ' || good
            ELSE good || ', (((' || k || '), ' || name END || ';' AS statement
          FROM (SELECT c_custkey AS k, '''' || replace(c_name, '''', '''''') || '''' AS name,
            '(' || k || ', ' || name || ')' AS good FROM customer WHERE c_custkey % 3 <> 1),
          (VALUES ('one'), ('two')) AS v(s)""",
        "ingest_statement_targets": """SELECT 'customer' AS "table", 'crm' AS "schema", count(*) AS statements
          FROM (SELECT DISTINCT c_custkey // 20 FROM customer) UNION ALL SELECT 'supplier', 'dump',
          count(*) FROM (SELECT DISTINCT s_suppkey // 20 FROM supplier)""",
        "ingest_rejects": """SELECT reason, count(*) AS row_count FROM (SELECT CASE
          WHEN c_custkey % 10 = 0 THEN 'arity_mismatch' WHEN c_custkey % 10 = 1 THEN 'no_target'
          WHEN c_custkey % 10 = 2 THEN 'no_values' ELSE 'ok' END AS reason FROM customer)
          WHERE reason <> 'ok' GROUP BY reason""",
        "ingest_default_columns": """SELECT CAST(s_suppkey AS VARCHAR) AS column_1, s_name AS column_2,
          CAST(s_nationkey AS VARCHAR) AS column_3 FROM supplier""",
        "ingest_conform_columns": """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name,
          CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS s_nationkey
          FROM supplier""",
        "ingest_row_counts": """SELECT 'crm' AS "schema", 'customer' AS "table", count(*) AS row_count FROM customer
          UNION ALL SELECT 'dump', 'supplier', count(*) FROM supplier""",
        "ingest_then_reconcile": summaries(("customer", "supplier")),
        "infer_suite": f"{suite('orders')} UNION ALL {suite('customer')}",
        "infer_suite_long": " UNION ALL ".join(
            f"""SELECT '{t}' AS "table", '{c}' AS "column", '{r}' AS rule WHERE EXISTS
            (SELECT 1 FROM ({SIDES[t][0]}) WHERE {c} IS NOT NULL)"""
            for t in ("orders", "supplier") for c in COLUMNS[t]
            for r in ("column_exists", "date_format" if c.endswith("date") else "text_type")
        ),
        "validate_suite": VALIDATED,
        "compare_suite": COMPARED,
        "compare_suite_long": checked(
            "orders",
            CHECKED_ORDERS,
            {"o_orderdate": r"NOT regexp_full_match(o_orderdate, '\d{4}-\d{2}-\d{2}')"},
        ).replace("numeric_type", "text_type"),
        "suite_statistics": f"""SELECT "table", bool_and(success) AS success, count(*) AS evaluated_expectations,
          count(*) FILTER (success) AS successful_expectations,
          count(*) FILTER (NOT success) AS unsuccessful_expectations,
          count(*) FILTER (success) / count(*) * 100 AS success_percent FROM ({COMPARED}) GROUP BY "table" """,
        "chunk_rows": CHUNKS,
        "chunk_ids": f"""SELECT 'tpch_' || "table" || '_' || row_id AS id FROM ({CHUNKS})""",
        "chunk_counts": f"SELECT 'tpch' AS schema, count(*) AS chunk_count FROM ({CHUNKS})",
        "chunk_positions": """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id,
          row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS type_row_id FROM events""",
        "chunk_upsert_by_file": f"""WITH kept AS (SELECT * FROM ({STORED}) WHERE file_id NOT IN
          (SELECT file_id FROM ({FRESH}))) SELECT * FROM kept UNION ALL SELECT * FROM ({FRESH})
          WHERE id NOT IN (SELECT id FROM kept)""",
        "chunk_append_new": f"""SELECT * FROM ({FRESH}) WHERE id NOT IN (SELECT id FROM ({STORED}))""",
        "chunk_store": f"""WITH new AS (SELECT * EXCLUDE (doc_id) REPLACE (CASE WHEN doc_id % 8 = 0 THEN NULL
          ELSE file_id END AS file_id) FROM ({FRESH_NUMBERED})), kept AS (SELECT * FROM ({STORED})
          WHERE file_id NOT IN (SELECT file_id FROM new WHERE file_id IS NOT NULL))
          SELECT 'first' AS state, * FROM ({STORED}) UNION ALL SELECT 'last', * FROM kept
          UNION ALL SELECT 'last', * FROM new WHERE id NOT IN (SELECT id FROM kept)""",
        # A vector has length one if the text holds a letter, digit or sign of words, else zero.
        "embed_rows": """SELECT doc_id, 256 AS size, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]')
          THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
        "report_catalog": f"""SELECT id AS report_id, ts AS "timestamp", 'one' AS source_schema,
          'two' AS destination_schema, total_tables AS tables_compared, total_rows_source AS total_rows,
          total_matching_rows AS matching_rows, total_different_rows AS different_rows,
          total_missing_rows AS missing_rows, match_percentage FROM ({OVERALL}),
          (VALUES ('20240101_000000', '2024-01-01T00:00:00'), ('20240202_000000', '2024-02-02T00:00:00')) v(id, ts)""",
        "report_lookup": f"""SELECT '20240202_000000' AS report_id, '2024-02-02T00:00:00' AS "timestamp",
          * EXCLUDE (match_percentage) FROM ({OVERALL})""",
        "report_documents": f"""SELECT "table", success, rows_in_source,
          least(matching_rows, 25) AS matching_rows, least(different_rows, 25) AS different_rows,
          least(missing_rows, 25) AS missing_rows, least(extra_rows, 25) AS extra_rows
          FROM ({summaries(("customer", "supplier"))})""",
        "run_direct": two_tables,
        "run_document": two_tables,
        "run_file_lists": summaries(),
        "run_chunks": " UNION ALL ".join(
            f"""SELECT '{schema}' AS "schema", '{t}' AS "table", count(*) AS chunk_count, count(*) AS ids,
            count(*) - 1 AS last_row_id FROM ({SIDES[t][i]}) HAVING count(*) > 0"""
            for t in sorted(KEYS) for i, schema in enumerate(("one", "two"))
        ),
        "report_details": " UNION ALL ".join(
            f"""SELECT '{t}' AS "table", status, key, CASE WHEN status = 'different' THEN fields ELSE 0 END AS fields
            FROM ({indexed_rows(t, keep=", " + differing(t))})""" for t in sorted(KEYS)
        ),
    }
