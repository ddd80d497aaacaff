"""The registered queries: each operator over the given tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.functions.text import schema_from_filename
from sparkrecon.operators import catalog, chunks, expectations, keys, match, rollup
from sparkrecon.operators.reconcile import (
    reconcile,
    reconcile_rows,
    reconcile_rows_summary,
    reconcile_summary,
    reconcile_tables,
)
from sparkrecon.operators.skew import union_all
from sparkrecon.operators.stage import freed_shuffles, stage_folder, staged
from sparkrecon.operators.tables import (
    conform_columns,
    long_form,
    to_rows,
    to_table,
    where_table,
)
from sparkrecon.options import FIRST_MATCH, IngestOptions, ReconOptions, RunOptions
from sparkrecon.plans import pairs
from sparkrecon.plans.validation import reconcile_inserts, run
from sparkrecon.sources.dumps import (
    ingest_directory,
    ingest_files,
    inserts,
    parse_statements,
    rejects,
    statements_of_text,
)
from sparkrecon.sources.reports import ReportStore, overall_document, table_documents

Query = Callable[[SparkSession, str], DataFrame]

FIRST = ReconOptions(mode=FIRST_MATCH)
# Treat the most frequent keys as hot whatever their number of rows.
FORCED = ReconOptions(skew="always", skew_min_rows=1)
FORCED_FIRST = ReconOptions(mode=FIRST_MATCH, skew="always", skew_min_rows=1)


# --------------------------------------------------------------------------- reconcile


def _orders(spark, sf):
    src = pairs.orders(spark, sf)
    return src, pairs.orders_dst(src)


def _lineitem(spark, sf):
    src = pairs.lineitem(spark, sf)
    return src, pairs.lineitem_dst(src)


def recon_indexed_summary(spark, sf):
    return reconcile_summary(*_orders(spark, sf), "orders", "o_orderkey")


def recon_indexed_summary_digest(spark, sf):
    return reconcile_summary(
        *_orders(spark, sf), "orders", "o_orderkey", ["o_orderkey"], compare="digest"
    )


def recon_first_match_summary(spark, sf):
    return reconcile_summary(*_orders(spark, sf), "orders", "o_orderkey", options=FIRST)


def recon_indexed_status(spark, sf):
    return reconcile(*_orders(spark, sf), "o_orderkey").select("key", "status")


def recon_first_match_status(spark, sf):
    return reconcile(*_orders(spark, sf), "o_orderkey", options=FIRST).select("key", "status")


def recon_indexed_dupkeys(spark, sf):
    return reconcile(*_lineitem(spark, sf), "l_orderkey").select("key", "status")


def recon_first_match_dupkeys(spark, sf):
    return reconcile(*_lineitem(spark, sf), "l_orderkey", options=FIRST).select("key", "status")


def recon_first_match_dupkeys_summary(spark, sf):
    return reconcile_summary(*_lineitem(spark, sf), "lineitem", "l_orderkey", options=FIRST)


def recon_indexed_hot_key(spark, sf):
    """Every key holds about a third of the rows."""
    return reconcile_summary(*_lineitem(spark, sf), "lineitem", "l_returnflag", options=FORCED)


def recon_first_match_hot_key(spark, sf):
    details = reconcile(*_lineitem(spark, sf), "l_returnflag", options=FORCED_FIRST)
    return details.groupBy("status").agg(F.count("*").alias("row_count"))


def _plain_rows(details: DataFrame, side: str, like: DataFrame) -> DataFrame:
    return details.select(
        *[F.try_element_at(side, F.lit(c)).cast(t).alias(c) for c, t in like.dtypes]
    )


def recon_empty_side(spark, sf):
    src = pairs.orders(spark, sf)
    return reconcile_summary(src, src.where("o_orderkey < 0"), "orders", "o_orderkey")


def recon_compat_empty_side(spark, sf):
    src = pairs.orders(spark, sf)
    options = ReconOptions(compat_empty_side=True)
    none = src.where("o_orderkey < 0")
    return reconcile_summary(src, none, "orders", "o_orderkey", options=options)


def missing_rows(spark, sf):
    src, dst = _orders(spark, sf)
    details = reconcile(src, dst, "o_orderkey").where("status = 'missing'")
    return _plain_rows(details, "source_row", src)


def extra_rows(spark, sf):
    src, dst = _orders(spark, sf)
    details = reconcile(src, dst, "o_orderkey").where("status = 'extra'")
    return _plain_rows(details, "destination_row", src)


def extra_rows_first_match(spark, sf):
    details = reconcile(*_lineitem(spark, sf), "l_orderkey", options=FIRST)
    extra = details.where("status = 'extra'")
    return extra.groupBy("key").agg(F.count("*").alias("extra_rows"))


def field_diff_long(spark, sf):
    return rollup.diff_listing(reconcile(*_orders(spark, sf), "o_orderkey"))


def field_diff_excluded(spark, sf):
    """The same person under two names: neither field is compared."""
    def side(df: DataFrame, person: str, shift: int) -> DataFrame:
        return df.select(
            F.col("o_orderkey").alias("record_id"),
            (F.col("o_custkey") + shift).alias(person),
            F.col("o_orderstatus").alias("state"),
        )

    src, dst = _orders(spark, sf)
    return rollup.diff_listing(
        reconcile(side(src, "employee_id", 0), side(dst, "contractor_id", 5), "record_id")
    )


def _other_columns(spark, sf):
    src, dst = _orders(spark, sf)
    note = F.when(F.col("o_orderkey") % 4 == 0, "n")
    return src, dst.drop("o_orderpriority").withColumn("o_note", note)


def field_diff_union_columns(spark, sf):
    return rollup.diff_listing(reconcile(*_other_columns(spark, sf), "o_orderkey"))


def field_diff_common_columns(spark, sf):
    details = reconcile(*_other_columns(spark, sf), "o_orderkey", options=FIRST)
    return rollup.diff_listing(details)


def _padded(spark, sf):
    k = F.col("c_custkey")
    customer = pairs.customer(spark, sf)
    base = customer.select(
        k,
        F.when(k % 25 != 0, F.col("c_name")).alias("c_name"),
        F.when(k % 14 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    padded = customer.select(
        k,
        F.when(k % 3 == 0, F.concat(F.lit("\t"), F.col("c_name"), F.lit("\xa0 ")))
        .when(k % 5 != 0, F.col("c_name"))
        .alias("c_name"),
        F.when(k % 4 == 0, None)
        .when(k % 7 == 0, F.lit("None"))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )
    return base, padded


def norm_trim_null(spark, sf):
    return reconcile(*_padded(spark, sf), "c_custkey").select("key", "status")


def norm_literal_null(spark, sf):
    return reconcile(*_padded(spark, sf), "c_custkey", options=FIRST).select("key", "status")


def detail_cap_topn(spark, sf):
    return reconcile(*_orders(spark, sf), "o_orderkey", limit=100).select("key", "status")


def detail_cap_long(spark, sf):
    details = reconcile_rows(*_long_sides(spark, sf, ("customer", "supplier")))
    return rollup.cap_details(details, 20).select("table", "key", "status")


# --------------------------------------------------------------------------- many tables


def _long_sides(spark, sf, names: Sequence[str] | None = None):
    sides: list[list[DataFrame]] = [[], []]
    for name, both in pairs.typed_tables(spark, sf).items():
        if names is None or name in names:
            for side, df in zip(sides, both):
                long = long_form(df, name, [pairs.KEYS[name]], "tpch")
                side.append(long.withColumn("key_column", F.lit(pairs.KEYS[name])))
    return union_all(sides[0]), union_all(sides[1])


def _summary(spark, sf):
    return reconcile_tables(pairs.typed_tables(spark, sf), pairs.KEYS)


def multi_table_summary_long(spark, sf):
    return reconcile_rows_summary(*_long_sides(spark, sf))


def multi_table_details_long(spark, sf):
    details = reconcile_rows(*_long_sides(spark, sf, ("customer", "supplier")))
    return details.select("table", "key", "status")


def missing_listing(spark, sf):
    return rollup.missing_listing(
        reconcile_rows(*_long_sides(spark, sf, ("customer", "supplier")))
    )


def overall_rollup(spark, sf):
    return rollup.overall(_summary(spark, sf))


def match_percentage(spark, sf):
    return rollup.with_match_percentage(_summary(spark, sf)).select("table", "match_percentage")


def status_text(spark, sf):
    return rollup.result_listing(_summary(spark, sf))


def success_flags(spark, sf):
    return _summary(spark, sf).select("table", "success")


# --------------------------------------------------------------------------- keys, matches


def detect_primary_key(spark, sf):
    frames = {
        "conversations": pairs.load(spark, sf, "conversations"),
        "events": pairs.load(spark, sf, "events"),
        "labels": pairs.load(spark, sf, "labels"),
        "lineitem": pairs.lineitem(spark, sf),
        "nation": pairs.nation(spark, sf),
    }
    return keys.detect_primary_keys(frames)


def column_uniqueness(spark, sf):
    return keys.uniqueness(pairs.orders(spark, sf))


def choose_key(spark, sf):
    frames = {
        "conversations": ("conversations", ["conv_id", "turn"]),
        "events": ("events", ["event_id"]),
        "labels": ("labels", ["doc_id"]),
        "orders": ("orders", ["o_orderkey"]),
    }
    rows = union_all(
        [
            long_form(pairs.load(spark, sf, name), table, order)
            for table, (name, order) in frames.items()
        ]
    )
    chosen = keys.table_keys(rows, rows).select("table", "key_column")
    shown = keys.first_fields(rows, "fields").select(
        "table", keys.display_key_of(F.col("fields")).alias("display_column")
    )
    return chosen.join(shown, "table")


def match_by_key(spark, sf):
    events = pairs.load(spark, sf, "events").select("event_id", "user_id")
    known = events.where(F.col("event_id") % 3 != 0)
    return match.match_rows(events, known, "event_id", "user_id", FORCED)


def row_hash_match(spark, sf):
    documents = pairs.load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    known = documents.where(F.col("doc_id") % 3 != 0)
    return match.match_rows(documents, known, "doc_id")


def row_hash_distinct(spark, sf):
    documents = pairs.load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    hashed = match.with_row_hash(documents, ("doc_id",))
    copies = hashed.groupBy("lang", "row_hash").agg(F.count("*").alias("n"))
    return copies.groupBy("lang").agg(
        F.sum("n").alias("rows_total"), F.count("*").alias("rows_distinct")
    )


# --------------------------------------------------------------------------- catalog


def _catalog_sides(spark, sf):
    """Parsed dumps of two sides, a statement per customer into a table per three
    customers: which tables a side has depends on the balances."""

    def side(schema, wanted):
        text = F.format_string(
            f"INSERT INTO {schema}.batch_%d (c_custkey, c_name) VALUES (%d, '%s');",
            F.expr("c_custkey div 3"), "c_custkey", "c_name",
        )
        rows = pairs.load(spark, sf, "customer").where(wanted)
        dumps = rows.select(F.lit(f"{schema}.sql").alias("path"), text.alias("content"))
        return inserts(parse_statements(statements_of_text(dumps)))

    return side("one", "c_acctbal > 5000"), side("two", "c_acctbal < 6000")


def list_tables(spark, sf):
    return catalog.list_tables(_catalog_sides(spark, sf)[0])


def common_tables(spark, sf):
    return catalog.common_tables(*_catalog_sides(spark, sf))


def source_only_tables(spark, sf):
    return catalog.only_tables(*_catalog_sides(spark, sf))


def destination_only_tables(spark, sf):
    return catalog.only_tables(*reversed(_catalog_sides(spark, sf)))


def table_status(spark, sf):
    return catalog.table_status(*_catalog_sides(spark, sf))


def mismatched_tables(spark, sf):
    return catalog.mismatched_tables(*_catalog_sides(spark, sf))


def schema_names(spark, sf):
    return pairs.load(spark, sf, "pages").select(
        "url", schema_from_filename(F.col("url"), ["example", "Item"]).alias("schema_name")
    )


def first_values(spark, sf):
    rows = pairs.lineitem(spark, sf)
    k = F.col("l_orderkey")
    held = rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
        F.when(k % 3 == 0, F.col("l_shipdate")).alias("first_date"),
        F.when(k % 5 == 0, F.col("l_quantity").cast("string")).alias("first_quantity"),
    )
    order = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    return expectations.first_values(held, order).select("first_date", "first_quantity")


# --------------------------------------------------------------------------- ingest


def _quoted(value: Column, quote: str = "'") -> Column:
    text = F.replace(value.cast("string"), F.lit(quote), F.lit(quote * 2))
    return F.coalesce(F.concat(F.lit(quote), text, F.lit(quote)), F.lit("NULL"))


def _tuple(columns: Sequence[Column]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *columns), F.lit(")"))


def _dump(df: DataFrame, target: str, key: str, names: Sequence[str] = (), quote: str = "'",
          per_statement: int = 20, per_file: int = 500, file: str = "dump.sql",
          bare: Sequence[str] = ()) -> DataFrame:
    """Rows as INSERT statements of 20 rows in texts of 500: groups of a fixed
    size, whatever the size of the table. Columns in ``bare`` are written as they are."""
    heading = f" ({', '.join(names)})" if names else ""
    rows = df.select(
        F.floor(F.col(key) / per_file).alias("f"),
        F.floor(F.col(key) / per_statement).alias("g"),
        F.struct(
            F.col(key).alias("k"),
            _tuple([F.col(c) if c in bare else _quoted(F.col(c), quote) for c in df.columns]).alias("t"),
        ).alias("r"),
    )
    grouped = rows.groupBy("f", "g").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    statement = F.concat(
        F.lit(f"INSERT INTO {target}{heading} VALUES\n"),
        F.concat_ws(",\n", F.transform("rs", lambda r: r["t"])),
        F.lit(";\n"),
    )
    files = grouped.groupBy("f").agg(
        F.sort_array(F.collect_list(F.struct("g", statement.alias("s")))).alias("ss")
    )
    path = F.concat(F.lit("/dumps/"), F.col("f").cast("string"), F.lit(f"/{file}"))
    return files.select(
        path.alias("path"),
        F.concat(F.lit("-- dump\n"), F.concat_ws("", F.transform("ss", lambda s: s["s"]))).alias("content"),
    )


def _parse(texts: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    return parse_statements(statements_of_text(texts, options=options), options)


def ingest_rows(spark, sf):
    df = pairs.customer(spark, sf)
    rows = to_rows(inserts(_parse(_dump(df, "crm.customer", "c_custkey", df.columns))))
    return to_table(where_table(rows, "customer"), df.columns)


STANDARD_SQL = IngestOptions(quote_aware=True, backslash_escapes=False)


def ingest_quoted_text(spark, sf):
    """Whole web pages with quotes, parentheses, commas and semicolons."""
    df = pairs.load(spark, sf, "pages").select("page_id", "url", "html")
    texts = _dump(df, "web.pages", "page_id", df.columns, quote='"')
    return to_table(to_rows(inserts(_parse(texts, STANDARD_SQL))), df.columns)


def ingest_long_text(spark, sf):
    df = pairs.load(spark, sf, "documents").select("doc_id", "lang", "text")
    texts = _dump(df, "web.documents", "doc_id", df.columns)
    return to_table(to_rows(inserts(_parse(texts, STANDARD_SQL))), df.columns)


def _deep(spark, sf, options: IngestOptions) -> DataFrame:
    """Calls nested 1 to 200 deep, a value of every customer."""
    depth = (F.col("c_custkey") % 200 + 1).cast("int")
    call = F.concat(F.repeat(F.lit("f("), depth), F.col("c_custkey").cast("string"), F.repeat(F.lit(")"), depth))
    df = pairs.customer(spark, sf).select("c_custkey", call.alias("call"), "c_name")
    texts = _dump(df, "crm.calls", "c_custkey", df.columns, bare=["call"])
    return to_table(to_rows(inserts(_parse(texts, options))), df.columns)


def ingest_deep_nesting(spark, sf):
    return _deep(spark, sf, IngestOptions())


def ingest_deep_nesting_historic(spark, sf):
    # A tuple that begins on a line of its own, as in the dumps here, is read in either way.
    return _deep(spark, sf, IngestOptions.historic())


def _two_dumps(spark, sf) -> DataFrame:
    customer, supplier = pairs.customer(spark, sf), pairs.supplier(spark, sf)
    return _dump(customer, "crm.customer", "c_custkey", customer.columns).unionByName(
        _dump(supplier, "supplier", "s_suppkey", supplier.columns, file="dump.v1.sql")
    )


def ingest_statement_targets(spark, sf):
    rows = inserts(_parse(_two_dumps(spark, sf)))
    statements = rows.select("schema", "table", "ord.path", "ord.stmt").distinct()
    return statements.groupBy("schema", "table").agg(F.count("*").alias("statements"))


def ingest_rejects(spark, sf):
    """One statement per customer, some of them broken."""
    kind = F.col("c_custkey") % 10
    name = _quoted(F.col("c_name"))
    key = F.col("c_custkey").cast("string")
    statement = (
        F.when(kind == 0, F.concat(F.lit("INSERT INTO c (a, b) VALUES ("), name, F.lit(");")))
        .when(kind == 1, F.concat(F.lit("INSERT INTO `c` VALUES ("), name, F.lit(");")))
        .when(kind == 2, F.concat(F.lit("insert into c (a) SELECT "), name, F.lit(";")))
        .otherwise(F.concat(F.lit("INSERT INTO c VALUES ("), key, F.lit(", "), name, F.lit(");")))
    )
    texts = pairs.customer(spark, sf).select(
        F.concat(F.lit("/dumps/"), key, F.lit(".sql")).alias("path"), statement.alias("content")
    )
    return rejects(_parse(texts)).groupBy("reason").agg(F.count("*").alias("row_count"))


def ingest_default_columns(spark, sf):
    df = pairs.supplier(spark, sf).drop("s_acctbal")
    parsed = inserts(_parse(_dump(df, "supplier", "s_suppkey")))
    return to_table(to_rows(parsed), ["column_1", "column_2", "column_3"])


def ingest_conform_columns(spark, sf):
    """Two column lists for one table: the longer one holds for all rows."""
    df = pairs.supplier(spark, sf).drop("s_acctbal")
    short = F.col("s_suppkey") % 4 == 0
    few = df.where(short).drop("s_nationkey")
    texts = _dump(df.where(~short), "supplier", "s_suppkey", df.columns).unionByName(
        _dump(few, "supplier", "s_suppkey", few.columns, file="dump.short.sql")
    )
    conformed = conform_columns(staged(inserts(_parse(texts))))
    return to_table(to_rows(conformed), df.columns)


def ingest_row_counts(spark, sf):
    return rollup.row_counts(inserts(_parse(_two_dumps(spark, sf))))


def ingest_then_reconcile(spark, sf):
    """Two schemas of dumps in, summaries of their tables out."""
    def dumps(which: int) -> DataFrame:
        tables = pairs.typed_tables(spark, sf)
        texts = []
        for name in ("customer", "supplier"):
            df = tables[name][which]
            texts.append(_dump(df, name, pairs.KEYS[name], df.columns, file=f"side{which}.sql"))
        return staged(inserts(_parse(union_all(texts))))

    return reconcile_inserts(dumps(0), dumps(1))[0]


def _written(spark: SparkSession, texts: DataFrame) -> str:
    """Dump files below a new folder."""
    folder = f"{stage_folder(spark)}/dumps-{uuid.uuid4()}"
    texts.select("content").write.text(folder)
    return folder


def _scanned(spark, sf, options: IngestOptions) -> DataFrame:
    df = pairs.customer(spark, sf)
    folder = _written(spark, _dump(df, "crm.customer", "c_custkey", df.columns))
    return to_table(to_rows(ingest_directory(spark, folder, options)), df.columns)


def _written_documents(spark: SparkSession, texts: DataFrame) -> str:
    """Word documents below a new folder, one per text and a paragraph per line; a task
    that is repeated writes the same files again."""
    folder = f"{stage_folder(spark)}/documents-{uuid.uuid4()}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage, top = fs.FileSystem.from_uri(folder)
        storage.create_dir(top, recursive=True)
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                body = "".join(
                    f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
                    for line in content.split("\n")
                )
                payload = io.BytesIO()
                with zipfile.ZipFile(payload, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(
                        "word/document.xml",
                        f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>',
                    )
                name = path.strip("/").replace("/", "-").removesuffix(".sql")
                with storage.open_output_stream(f"{top}/{name}.docx") as out:
                    out.write(payload.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    texts.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def scan_documents(spark, sf):
    """Word documents with dumps of a table in, the table out."""
    df = pairs.customer(spark, sf)
    folder = _written_documents(spark, _dump(df, "crm.customer", "c_custkey", df.columns))
    return to_table(to_rows(ingest_directory(spark, folder)), df.columns)


def scan_mixed_files(spark, sf):
    """Documents and text dumps in one list of files, told apart by their endings; rows
    of each kind by table and dialect of the file."""
    customer, supplier = pairs.customer(spark, sf), pairs.supplier(spark, sf)
    folders = (
        _written_documents(spark, _dump(customer, "crm.customer", "c_custkey", customer.columns)),
        _written(spark, _dump(supplier, "crm.supplier", "s_suppkey", supplier.columns)),
    )
    files = [f for folder in folders for f in spark.read.format("binaryFile").load(folder).inputFiles()]
    rows = ingest_files(spark, files)
    kind = F.regexp_extract("ord.path", r"\.(\w+)$", 1).alias("kind")
    return rows.groupBy("table", kind).agg(F.count("*").alias("row_count"))


def scan_dump_files(spark, sf):
    return _scanned(spark, sf, IngestOptions())


def scan_dump_statements(spark, sf):
    return _scanned(spark, sf, IngestOptions(split="statement"))


def scan_dump_quoted(spark, sf):
    """Web pages with semicolons and line ends in literals, from files read in blocks."""
    df = pairs.load(spark, sf, "pages").select("page_id", "url", "html")
    folder = _written(spark, _dump(df, "web.pages", "page_id", df.columns))
    options = replace(STANDARD_SQL, split="statement")
    return to_table(to_rows(ingest_directory(spark, folder, options)), df.columns)


def _run_dumps(spark, sf, which: int, schema: str, names=("customer", "supplier")) -> DataFrame:
    texts = []
    for name, both in pairs.typed_tables(spark, sf).items():
        if name in names:
            df = both[which]
            texts.append(_dump(df, f"{schema}.{name}", pairs.KEYS[name], df.columns))
    return union_all(texts)


def run_direct(spark, sf):
    """Two folders of dumps in, totals of the indexed comparison out."""
    folders = {s: _written(spark, _run_dumps(spark, sf, i, s)) for i, s in enumerate(("one", "two"))}
    options = RunOptions(
        schemas=("one", "two"), schema_paths=folders, use_direct_comparison=True,
        run_expectations=False,
    )
    return run(spark, options).overall


def run_file_lists(spark, sf):
    """Two lists of files with the dumps of five tables in, a summary per table out."""
    files = [
        tuple(spark.read.text(_written(spark, _run_dumps(spark, sf, i, s, pairs.KEYS))).inputFiles())
        for i, s in enumerate(("one", "two"))
    ]
    options = RunOptions(
        schemas=("one", "two"), source_files=files[0], dest_files=files[1],
        use_direct_comparison=True, run_expectations=False,
    )
    return run(spark, options).summary


def _whole_run(spark, sf) -> tuple[RunOptions, str]:
    """A run over nested folders of five tables: rules, chunk store and report."""
    top = f"{stage_folder(spark)}/run-{uuid.uuid4()}"
    for i, schema in enumerate(("one", "two")):
        texts = _run_dumps(spark, sf, i, schema, pairs.KEYS)
        folder = F.regexp_extract("content", rf"INTO {schema}\.(\w+)", 1).alias("dump")
        with freed_shuffles(spark):
            texts.select("content", folder).write.partitionBy("dump").text(f"{top}/dumps/{schema}")
    options = RunOptions(
        schemas=("one", "two"), data_directory=f"{top}/dumps", use_direct_comparison=True,
        report_directory=f"{top}/reports", chunk_store=f"{top}/chunks",
    )
    return options, run(spark, options).report_id


def report_details(spark, sf):
    """The detail rows of a whole run over five tables, read back from its report."""
    options, report_id = _whole_run(spark, sf)
    rows = ReportStore(spark, options.report_directory).details(report_id)
    return rows.select(
        "table", "status", "key", F.coalesce(F.size("differences"), F.lit(0)).alias("fields")
    )


def run_chunks(spark, sf):
    """The chunks that a whole run over five tables has stored, counted by table."""
    options, _ = _whole_run(spark, sf)
    held = chunks.ChunkStore(spark, options.chunk_store).read()
    return held.groupBy("metadata.schema", "metadata.table").agg(
        F.count("*").alias("chunk_count"), F.count_distinct("id").alias("ids"),
        F.max("metadata.row_id").alias("last_row_id"),
    )


def _faulty(spark, sf, schema: str) -> DataFrame:
    """A statement for each customer of three tuples, the second or the last broken."""
    key, name = F.col("c_custkey").cast("string"), _quoted(F.col("c_name"))
    good = F.concat(F.lit("("), key, F.lit(", "), name, F.lit(")"))
    kind = F.col("c_custkey") % 3
    broken = F.when(kind == 0, F.concat(F.lit("("), name, F.lit(")"))).when(kind == 1, good)
    last = F.when(kind == 2, F.concat(F.lit("((("), key, F.lit("), "), name)).otherwise(good)
    broken = F.coalesce(broken, good)
    text = F.concat(
        F.lit(f"INSERT INTO {schema}.customer (c_custkey, c_name) VALUES "),
        F.concat_ws(", ", good, broken, last), F.lit(";"),
    )
    return pairs.customer(spark, sf).select(text.alias("content"))


def run_rejects(spark, sf):
    """The rejects of a run with the whole statements they come from."""
    folders = {s: _written(spark, _faulty(spark, sf, s)) for s in ("one", "two")}
    result = run(spark, RunOptions(
        schemas=("one", "two"), schema_paths=folders, use_direct_comparison=True,
        run_expectations=False,
    ))
    found = result.rejects.join(result.rejected_statements, ["path", "block", "stmt"])
    return found.select("schema", "table", "reason", "tuple", "statement")


def run_document(spark, sf):
    """One folder with the dumps of two schemas in, totals out."""
    texts = _run_dumps(spark, sf, 0, "one").unionByName(_run_dumps(spark, sf, 1, "two"))
    options = RunOptions(
        schemas=("one", "two"), data_directory=_written(spark, texts), run_expectations=False
    )
    return run(spark, options).overall


# --------------------------------------------------------------------------- expectations


def _checked_orders(spark, sf) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    turned = F.concat_ws("/", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4))
    price = F.when(k % 23 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return pairs.orders(spark, sf).withColumns(
        {
            "o_orderdate": F.when(k % 19 == 0, None).when(k % 9 == 0, turned).otherwise(day),
            "o_totalprice": price,
        }
    )


def infer_suite(spark, sf):
    return expectations.infer_suite(pairs.orders(spark, sf), "orders").unionByName(
        expectations.infer_suite(pairs.customer(spark, sf), "customer")
    )


def infer_suite_long(spark, sf):
    return expectations.infer_suite_rows(_long_sides(spark, sf, ("orders", "supplier"))[0])


def validate_suite(spark, sf):
    suite = expectations.infer_suite(pairs.orders(spark, sf), "orders")
    return expectations.validate(_checked_orders(spark, sf), suite, "orders")


def compare_suite(spark, sf):
    customer = pairs.customer(spark, sf)
    return expectations.compare_tables(
        {
            "orders": (pairs.orders(spark, sf), _checked_orders(spark, sf)),
            "customer": (customer, pairs.customer_dst(customer)),
        }
    )


def compare_suite_long(spark, sf):
    source = long_form(pairs.orders(spark, sf), "orders", ["o_orderkey"])
    return expectations.compare_rows(
        source, long_form(_checked_orders(spark, sf), "orders", ["o_orderkey"])
    )


def suite_statistics(spark, sf):
    return expectations.statistics(compare_suite(spark, sf))


# --------------------------------------------------------------------------- chunks


def _chunks(spark, sf) -> DataFrame:
    source, _ = _long_sides(spark, sf, ("customer", "nation", "supplier"))
    return chunks.rows_to_chunks(source.drop("key_column"))


def chunk_rows(spark, sf):
    return _chunks(spark, sf).select("metadata.table", "metadata.row_id", "content")


def chunk_ids(spark, sf):
    return chunks.with_chunk_ids(_chunks(spark, sf)).select("id")


def chunk_counts(spark, sf):
    return chunks.chunk_counts(_chunks(spark, sf))


def chunk_positions(spark, sf):
    events = pairs.load(spark, sf, "events").select("event_id", "event_type")
    placed = chunks.numbered(events, [], ["event_id"])
    return chunks.numbered(placed, ["event_type"], ["event_id"], "type_row_id").drop("event_type")


def _stored(df: DataFrame, number: Column, files: int, value: str) -> DataFrame:
    meta = F.struct(
        F.lit("docs").alias("schema"),
        F.lit("labels").alias("table"),
        number.alias("row_id"),
        F.concat(F.lit("f"), (F.col("doc_id") % files).cast("string")).alias("file_id"),
    )
    rows = df.select(F.col(value).alias("value"), meta.alias("metadata"))
    return chunks.with_chunk_ids(rows)


def _stores(spark, sf):
    labels = pairs.load(spark, sf, "labels")
    fresh = labels.where(F.col("doc_id") % 2 == 0)
    return (
        _stored(labels, F.col("doc_id"), 7, "quality"),
        _stored(fresh, F.col("doc_id") + 1, 3, "toxic"),
    )


def chunk_upsert_by_file(spark, sf):
    merged = chunks.upsert_chunks(*_stores(spark, sf))
    return merged.select("id", "metadata.file_id", "value")


def chunk_append_new(spark, sf):
    return chunks.append_new(*_stores(spark, sf)).select("id", "metadata.file_id", "value")


def chunk_store(spark, sf):
    """Two versions of a store: as first written, and after a batch that replaces files
    and appends chunks of no file came twice, a write died, and the rest was compacted."""
    store = chunks.ChunkStore(spark, f"{stage_folder(spark)}/chunks-{uuid.uuid4()}")
    old, new = _stores(spark, sf)
    # The number of a chunk is that of its label plus one.
    loose = F.when(F.col("metadata.row_id") % 8 != 1, F.col("metadata.file_id"))
    new = new.withColumn("metadata", F.col("metadata").withField("file_id", loose))
    first = store.write(old)
    store.write(new)
    store.write(new)
    died = f"{store.path}/data/{store.versions()[-1] + 1:08d}-died/filed"
    new.withColumn("_version", F.lit(4)).write.parquet(died)
    last = store.compact()
    rows = union_all(
        [store.read(v).withColumn("state", F.lit(s)) for v, s in ((first, "first"), (last, "last"))]
    )
    return rows.select("state", "id", "metadata.file_id", "value")


def embed_rows(spark, sf):
    texts = pairs.load(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    vectors = chunks.hashed_embeddings(texts)
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return vectors.select(
        "doc_id", F.size("embedding").alias("size"), F.round(F.sqrt(squares), 4).alias("norm")
    )


def _reports(spark, sf) -> ReportStore:
    """Two runs written as reports."""
    store = ReportStore(spark, f"{stage_folder(spark)}/reports-{uuid.uuid4()}")
    summary = staged(_summary(spark, sf))
    details = staged(reconcile_rows(*_long_sides(spark, sf, ("supplier",))))
    for report_id, moment in (
        ("20240101_000000", "2024-01-01T00:00:00"),
        ("20240202_000000", "2024-02-02T00:00:00"),
    ):
        document = overall_document(rollup.overall(summary), "one", "two", moment)
        store.write(report_id, document, summary, details)
    return store


def report_catalog(spark, sf):
    return _reports(spark, sf).list_reports()


def report_lookup(spark, sf):
    found = _reports(spark, sf).get("20240202_000000")
    return found.select("report_id", "meta.timestamp", "summary.*")


def report_documents(spark, sf):
    """Per table the numbers of detail rows its document holds."""
    source, destination = _long_sides(spark, sf, ("customer", "supplier"))
    nested = table_documents(
        reconcile_rows_summary(source, destination), reconcile_rows(source, destination), 25
    )
    counts = [
        F.size(f"details.{c}").cast("long").alias(c)
        for c in ("matching_rows", "different_rows", "missing_rows", "extra_rows")
    ]
    return nested.select("table", "success", "summary.rows_in_source", *counts)


def queries() -> dict[str, Query]:
    return {
        "recon_indexed_summary": recon_indexed_summary,
        "recon_indexed_summary_digest": recon_indexed_summary_digest,
        "recon_first_match_summary": recon_first_match_summary,
        "recon_indexed_status": recon_indexed_status,
        "recon_first_match_status": recon_first_match_status,
        "recon_indexed_dupkeys": recon_indexed_dupkeys,
        "recon_first_match_dupkeys": recon_first_match_dupkeys,
        "recon_first_match_dupkeys_summary": recon_first_match_dupkeys_summary,
        "recon_indexed_hot_key": recon_indexed_hot_key,
        "recon_first_match_hot_key": recon_first_match_hot_key,
        "recon_empty_side": recon_empty_side,
        "recon_compat_empty_side": recon_compat_empty_side,
        "missing_rows": missing_rows,
        "extra_rows": extra_rows,
        "extra_rows_first_match": extra_rows_first_match,
        "field_diff_long": field_diff_long,
        "field_diff_excluded": field_diff_excluded,
        "field_diff_union_columns": field_diff_union_columns,
        "field_diff_common_columns": field_diff_common_columns,
        "norm_trim_null": norm_trim_null,
        "norm_literal_null": norm_literal_null,
        "detail_cap_topn": detail_cap_topn,
        "detail_cap_long": detail_cap_long,
        "missing_listing": missing_listing,
        "multi_table_summary": _summary,
        "multi_table_summary_long": multi_table_summary_long,
        "multi_table_details_long": multi_table_details_long,
        "overall_rollup": overall_rollup,
        "match_percentage": match_percentage,
        "status_text": status_text,
        "success_flags": success_flags,
        "detect_primary_key": detect_primary_key,
        "column_uniqueness": column_uniqueness,
        "choose_key": choose_key,
        "match_by_key": match_by_key,
        "row_hash_match": row_hash_match,
        "row_hash_distinct": row_hash_distinct,
        "list_tables": list_tables,
        "common_tables": common_tables,
        "source_only_tables": source_only_tables,
        "destination_only_tables": destination_only_tables,
        "table_status": table_status,
        "mismatched_tables": mismatched_tables,
        "schema_from_filename": schema_names,
        "first_values": first_values,
        "ingest_rows": ingest_rows,
        "scan_dump_files": scan_dump_files,
        "scan_documents": scan_documents,
        "scan_mixed_files": scan_mixed_files,
        "scan_dump_statements": scan_dump_statements,
        "ingest_quoted_text": ingest_quoted_text,
        "ingest_long_text": ingest_long_text,
        "ingest_deep_nesting": ingest_deep_nesting,
        "ingest_deep_nesting_historic": ingest_deep_nesting_historic,
        "scan_dump_quoted": scan_dump_quoted,
        "run_rejects": run_rejects,
        "ingest_statement_targets": ingest_statement_targets,
        "ingest_rejects": ingest_rejects,
        "ingest_default_columns": ingest_default_columns,
        "ingest_conform_columns": ingest_conform_columns,
        "ingest_row_counts": ingest_row_counts,
        "ingest_then_reconcile": ingest_then_reconcile,
        "infer_suite": infer_suite,
        "infer_suite_long": infer_suite_long,
        "validate_suite": validate_suite,
        "compare_suite": compare_suite,
        "compare_suite_long": compare_suite_long,
        "suite_statistics": suite_statistics,
        "chunk_rows": chunk_rows,
        "chunk_ids": chunk_ids,
        "chunk_counts": chunk_counts,
        "chunk_positions": chunk_positions,
        "chunk_upsert_by_file": chunk_upsert_by_file,
        "chunk_append_new": chunk_append_new,
        "chunk_store": chunk_store,
        "embed_rows": embed_rows,
        "report_catalog": report_catalog,
        "report_lookup": report_lookup,
        "report_documents": report_documents,
        "run_direct": run_direct,
        "run_document": run_document,
        "run_file_lists": run_file_lists,
        "run_chunks": run_chunks,
        "report_details": report_details,
    }
