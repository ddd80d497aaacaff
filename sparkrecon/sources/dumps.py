"""Dump files of INSERT statements as a source: scan, parse, reject.

Text files are decoded and parsed by JVM expressions; only the paragraphs of
``.docx`` archives are read by a small Arrow-batched helper. The parsed rows of
all files and tables form one DataFrame, in which ``ord`` carries the order the
rows have in their files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.functions.rows import let
from sparkrecon.functions.text import file_extension, file_stem, strip_text, strip_value
from sparkrecon.operators.skew import lookup_join, ordered_lookup
from sparkrecon.options import DUMP_EXTENSIONS, IngestOptions
from sparkrecon.sources import nesting
from sparkrecon.sources import patterns as P
from sparkrecon.sources.quotes import cut_statements

STATEMENT_FIELDS = "path string, dialect string, block bigint, stmt bigint, statement string"
TEXT_GLOB = "*.{" + ",".join(e for e in DUMP_EXTENSIONS if e != "docx") + "}"
RAW_LENGTH = 100


# --------------------------------------------------------------------------- scan


def _docx_text(payload: bytes) -> str | None:
    """Paragraph texts of a document body joined by newlines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    signs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for paragraph in body.findall(f"{space}p") if body is not None else []:
        parts = []
        for node in paragraph.iter():
            name = node.tag.removeprefix(space)
            parts.append((node.text or "") if name == "t" else signs.get(name, ""))
        lines.append("".join(parts))
    return "\n".join(lines)


def _read_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "content": batch["content"].map(_docx_text)})


def _decoded(content: Column) -> Column:
    """UTF-8, else Latin-1, with line ends as newlines."""
    text = F.coalesce(
        F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def _reader(spark: SparkSession, options: IngestOptions, kind: str, glob: str | None):
    reader = spark.read.format(kind).option("recursiveFileLookup", str(options.recursive).lower())
    return reader.option("pathGlobFilter", glob) if glob else reader


def _whole_statements(files: DataFrame, pattern: str, dialect: str) -> DataFrame:
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    found = F.filter(found, lambda s: s != "")
    return files.select(
        "path",
        F.lit(dialect).alias("dialect"),
        F.lit(0).cast("long").alias("block"),
        F.posexplode(found).alias("stmt", "statement"),
    ).withColumn("stmt", F.col("stmt").cast("long"))


def _split_statements(reader, paths: Sequence[str], options: IngestOptions) -> DataFrame:
    """Pieces between semicolons. Large files are cut into blocks, one or more
    tasks each; block start and position within the task give the order.

    A first pass over the pieces finds, per file, what a reader of the whole file
    sees at once: whether all of it is UTF-8, and whether it ends in a statement
    without semicolon (then one more byte was counted than the file has), which
    does not count. With ``quote_aware`` pieces are joined where a semicolon stands
    in a literal (see :mod:`sparkrecon.sources.quotes`)."""
    name = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    pieces = reader.option("lineSep", ";").load(list(paths)).select(
        F.coalesce(F.try_url_decode(name), F.col("_metadata.file_path")).alias("path"),
        F.lit("text").alias("dialect"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("stmt"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    place = F.struct("block", "stmt")
    none = F.struct(*[F.lit(-1).cast("long").alias(c) for c in ("block", "stmt")])
    more = P.closing_patterns(options) if options.quote_aware else {}
    files = pieces.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("open"),
        F.max(place).alias("last"),
        *[
            F.max(F.when(F.col("value").rlike(p), place).otherwise(none)).alias(f"last_{q}")
            for q, p in more.items()
        ],
    )
    data = F.col("value").cast("binary")
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(data, "ISO-8859-1"))
    text = F.regexp_replace(text, "\r\n?", "\n")
    if options.quote_aware:
        known = ordered_lookup(pieces, files, ["path"], ["path", "block"], "stmt")
        known = known.where(~(F.col("open") & (place == F.col("last"))))
        later = {q: place < F.col(f"last_{q}") for q in more}
        return cut_statements(known.withColumn("text", text), later, options)
    known = lookup_join(pieces, files, ["path"], "inner", ["stmt"])
    tail = F.col("open") & (place == F.col("last"))
    found = F.regexp_extract(text, P.OPEN_STATEMENT, 1)
    statements = known.where(~tail).select(
        "path", "dialect", "block", "stmt", F.concat(found, F.lit(";")).alias("statement")
    )
    return statements.where(F.length("statement") > 1)


def _plain_path(path: str) -> str:
    """A path whose signs are not read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _statements(
    spark: SparkSession,
    text: Sequence[str],
    docx: Sequence[str],
    options: IngestOptions,
    globs: tuple[str | None, str | None],
) -> DataFrame:
    parts = []
    if text and options.split == "statement":
        parts.append(_split_statements(_reader(spark, options, "text", globs[0]), text, options))
    elif text:
        files = _reader(spark, options, "binaryFile", globs[0]).load(list(text))
        if options.split == "auto":
            small = F.col("length") <= options.whole_file_bytes
            # Only names and sizes are read here.
            large = [r["path"] for r in files.where(~small).select("path").collect()]
            if large:
                paths = [_plain_path(path) for path in large]
                reader = _reader(spark, options, "text", None)
                parts.append(_split_statements(reader, paths, options))
                files = files.where(small)
        files = files.select("path", _decoded(F.col("content")).alias("content"))
        parts.append(_whole_statements(files, P.statement_pattern(options), "text"))
    if docx:
        files = _reader(spark, options, "binaryFile", globs[1]).load(list(docx))
        files = files.select("path", "content").mapInPandas(
            _read_docx, "path string, content string"
        )
        parts.append(_whole_statements(files, P.STATEMENT, "docx"))
    if not parts:
        return spark.createDataFrame([], STATEMENT_FIELDS)
    return reduce(DataFrame.unionByName, parts)


def scan_directory(
    spark: SparkSession, directory: str, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Statements of all dump files in a directory (see ``IngestOptions.recursive``)."""
    return _statements(spark, [directory], [directory], options, (TEXT_GLOB, "*.docx"))


def scan_files(
    spark: SparkSession, paths: Iterable[str], options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Statements of the given files; other endings are left to :func:`rejected_files`."""
    by_kind = _by_kind(paths)
    return _statements(spark, by_kind["text"], by_kind["docx"], options, (None, None))


def _by_kind(paths: Iterable[str]) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"text": [], "docx": [], "other": []}
    for path in paths:
        ending = path.lower().rsplit(".", 1)[-1]
        kind = "docx" if ending == "docx" else "text" if ending in DUMP_EXTENSIONS else "other"
        kinds[kind].append(path)
    return kinds


def rejected_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``(path, reason)`` of given files that are no dumps."""
    rows = [(p, "unsupported_extension") for p in _by_kind(paths)["other"]]
    return spark.createDataFrame(rows, "path string, reason string")


def unreadable_documents(
    spark: SparkSession, paths: Sequence[str], options: IngestOptions = IngestOptions()
) -> DataFrame:
    """``(path, reason)`` of ``.docx`` files that are no readable documents."""
    files = _reader(spark, options, "binaryFile", "*.docx").load(list(paths))
    texts = files.select("path", "content").mapInPandas(_read_docx, "path string, content string")
    return texts.where(F.col("content").isNull()).select(
        "path", F.lit("unreadable").alias("reason")
    )


def statements_of_text(df: DataFrame, path: str = "path", content: str = "content",
                       options: IngestOptions = IngestOptions()) -> DataFrame:
    """Statements of dump texts that are already in a DataFrame."""
    files = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return _whole_statements(files, P.statement_pattern(options), "text")


# --------------------------------------------------------------------------- parse


def _unquoted(text: Column, quote: str) -> Column:
    body = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.replace(body, F.lit(quote * 2), F.lit(quote))


def _is_quoted(text: Column, quote: str) -> Column:
    return (F.length(text) >= 2) & text.startswith(quote) & text.endswith(quote)


def _null_if_word(text: Column) -> Column:
    return F.when((F.length(text) != 4) | (F.lower(text) != "null"), text)


def _without_end(values: Column) -> Column:
    """The text after VALUES without the semicolon of its statement."""
    return F.when(values.endswith(";"), F.left(values, F.length(values) - 1)).otherwise(values)


def _clean_text(text: Column, options: IngestOptions) -> Column:
    """Quoted text is taken literally, with blanks at its ends; a bare ``null`` is null."""

    def literal(quote: str) -> Column:
        body = _unquoted(text, quote)
        if options.backslash_escapes:
            body = F.replace(body, F.lit("\\" + quote), F.lit(quote))
        return body

    return (
        F.when(_is_quoted(text, "'"), literal("'"))
        .when(_is_quoted(text, '"'), literal('"'))
        .otherwise(_null_if_word(text))
    )


def _clean_literal_again(item: Column, options: IngestOptions) -> Column:
    """Historic: what was quoted is read once more, so it may be null or lose
    another pair of quotes."""
    closed = (
        F.when(_is_quoted(item, "'"), _unquoted(item, "'"))
        .when(_is_quoted(item, '"'), _unquoted(item, '"'))
        .when(item.startswith("'") | item.startswith('"'), F.substring(item, 2, 1 << 30))
        .otherwise(item)
    )
    text = strip_text(closed)
    again = (
        F.when(F.lower(text) == "null", F.lit(None).cast("string"))
        .when(_is_quoted(text, "'"), _unquoted(text, "'"))
        .when(_is_quoted(text, '"'), _unquoted(text, '"'))
        .otherwise(text)
    )
    if not options.quoted_null_is_text:
        return again
    return F.when(item.startswith("'") | item.startswith('"'), text).otherwise(again)


def _clean_docx(text: Column) -> Column:
    bare = F.length(text) == 1
    return (
        F.when(_is_quoted(text, "'"), F.substring(text, F.lit(2), F.length(text) - 2))
        .when(bare & (text == "'"), F.lit(""))
        .otherwise(_null_if_word(text))
    )


def _text_values(tuple_text: Column, options: IngestOptions, deep: bool) -> Column:
    inner = F.substring(tuple_text, F.lit(2), F.length(tuple_text) - 2)
    if options.keep_empty_items:
        if deep:
            items = nesting.parts(nesting.marked(inner, P.token_pattern(options, commas=True)))
        else:
            items = F.regexp_extract_all(
                F.concat(F.lit(","), inner), F.lit(P.item_pattern(options)), F.lit(1)
            )
        # Stripped in a step of its own: a lambda computes each use of a value anew.
        bare = F.transform(items, strip_value)
        values = F.transform(F.transform(bare, lambda t: _clean_text(t, options)), strip_value)
        empty = F.array().cast("array<string>")
        # Only a text without a sign of a value needs a look at all of it.
        blank = ~inner.rlike(P.PRINTED) & (strip_text(inner) == "")
        return F.when(blank, empty).otherwise(values)
    tokens = F.regexp_extract_all(inner, F.lit(P.HISTORIC_ITEM), F.lit(0))
    kept = F.filter(tokens, lambda t: ~strip_text(t).isin("", "'", '"'))
    return F.transform(kept, lambda t: _clean_literal_again(t, options))


def _docx_values(inner: Column) -> Column:
    items = F.regexp_extract_all(F.concat(F.lit(","), inner), F.lit(P.DOCX_ITEM), F.lit(1))
    blank_end = strip_text(F.element_at(items, -1)) == ""
    kept = F.when(blank_end, F.slice(items, 1, F.size(items) - 1)).otherwise(items)
    return F.transform(F.transform(kept, strip_text), _clean_docx)


def _tuples(values: Column, marked: Column, dialect: Column, options: IngestOptions) -> Column:
    """The values of all tuples; ``marked`` is null where patterns read all of them."""

    def read(text: Column, deep: bool) -> Column:
        if not options.multiline_tuples:
            text = F.filter(text, lambda t: ~F.contains(t, F.lit("\n")))
        return F.transform(text, lambda t: _text_values(t, options, deep))

    docx = F.regexp_extract_all(values, F.lit(P.DOCX_TUPLE), F.lit(1))
    plain = F.regexp_extract_all(values, F.lit(P.tuple_pattern(options)), F.lit(1))
    plain = F.filter(plain, lambda t: t != "")
    return (
        F.when(dialect == "docx", F.transform(docx, _docx_values))
        .when(marked.isNull(), read(plain, False))
        .otherwise(read(nesting.groups(marked), True))
    )


@lru_cache(maxsize=8)
def _reading(options: IngestOptions, gateway: int) -> tuple[list[Column], Column, Column, Column]:
    """Expressions over statements: their heads and tuples, generic column names, all
    tuples with an unclosed one, and entries of tuples and texts. Putting them together
    takes longer than planning a query with them, so they are kept."""
    stmt, dialect = F.col("statement"), F.col("dialect")
    schema = F.regexp_extract(stmt, P.TARGET, 1)
    table = F.regexp_extract(stmt, P.TARGET, 2)
    listed = F.regexp_extract(stmt, P.COLUMN_LIST, 1)
    names = F.transform(
        F.split(listed, ","), lambda c: F.btrim(strip_text(c), F.lit("`[]\"' "))
    )
    section = P.VALUES if options.mixed_quotes else P.FIRST_VALUES
    short = F.when(
        F.length(stmt) > RAW_LENGTH, F.concat(F.left(stmt, F.lit(RAW_LENGTH)), F.lit("..."))
    ).otherwise(stmt)

    def read(values: Column) -> Column:
        odd = (dialect != "docx") & ~values.rlike(P.plain_pattern(options))
        marked = F.when(odd, nesting.marked(values, P.token_pattern(options, commas=False)))
        return let(marked, lambda m: F.struct(
            _tuples(values, m, dialect, options).alias("tuples"),
            F.coalesce(nesting.has_open_group(m), F.lit(False)).alias("open"),
        ))

    columns = [
        F.coalesce(F.nullif(schema, F.lit("")), file_stem(F.col("path"))).alias("schema"),
        F.nullif(table, F.lit("")).alias("table"),
        F.when(listed != "", names).alias("listed"),
        let(let(F.regexp_extract(stmt, section, 1), _without_end), read).alias("read"),
        F.when(dialect == "docx", stmt).otherwise(short).alias("raw_statement"),
        *[F.col(c) for c in ("statement", "path", "block", "stmt")],
    ]
    width = F.size(F.get("tuples", F.lit(0)))
    generic = F.when(
        width > 0,
        F.transform(
            F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("column_"), i.cast("string"))
        ),
    )
    # A tuple that is never closed comes last, as null.
    unclosed = F.array(F.lit(None).cast("array<string>"))
    found = F.when(F.col("open"), F.concat("tuples", unclosed)).otherwise(F.col("tuples"))
    kept = F.when(F.col("table").isNotNull(), F.size("columns"))
    entries = let(kept, lambda n: let(found, lambda t: _entries(t, n, F.col("statement"))))
    return columns, generic, found, entries


def parse_statements(
    statements: DataFrame, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """One row per VALUES tuple, with ``reason`` set where it is not a table row."""
    columns, generic, found, entries = _reading(options, id(SparkContext._gateway))
    heads = statements.select(*columns)
    heads = heads.withColumns({"tuples": F.col("read.tuples"), "open": F.col("read.open")}).drop("read")
    # Named before the tuples are taken apart, so no tuple carries all the others.
    named = heads.withColumn("columns", F.coalesce("listed", generic)).drop("listed")
    tuples = named.select(
        "schema",
        "table",
        "columns",
        F.posexplode_outer(entries).alias("tuple", "entry"),
        "raw_statement",
        F.when(F.size(found) < 1, F.col("statement")).alias("lone"),
        "path",
        "block",
        "stmt",
    ).withColumn("values", F.col("entry.values"))
    reason = (
        F.when(F.col("table").isNull(), "no_target")
        .when(F.col("tuple").isNotNull() & F.col("values").isNull(), "unclosed_tuple")
        .when(F.col("values").isNull(), "no_values")
        .when(F.col("columns").isNull() | (F.size("values") != F.size("columns")), "arity_mismatch")
    )
    return tuples.select(
        "schema",
        "table",
        "columns",
        "values",
        "raw_statement",
        F.struct("path", "block", "stmt", "tuple").alias("ord"),
        reason.alias("reason"),
        F.coalesce("entry.whole", "lone").alias("statement"),
    )


def _entries(tuples: Column, width: Column, statement: Column) -> Column:
    """Tuples with the statement beside the first of them that gives no row (any, if the
    statement as a whole gives none), so that a reject's text is kept once."""
    bad = F.transform(
        tuples, lambda t: F.coalesce(F.size(t) != width, F.lit(True)) | t.isNull()
    )
    return let(
        F.array_position(bad, True),
        lambda first: F.transform(
            tuples,
            lambda t, i: F.struct(
                t.alias("values"), F.when(i + 1 == first, statement).alias("whole")
            ),
        ),
    )


def inserts(parsed: DataFrame) -> DataFrame:
    """The table rows among parsed tuples."""
    return parsed.where(F.col("reason").isNull()).drop("reason", "statement")


def rejects(parsed: DataFrame) -> DataFrame:
    """Statements and tuples that gave no table row, with the reason."""
    return parsed.where(F.col("reason").isNotNull()).select(
        F.col("ord.path").alias("path"),
        F.col("ord.block").alias("block"),
        F.col("ord.stmt").alias("stmt"),
        F.col("ord.tuple").alias("tuple"),
        "schema",
        "table",
        "reason",
        "raw_statement",
    )


def rejected_statements(parsed: DataFrame) -> DataFrame:
    """``(path, block, stmt, statement)``: the whole text of every statement of which
    something was rejected, once; rejects refer to it by the first three."""
    return parsed.where(F.col("statement").isNotNull()).select(
        F.col("ord.path").alias("path"),
        F.col("ord.block").alias("block"),
        F.col("ord.stmt").alias("stmt"),
        "statement",
    )


def ingest_directory(
    spark: SparkSession, directory: str, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Table rows of a directory of dumps."""
    return inserts(parse_statements(scan_directory(spark, directory, options), options))


def ingest_files(
    spark: SparkSession, paths: Iterable[str], options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Table rows of the given dump files."""
    return inserts(parse_statements(scan_files(spark, paths, options), options))


def supported(path: Column) -> Column:
    """Whether a file has one of the endings dumps may have."""
    return file_extension(path).isin(*DUMP_EXTENSIONS)
