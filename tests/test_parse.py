import pytest
from pyspark.sql import functions as F

from sparkrecon.options import IngestOptions
from sparkrecon.sources.dumps import (
    _clean_docx,
    inserts,
    parse_statements,
    rejects,
    statements_of_text,
)


def parse(spark, text, options=IngestOptions(), path="/d/base.v1.sql"):
    df = spark.createDataFrame([(path, text)], "path string, content string")
    return parse_statements(statements_of_text(df, options=options), options)


def rows(spark, text, options=IngestOptions(), path="/d/base.v1.sql"):
    found = inserts(parse(spark, text, options, path)).orderBy("ord").collect()
    return [(r["schema"], r["table"], r["columns"], r["values"]) for r in found]


def values(spark, text, options=IngestOptions()):
    return [r[3] for r in rows(spark, text, options)]


def test_default_columns_and_schema_from_file_name(spark):
    got = rows(spark, "insert  into\n t1 values (1, 'a'), (2, 'b');")
    assert got == [
        ("base", "t1", ["column_1", "column_2"], ["1", "a"]),
        ("base", "t1", ["column_1", "column_2"], ["2", "b"]),
    ]


def test_column_list_quotes_and_targets(spark):
    got = rows(spark, 'INSERT INTO s.t (`a`, [b], "c", d ) VALUES (1,2,3,4); INSERT INTO x.y.z VALUES (1);')
    assert got[0] == ("s", "t", ["a", "b", "c", "d"], ["1", "2", "3", "4"])
    assert got[1][:2] == ("x", "y")


def test_unicode_names(spark):
    assert rows(spark, "INSERT INTO tablé (né) VALUES (1);")[0][1:3] == ("tablé", ["né"])


def test_literals_and_nulls(spark):
    got = values(spark, "INSERT INTO t VALUES ('It''s', '', NULL, null, 'NULL', ' pad ', \"x\"\"y\");")
    assert got == [["It's", "", None, None, "NULL", "pad", 'x"y']]


def test_nested_calls_and_parentheses_in_literals(spark):
    got = values(spark, "INSERT INTO t VALUES (NOW(), f(g(1, 2), ')'), 'a)b(c', CURRENT_TIMESTAMP);")
    assert got == [["NOW()", "f(g(1, 2), ')')", "a)b(c", "CURRENT_TIMESTAMP"]]


def test_backslash_before_quote(spark):
    assert values(spark, r"INSERT INTO t VALUES ('it\'s', 1);") == [["it's", "1"]]
    standard = IngestOptions(backslash_escapes=False)
    assert values(spark, r"INSERT INTO t VALUES ('C:\', 1);", standard) == [["C:\\", "1"]]


def test_statement_ends_at_first_semicolon(spark):
    text = "x INSERT INTO t VALUES (1, 'a'); (2, 'ignored') INSERT INTO t VALUES (3, 'b;c'), (4, 'd'); INSERT INTO t VALUES (5, 'e')"
    assert values(spark, text) == [["1", "a"]]
    aware = IngestOptions(quote_aware=True)
    assert values(spark, text, aware) == [["1", "a"], ["3", "b;c"], ["4", "d"]]


def test_rejects(spark):
    text = "INSERT INTO t (a, b) VALUES (1, 2), (3); INSERT INTO `t` VALUES (1); INSERT INTO t (a) SELECT 1;"
    got = [(r["reason"], r["stmt"]) for r in rejects(parse(spark, text)).orderBy("stmt").collect()]
    assert got == [("arity_mismatch", 0), ("no_target", 1), ("no_values", 2)]


def test_raw_statement_is_cut(spark):
    long = "INSERT INTO t VALUES ('" + "x" * 200 + "');"
    raw = parse(spark, long).first()["raw_statement"]
    assert raw == long[:100] + "..."
    short = "INSERT INTO t VALUES (1);"
    assert parse(spark, short).first()["raw_statement"] == short


def test_corrected_and_historic_reading(spark):
    text = "INSERT INTO t VALUES ('O\"Brien', 1), ('NULL', 2), (a,, 3),\n('multi\nline', 4);"
    assert values(spark, text) == [["O\"Brien", "1"], ["NULL", "2"], ["multi\nline", "4"]]
    kept = "INSERT INTO t VALUES ('NULL', 2), (a,, 3),\n('multi\nline', 4), (5, 'x');"
    assert values(spark, kept, IngestOptions.historic()) == [[None, "2"], ["a", "3"], ["5", "x"]]


def test_historic_items(spark):
    historic = IngestOptions.historic()
    assert values(spark, "INSERT INTO t VALUES (b'x', 'a' c, ' ', \"q\"\"r\");", historic) == [
        ["x", "a", "c", "", 'q"r']
    ]


def test_table_named_like_the_keyword(spark):
    got = rows(spark, "INSERT INTO my_values (id) VALUES (1), (2);")
    assert [r[1:] for r in got] == [("my_values", ["id"], ["1"]), ("my_values", ["id"], ["2"])]


def test_large_literals_do_not_recurse(spark):
    big = "a''b(c,\\d" * 50_000
    got = values(spark, f"INSERT INTO t VALUES (1, '{big}', f({'(' * 10}1{')' * 10}));")
    assert got[0][1] == big.replace("''", "'") and len(got[0]) == 3


def test_render_and_parse_is_identity(spark):
    texts = ["", "a", "it's", 'say "x"', "(1, 2); --", "a,b", "null", "'q'", "line\nend", "ü€"]
    body = ", ".join("('" + t.replace("'", "''") + "', NULL)" for t in texts)
    options = IngestOptions(quote_aware=True)
    assert values(spark, f"INSERT INTO t VALUES {body};", options) == [[t, None] for t in texts]


@pytest.mark.parametrize(
    "item, want",
    [("'a''b'", "a''b"), (r"'a\'b'", r"a\'b"), ("null", None), ("'NULL'", "NULL"), ("", ""), ("' x '", " x ")],
)
def test_docx_cleaning(spark, item, want):
    df = spark.createDataFrame([(item,)], "v string")
    assert df.select(_clean_docx(F.col("v")).alias("v")).first()["v"] == want
