"""Reading without limits of depth or size: tokens against patterns, blocks against
whole files, both against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from sparkrecon.options import IngestOptions
from sparkrecon.sources import nesting
from sparkrecon.sources import patterns as P
from sparkrecon.sources.dumps import (
    ingest_directory,
    parse_statements,
    rejected_statements,
    rejects,
    statements_of_text,
)

MODES = {
    "default": IngestOptions(),
    "standard": IngestOptions(backslash_escapes=False),
    "historic": IngestOptions.historic(),
}


def parsed(spark, text, options=IngestOptions()):
    frame = spark.createDataFrame([("p.sql", text)], "path string, content string")
    found = parse_statements(statements_of_text(frame, options=options), options)
    rows = found.orderBy("ord").collect()
    return [(r["values"], r["reason"]) for r in rows]


@pytest.mark.parametrize("depth", [1, 15, 16, 17, 40, 64, 70, 300, 2000])
@pytest.mark.parametrize("mode", ["default", "historic"])
def test_any_depth(spark, depth, mode):
    inner = "(" * depth + "9" + ")" * depth
    text = f"INSERT INTO t VALUES (1, 2), (7, {inner}), (8, 'x');"
    assert parsed(spark, text, MODES[mode]) == [(["1", "2"], None), (["7", inner], None), (["8", "x"], None)]


def test_only_the_broken_tuple_is_lost(spark):
    deep = "(" * 70 + "1" + ")" * 70
    for broken in ("(3, (4, 5)", "(3, 'open", "(3, f(4, 'a;b", f"(3, ({deep}"):
        text = f"INSERT INTO t (a, b) VALUES (1, 2), (6, f({deep}, ',)(')), {broken};"
        found = parsed(spark, text, IngestOptions(quote_aware=True))
        assert found[:2] == [(["1", "2"], None), (["6", f"f({deep}, ',)(')"], None)]
        assert found[2:] == [(None, "unclosed_tuple")], broken


def test_stray_parentheses(spark):
    assert parsed(spark, "INSERT INTO t VALUES ) (1, 2)), (3, f(x)) ON DUPLICATE KEY UPDATE a = 1;") == [
        (["1", "2"], None), (["3", "f(x)"], None)
    ]


def test_signs_of_the_marking_stand_for_themselves(spark):
    deep = "(" * 30 + "1" + ")" * 30
    item = f"a{nesting.SIGN}1b{nesting.BEGIN}{nesting.CUT}"
    text = f"INSERT INTO t VALUES ({deep}, '{item}', {nesting.SIGN});"
    assert parsed(spark, text) == [([deep, item, nesting.SIGN], None)]


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("block", [1, 3, 64])
def test_tokens_equal_patterns(spark, monkeypatch, mode, block):
    """Where patterns read all of the values, tokens find the same tuples and items."""
    monkeypatch.setattr(nesting, "BLOCK", block)
    options, rng = MODES[mode], random.Random(block)
    signs = ["(", ")", ",", "'a,('", '"(\'', "1", " x ", "''", "NULL", "f(1, 2)", "\n", "\\'"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts = ["(" + t + ")" if i % 2 else t for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    frame = frame.where(F.col("t").rlike(P.plain_pattern(options)))
    assert frame.count() > 20
    tuples = F.regexp_extract_all("t", F.lit(P.tuple_pattern(options)), F.lit(1))
    tuples = F.filter(tuples, lambda t: t != "")
    marked = nesting.marked(F.col("t"), P.token_pattern(options, commas=False))
    items = F.regexp_extract_all(F.concat(F.lit(","), "t"), F.lit(P.item_pattern(options)), F.lit(1))
    cut = nesting.parts(nesting.marked(F.col("t"), P.token_pattern(options, commas=True)))
    rows = frame.select(
        "t", tuples.alias("want"), nesting.groups(marked).alias("got"),
        nesting.has_open_group(marked).alias("open"), items.alias("want_items"), cut.alias("items"),
    ).collect()
    for r in rows:
        assert (r["got"], r["open"]) == (r["want"], False), r["t"]
        assert r["items"] == r["want_items"], r["t"]


def test_many_tuples_take_linear_time(spark):
    deep = "(" * 20 + "1" + ")" * 20
    body = ", ".join(f"({i}, {deep})" for i in range(4_000))
    found = parsed(spark, f"INSERT INTO t VALUES {body};")
    assert [r[0][0] for r in found] == [str(i) for i in range(4_000)]
    assert {r[0][1] for r in found} == {deep}


def made(rng, statements):
    """A dump with semicolons, quotes and keywords in literals, and open ends."""
    text = ["-- it", " head\n"]
    for i in range(statements):
        a = rng.choice(["a;b", "it''s; x", 'say "y"; ', "INSERT INTO u VALUES (1);", "\\", "é;;;", "q" * 40])
        quote = rng.choice("''\"")
        body = a.replace("''", '""') if quote == '"' and "''" in a else a
        body = body.replace('"', '""') if quote == '"' and '""' not in body else body
        text.append(rng.choice([
            f"INSERT INTO t (a, b) VALUES ({i}, {quote}{body}{quote});\n", "; -- note;\n",
            f"insert  into t values ({i}, NULL);", "don't; " if rng.random() < 0.05 else "x ",
        ]))
    return "".join(text) + rng.choice(["", "INSERT INTO t VALUES (1, 'open; end", "INSERT INTO t VALUES ('z')", "'"])


@pytest.mark.parametrize("mode", MODES)
def test_blocks_equal_whole_files(spark, tmp_path, mode):
    rng = random.Random(len(mode))
    for i in range(5):
        (tmp_path / f"dump {i}.sql").write_text(made(rng, 60), encoding="utf-8")
    (tmp_path / "latin.sql").write_bytes("INSERT INTO t VALUES ('é;');".encode("latin-1"))
    changes = {"quote_aware": True, "backslash_escapes": MODES[mode].backslash_escapes}
    build = IngestOptions.historic if mode == "historic" else IngestOptions

    def read(split, **more):
        rows = ingest_directory(spark, str(tmp_path), build(split=split, **changes, **more))
        got = rows.select("schema", "values", "ord").orderBy("ord").collect()
        return [(r["schema"], r["values"]) for r in got]

    want = read("file")
    assert len(want) > 50
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert sorted(map(str, read("statement"))) == sorted(map(str, want))
        assert sorted(map(str, read("auto", whole_file_bytes=100))) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_literal_over_many_blocks(spark, tmp_path):
    long = "x;y''z\n" * 3000
    text = f"INSERT INTO t VALUES (1, 'a'); INSERT INTO t VALUES (2, '{long}'); INSERT INTO t VALUES (3, ';');"
    (tmp_path / "one.sql").write_text(text)
    options = IngestOptions(quote_aware=True, split="statement")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = ingest_directory(spark, str(tmp_path), options).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["values"] for r in rows] == [["1", "a"], ["2", long.replace("''", "'").strip()], ["3", ";"]]


def test_whole_statements_of_rejects(spark):
    long = "x" * 300
    texts = [
        f"INSERT INTO t (a, b) VALUES (1, 2), ('{long}'), (3, 4), (5);", "INSERT INTO t (a) SELECT 1;",
        "INSERT INTO `t` VALUES (1), (2);", "INSERT INTO t (a) VALUES (1), (2;", "INSERT INTO t (a) VALUES (1);",
    ]
    frame = spark.createDataFrame([("p.sql", "\n".join(texts))], "path string, content string")
    found = parse_statements(statements_of_text(frame))
    kept = {r["stmt"]: r["statement"] for r in rejected_statements(found).collect()}
    assert kept == dict(enumerate(texts[:4])) and rejected_statements(found).count() == 4
    places = [(r["stmt"], r["tuple"], r["reason"]) for r in rejects(found).orderBy("stmt", "tuple").collect()]
    assert places == [
        (0, 1, "arity_mismatch"), (0, 3, "arity_mismatch"), (1, None, "no_values"),
        (2, None, "no_target"), (3, 1, "unclosed_tuple"),
    ]
