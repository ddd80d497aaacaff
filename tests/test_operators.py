import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkrecon import ReconOptions
from sparkrecon.functions.rows import field_diff, row_map
from sparkrecon.functions.text import (
    display_label,
    match_percentage,
    norm_key,
    run_id,
    schema_from_filename,
    status_text,
    strip_text,
    title_text,
)
from sparkrecon.operators import catalog, keys, match, rollup, skew
from sparkrecon.operators.stage import staged
from sparkrecon.operators.tables import (
    conform_columns,
    long_form,
    table_columns,
    tables_by_schema,
    to_table,
    with_meta,
    without_meta,
)

INSERTS = "schema string, table string, columns array<string>, values array<string>, ord struct<path:string,stmt:int>"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], schema or "x int")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text", [" a ", "\t\na ", "\x1ca　 ", "a b", "", "\r\n"])
def test_strip_is_unicode_strip(spark, text):
    assert one(spark, strip_text(F.col("x")), x=(text, "string")) == text.strip()
    assert one(spark, norm_key(F.col("x")), x=(None, "string")) == "None"


def test_text_functions(spark):
    assert one(spark, title_text(F.col("x")), x=("hire_date", "string")) == "Hire Date" == display_label("hire_date")
    names = {"Schema_ONE.v2.sql": "schema_one", "/a/b/Other.sql": "other"}
    for name, want in names.items():
        assert one(spark, schema_from_filename(F.col("x"), ["schema_one", "two"]), x=(name, "string")) == want
    assert one(spark, match_percentage(F.col("a"), F.col("b")), a=(1, "long"), b=(3, "long")) == 33.3
    assert one(spark, match_percentage(F.col("a"), F.col("b")), a=(0, "long"), b=(0, "long")) == 0.0
    for args, want in {
        (True, 0, 0): "Match", (False, 2, 1): "2 different, 1 missing", (False, 0, 3): "3 missing", (False, 0, 0): "No Match",
    }.items():
        got = one(spark, status_text(F.col("m"), F.col("d"), F.col("x")),
                  m=(args[0], "boolean"), d=(args[1], "int"), x=(args[2], "int"))
        assert got == want
    moment = F.to_timestamp(F.lit("2024-03-04 05:06:07"))
    assert one(spark, run_id(moment), x=(1, "int")) == "20240304_050607"


def test_row_map_last_duplicate_wins(spark):
    got = one(spark, row_map(F.col("c"), F.col("v")), c=(["a", "b", "a"], "array<string>"), v=(["1", "2", "3"], "array<string>"))
    assert got == {"b": "2", "a": "3"}


def test_field_diff(spark):
    kind = "map<string,string>"
    left, right = {"a": "1", "b": None, "employee_id": "1"}, {"a": "2", "c": "x", "employee_id": "2"}
    got = one(spark, field_diff(F.col("l"), F.col("r"), ["employee_id"]), l=(left, kind), r=(right, kind))
    assert {k: tuple(v) for k, v in got.items()} == {"a": ("1", "2"), "c": (None, "x")}
    got = one(spark, field_diff(F.col("l"), F.col("r"), common_only=True), l=(left, kind), r=(right, kind))
    assert set(got) == {"a", "employee_id"}


def inserts(spark):
    rows = [
        ("s", "t", ["a", "b"], ["1", "2"], ("f", 1)),
        ("s", "t", ["x", "y", "z"], ["3", "4", "5"], ("f", 2)),
        ("s", "t", ["p", "q", "r"], ["6", None, "8"], ("f", 3)),
        ("s", "t", ["a", "b", "a", "c"][:1], ["9"], ("f", 4)),
        ("o", "u", ["k"], ["1"], ("g", 1)),
    ]
    return spark.createDataFrame(rows, INSERTS)


def test_longest_columns_and_positions(spark):
    lists = {r["table"]: r["columns"] for r in table_columns(inserts(spark)).collect()}
    assert lists == {"t": ["x", "y", "z"], "u": ["k"]}
    rows = conform_columns(inserts(spark)).where("table = 't'").orderBy("ord").collect()
    assert [r["values"] for r in rows] == [["1", "2", None], ["3", "4", "5"], ["6", None, "8"], ["9", None, None]]
    by_schema = tables_by_schema(inserts(spark))
    assert {s: sorted(t) for s, t in by_schema.items()} == {"s": ["t"], "o": ["u"]}
    assert by_schema["s"]["t"].columns == ["x", "y", "z"] and by_schema["s"]["t"].count() == 4


def test_lookup_beyond_the_limit_gives_the_same(spark, monkeypatch):
    want = Counter(map(str, conform_columns(inserts(spark)).collect()))
    monkeypatch.setattr(skew, "LOOKUP_LIMIT", 1)
    got = Counter(map(str, conform_columns(inserts(spark)).select(*conform_columns(inserts(spark)).columns).collect()))
    assert got == want


def test_meta_columns(spark):
    df = spark.range(1)
    assert with_meta(df, "s", "t").columns == ["id", "__schema__", "__table__"]
    assert without_meta(without_meta(with_meta(df, "s", "t"))).columns == ["id"]


def test_long_form_orders_numbers(spark):
    df = spark.createDataFrame([(-5, "a"), (10, "b"), (9, "c")], "k long, v string")
    rows = long_form(df, "t", ["k"]).orderBy("ord").collect()
    assert [r["row"]["k"] for r in rows] == ["-5", "9", "10"]
    assert to_table(long_form(df, "t", ["k"]), ["v", "k"]).columns == ["v", "k"]


@pytest.mark.parametrize(
    "source, destination, key, shown",
    [
        (["name", "employee_id"], ["x"], "employee_id", "name"),
        (["department_id", "payroll_id"], ["x"], "payroll_id", "department_id"),
        (["department_id", "x"], ["x"], "department_id", "department_id"),
        (["name", "id"], ["id"], "id", "name"),
        (["name", "id"], ["x"], "name", "name"),
    ],
)
def test_key_by_name(spark, source, destination, key, shown):
    assert keys.choose_key(source, destination) == key
    assert keys.display_key(source) == shown
    kind = "array<string>"
    assert one(spark, keys.choose_key_of(F.col("s"), F.col("d")), s=(source, kind), d=(destination, kind)) == key
    assert one(spark, keys.display_key_of(F.col("s")), s=(source, kind)) == shown


def test_detect_primary_keys(spark):
    zeros = spark.createDataFrame([(0.0, [1], b"a"), (-0.0, [2], b"b")], "z double, a array<int>, b binary")
    nested = spark.createDataFrame([("a, b", "c"), ("a", "b, c")], "x string, y string").select(
        F.struct("x", "y").alias("pair")
    )
    tables = {
        "zeros": zeros,
        "binary": zeros.select("z", "b"),
        "nested": nested,
        "held": spark.createDataFrame([(1, None), (2, 3)], "some int, id int"),
        "none": spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"),
        "empty": spark.createDataFrame([], "a int, b_id int"),
        "marks": spark.createDataFrame([("s", "t")], "__schema__ string, __table__ string"),
        # Past the sketch, yet not unique: one value twice among many.
        "nearly": spark.range(50_000).selectExpr("greatest(id, 1) AS row_id", "id AS n", "id % 7 AS `odd.name`"),
    }
    got = {r["table"]: r["primary_key"] for r in keys.detect_primary_keys(tables).collect()}
    assert got == {
        "zeros": "a", "binary": "b", "nested": "pair", "held": "some", "none": None,
        "empty": "b_id", "marks": None, "nearly": "n",
    }


def test_detect_primary_key(spark):
    df = spark.range(5000).selectExpr("id % 10 AS some_id", "id AS n", "if(id = 3, NULL, id) AS other_id", "cast(id AS string) AS row_id")
    assert keys.detect_primary_key(df) == "row_id"
    assert keys.detect_primary_key(df.drop("row_id")) == "n"
    assert keys.detect_primary_key(df.select("some_id", "other_id")) is None
    rows = {r["column"]: (r["n"], r["non_null"], r["distinct"]) for r in keys.uniqueness(df).collect()}
    assert rows == {"some_id": (5000, 5000, 10), "n": (5000, 5000, 5000), "other_id": (5000, 4999, 4999), "row_id": (5000, 5000, 5000)}


def test_row_hash_ignores_column_order_and_keeps_nulls(spark):
    df = spark.createDataFrame([("1", None), ("1", "x")], "a string, b string")
    left = [r[0] for r in match.with_row_hash(df).select("row_hash").collect()]
    right = [r[0] for r in match.with_row_hash(df.select("b", "a")).select("row_hash").collect()]
    assert left == right and left[0] != left[1]
    text = json.dumps({"a": "1", "b": None}, separators=(",", ":"))
    assert left[0] == hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("mode", ["never", "always"])
def test_match_rows(spark, mode):
    rng = random.Random(1)
    def some(n, start):
        return [(start + i, rng.choice(["a", "a", "b", None, "z%d" % (start % 7)]), rng.choice("xy")) for i in range(n)]
    one_, two = some(40, 0), some(30, 100)
    schema = "rid long, k string, v string"
    a, b = spark.createDataFrame(one_, schema), spark.createDataFrame(two, schema)
    options = ReconOptions(skew=mode, skew_min_rows=1)
    got = {r[0]: r[1] for r in match.match_rows(a, b, "rid", "k", options).collect()}
    assert got == {r[0]: min(p[0] for p in two if p[1] == r[1]) for r in one_ if r[1] is not None and any(p[1] == r[1] for p in two)}
    got = {r[0]: r[1] for r in match.match_rows(a, b, "rid", None, options).collect()}
    assert got == {r[0]: min(p[0] for p in two if p[1:] == r[1:]) for r in one_ if any(p[1:] == r[1:] for p in two)}


def test_catalog(spark):
    kind = "schema string, table string"
    a = spark.createDataFrame([("s", "t"), ("s", "t"), ("s", "u")], kind)
    b = spark.createDataFrame([("d", "t"), ("d", "v")], kind)
    assert [r[0] for r in catalog.list_tables(a).collect()] == ["t", "u"]
    assert catalog.list_schema_tables(a).count() == 2
    assert [r[0] for r in catalog.common_tables(a, b).collect()] == ["t"]
    assert [r[0] for r in catalog.only_tables(a, b).collect()] == ["u"]
    status = {r[0]: r[1] for r in catalog.table_status(a, b).collect()}
    assert status == {"t": "both", "u": "source_only", "v": "destination_only"}
    assert {r[0] for r in catalog.mismatched_tables(a, b).collect()} == {"u", "v"}
    both = a.unionByName(b)
    assert catalog.schema_pair(both, ("s", "d")) == ("s", "d")
    assert catalog.schema_pair(both, ("s", "nope")) == ("d", "s")
    with pytest.raises(ValueError):
        catalog.schema_pair(a)


def test_overall_of_nothing_and_something(spark):
    schema = ("table string, rows_in_source long, rows_in_destination long, matching_rows long, different_rows long,"
              " missing_rows long, extra_rows long, has_differences boolean, success boolean")
    none = rollup.overall(spark.createDataFrame([], schema)).first()
    assert (none["total_tables"], none["all_matched"], none["match_percentage"]) == (0, True, 0.0)
    df = spark.createDataFrame([("a", 4, 4, 3, 1, 0, 0, True, False), ("b", 4, 4, 4, 0, 0, 0, False, True)], schema)
    row = rollup.overall(df).first()
    assert (row["total_matching_rows"], row["all_matched"], row["match_percentage"]) == (7, False, 87.5)
    assert {r["table_name"]: r["status_text"] for r in rollup.result_listing(df).collect()} == {"a": "1 different", "b": "Match"}


def test_missing_and_diff_listing_of_mixed_rows(spark):
    schema = "table string, status string, key string, source_row map<string,string>, destination_row map<string,string>, differences map<string,struct<source:string,destination:string>>"
    rows = [
        ("t", "missing", "1", {"k": "1", "v": None}, None, None),
        ("t", "missing", "2", {"k": "2", "w": "x"}, None, None),
        ("t", "different", "3", {"asset_id": "7", "k": "3"}, {"k": "3"}, {"asset_id": ("7", None)}),
        ("t", "different", "4", {"k": "4"}, {"k": "5"}, {"k": ("4", "5")}),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r["key"], r["field"]): r["value"] for r in rollup.missing_listing(df).collect()}
    assert got == {("1", "k"): "1", ("1", "v"): None, ("2", "k"): "2", ("2", "v"): "N/A"}
    got = {(r["row_id"], r["field"], r["source_value"], r["destination_value"]) for r in rollup.diff_listing(df).collect()}
    assert got == {("7", "asset_id", "7", None), ("N/A", "k", "4", "5")}


def test_caps_over_many_pieces(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS g", "id AS v")
    got = rollup.cap_rows(df, ["g"], ["v"], 7)
    assert sorted(r["v"] for r in got.collect()) == list(range(21))


def test_staged_keeps_rows_and_types(spark):
    df = spark.createDataFrame([({"a": None}, [1], None)], "m map<string,string>, a array<int>, x string")
    assert staged(df).collect() == df.collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_lookups_are_broadcast(spark):
    """Also without Spark's own broadcasts; larger tables are salted."""
    from pyspark.sql import functions as F

    from sparkrecon.operators import skew

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumn("t", F.col("id") % 3)
        small = spark.range(3).select(F.col("id").alias("t"), F.create_map(F.lit("a"), "id").alias("m"))
        joined = skew.lookup_join(big, small, ["t"], "inner", ["id"])
        assert "BroadcastHashJoin" in _plan(joined) and "Exchange hashpartitioning" not in _plan(joined)
        assert joined.count() == 1000 and skew._is_local(skew.small_table(small.where("false")))
        held, skew.LOOKUP_BYTES = skew.LOOKUP_BYTES, 10
        try:
            salted = skew.lookup_join(big, small, ["t"], "inner", ["id"])
            assert "SortMergeJoin" in _plan(salted) and salted.count() == 1000
        finally:
            skew.LOOKUP_BYTES = held
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from sparkrecon.operators.skew import repeat_rows

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).withColumn("n", F.lit(3).cast("long"))
        copies = repeat_rows(rows, "n")
        placed = copies.withColumn("p", F.spark_partition_id())
        counts = [r["count"] for r in placed.groupBy("p").count().collect()]
        assert sum(counts) == 6000 and max(counts) < 3000
        assert copies.groupBy("id").count().where("count = 3").count() == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_full_list_of_hot_keys_splits_the_rest(spark, monkeypatch):
    from sparkrecon.operators import skew

    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d"), (None, "e")], "k int, m string")
    one = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "w")], "k int, o string")
    want = sorted(map(str, many.join(one, ["k"], "full").collect()))
    for limit in (64, 1):
        monkeypatch.setattr(skew, "HOT_LIMIT", limit)
        got = skew.union_all(skew.join_one(many, one, ["k"], "full", ["1"]))
        assert sorted(map(str, got.collect())) == want
