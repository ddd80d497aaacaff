import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkrecon import FIRST_MATCH, INDEXED, ReconOptions, reconcile, reconcile_rows, reconcile_rows_once, reconcile_rows_summary, reconcile_summary
from sparkrecon.operators import rollup
from sparkrecon.operators.skew import hot_keys, repeat_rows

SCHEMA = "id string, a string, b int, o int"


def brute(src, dst, mode):
    """Statuses by plain loops over rows in order."""
    names = ("id", "a", "b", "o")
    out = Counter()
    def strip(v):
        return None if v is None else str(v).strip()
    if mode == INDEXED:
        index = {}
        for r in sorted(src, key=lambda r: r[3]):
            index[str(r[0]).strip()] = r
        seen = set()
        for r in dst:
            k = str(r[0]).strip()
            seen.add(k)
            if k not in index:
                out[k, "extra"] += 1
            else:
                same = all(strip(x) == strip(y) for x, y, n in zip(index[k], r, names) if n != "o")
                out[k, "match" if same else "different"] += 1
        for k in index:
            if k not in seen:
                out[k, "missing"] += 1
    else:
        firsts, used = {}, set()
        ordered = sorted(dst, key=lambda r: (r[3], str(r)))
        for i, r in enumerate(ordered):
            firsts.setdefault(str(r[0]), i)
        for r in src:
            k = str(r[0])
            if k not in firsts:
                out[k, "missing"] += 1
                continue
            used.add(firsts[k])
            d = ordered[firsts[k]]
            same = all(str(x) == str(y) for x, y, n in zip(r, d, names) if n != "o")
            out[k, "match" if same else "different"] += 1
        for i, r in enumerate(ordered):
            if i not in used:
                out[str(r[0]), "extra"] += 1
    return out


def random_rows(seed, n, hot):
    rng = random.Random(seed)
    keys = ["k%d" % i for i in range(8)] + [None, " k1 ", "None"]
    rows = []
    for i in range(n):
        key = "k0" if hot and rng.random() < 0.4 else rng.choice(keys)
        rows.append((key, rng.choice(["x", " x", "y", None, "None"]), rng.choice([1, 2, None]), i))
    return rows


@pytest.mark.parametrize("mode", [INDEXED, FIRST_MATCH])
@pytest.mark.parametrize("skew", ["never", "always"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, mode, skew, seed):
    src, dst = random_rows(seed, 60, True), random_rows(seed + 10, 60, True)
    # The order column is no field of the comparison.
    options = ReconOptions(mode=mode, skew=skew, skew_min_rows=1, exclude_fields=("o",))
    s, d = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(dst, SCHEMA)
    if mode == FIRST_MATCH:
        s = s.withColumnRenamed("o", "so")
        d = d.withColumnRenamed("o", "do")
        s, d = s.withColumnRenamed("so", "o_src"), d.withColumnRenamed("do", "o_dst")
        order = ["o_dst"]
        details = reconcile_first(s, d, order, options)
    else:
        details = reconcile(s, d, "id", ["o"], options)
    got = Counter((r["key"], r["status"]) for r in details.select("key", "status").collect())
    assert got == brute(src, dst, mode)


def reconcile_first(s, d, order, options):
    from sparkrecon.operators.reconcile import classified, typed_pair
    from dataclasses import replace
    pair = typed_pair(s, d, "id", None, options)
    # Only the destination is ordered in this mode.
    dst = pair.destination.withColumn("o", F.struct("r.o_dst"))
    pair = replace(pair, destination=dst)
    return pair.present(classified(pair))


@pytest.mark.parametrize("mode", [INDEXED, FIRST_MATCH])
@pytest.mark.parametrize("skew", ["never", "always"])
def test_summary_equals_details_with_copies(spark, mode, skew):
    """Exact copies of rows, also of the first row of a key."""
    rng = random.Random(5)
    def some(n):
        return [(rng.choice("ABCD"), rng.choice("xy"), rng.choice([1, None]), 0) for _ in range(n)]
    src, dst = some(80) + [("only", "x", 1, 0)], some(90) + [("other", "x", 1, 0)] * 3
    s, d = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(dst, SCHEMA)
    options = ReconOptions(mode=mode, skew=skew, skew_min_rows=1)
    counts = Counter(r["status"] for r in reconcile(s, d, "id", None, options).collect())
    row = reconcile_summary(s, d, "t", "id", None, options).first()
    assert (row["matching_rows"], row["different_rows"], row["missing_rows"], row["extra_rows"]) == tuple(
        counts[c] for c in ("match", "different", "missing", "extra")
    )
    assert (row["rows_in_source"], row["rows_in_destination"]) == (81, 93)
    if mode == FIRST_MATCH:
        keys = {r[0] for r in src} & {r[0] for r in dst}
        assert counts["extra"] == 93 - len(keys)
        assert sum(counts[c] for c in ("match", "different", "missing")) == 81


def test_digest_equals_exact(spark):
    src, dst = random_rows(3, 80, False), random_rows(4, 80, False)
    s, d = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(dst, SCHEMA)
    for mode in (INDEXED, FIRST_MATCH):
        options = ReconOptions(mode=mode)
        exact = reconcile_summary(s, d, "t", "id", ["o"], options)
        digest = reconcile_summary(s, d, "t", "id", ["o"], options, compare="digest")
        assert exact.collect() == digest.collect()


def test_digest_tells_null_from_shifted_values(spark):
    s = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "id int, x string, y string")
    d = spark.createDataFrame([(1, "a", None), (2, "a", None)], "id int, x string, y string")
    row = reconcile_summary(s, d, "t", "id", ["id"], compare="digest").first()
    assert (row["matching_rows"], row["different_rows"]) == (1, 1)


def test_differences_and_detail_rows(spark):
    s = spark.createDataFrame([("1", " a\t", None, 5), ("2", "b", "x", 6)], "id string, n string, z string, employee_id int")
    d = spark.createDataFrame([("1", "a", "None", 7), ("2", "b", "x", 8)], "id string, n string, z string, contractor_id int")
    by_key = {r["key"]: r for r in reconcile(s, d, "id").collect()}
    one, two = by_key["1"], by_key["2"]
    assert one["status"] == "different"
    assert {k: tuple(v) for k, v in one["differences"].items()} == {"z": (None, "None")}
    assert one["source_row"] == {"id": "1", "n": "a", "z": None, "employee_id": "5"}
    assert one["destination_row"]["contractor_id"] == "7"
    assert two["status"] == "match"
    assert two["source_row"] == {"id": "2", "n": "b", "z": "x"} and two["destination_row"] is None
    first = {r["key"]: r for r in reconcile(s, d, "id", options=ReconOptions(mode=FIRST_MATCH)).collect()}
    assert {k: tuple(v) for k, v in first["1"]["differences"].items()} == {"n": (" a\t", "a")}


def test_types_that_differ_are_compared_as_text(spark):
    s = spark.createDataFrame([(1, 2)], "id int, v int")
    d = spark.createDataFrame([("1", "2"), ("x", "3")], "id string, v string")
    got = Counter(r["status"] for r in reconcile(s, d, "id").collect())
    assert got == {"match": 1, "extra": 1}


def test_null_keys_meet(spark):
    s = spark.createDataFrame([(None, 1), (0, 2)], "id int, v int")
    d = spark.createDataFrame([(None, 1), (0, 3)], "id int, v int")
    got = {r["key"]: r["status"] for r in reconcile(s, d, "id").collect()}
    assert got == {"None": "match", "0": "different"}


def test_empty_side(spark):
    s = spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")
    none = s.limit(0)
    row = reconcile_summary(s, none, "t", "id").first()
    assert (row["missing_rows"], row["success"]) == (2, False)
    row = reconcile_summary(none, s, "t", "id").first()
    assert (row["extra_rows"], row["success"]) == (2, False)
    row = reconcile_summary(s, none, "t", "id", options=ReconOptions(compat_empty_side=True)).first()
    assert (row["rows_in_source"], row["missing_rows"], row["success"]) == (2, 0, True)


def test_bad_columns_are_errors(spark):
    s = spark.createDataFrame([(1, 1)], "id int, v int")
    with pytest.raises(ValueError, match="missing on the destination"):
        reconcile(s, s.drop("id"), "id")
    with pytest.raises(ValueError, match="only by case"):
        reconcile(s, s.withColumnRenamed("v", "V"), "id")


@pytest.mark.parametrize("mode", [INDEXED, FIRST_MATCH])
def test_symmetry_and_identity_on_unique_keys(spark, mode):
    a = spark.range(0, 50).select(F.col("id"), (F.col("id") % 7).alias("v"))
    b = spark.range(20, 70).select(F.col("id"), (F.col("id") % 5).alias("v"))
    options = ReconOptions(mode=mode)
    one = reconcile_summary(a, b, "t", "id", options=options).first()
    two = reconcile_summary(b, a, "t", "id", options=options).first()
    assert (one["missing_rows"], one["extra_rows"]) == (two["extra_rows"], two["missing_rows"]) == (20, 20)
    same = reconcile_summary(a, a, "t", "id", options=options).first()
    assert same["success"] and same["matching_rows"] == 50


@pytest.mark.parametrize("mode", [INDEXED, FIRST_MATCH])
@pytest.mark.parametrize("skew", ["never", "always"])
def test_long_form(spark, mode, skew):
    schema = "table string, key_column string, ord int, row map<string,string>"
    src = [
        ("t", "id", 1, {"id": "1", "a": "x"}), ("t", "id", 2, {"id": "1", "a": "y", "b": None}),
        ("t", "id", 3, {"id": "2"}), ("u", "k", 4, {"k": "1", "employee_id": "5"}), ("t", "id", 9, {"a": "keyless"}),
    ]
    dst = [
        ("t", "id", 1, {"id": "1", "a": "y"}), ("t", "id", 2, {"id": " 1 ", "a": "x"}),
        ("t", "id", 3, {"id": "3"}), ("u", "k", 4, {"k": "1", "employee_id": "6"}), ("u", "k", 5, {"k": "1"}),
    ]
    s, d = spark.createDataFrame(src, schema), spark.createDataFrame(dst, schema)
    options = ReconOptions(mode=mode, skew=skew, skew_min_rows=1)
    plain = reconcile_rows(s, d, options)
    details = Counter((r["table"], r["status"]) for r in plain.collect())
    counts, once = reconcile_rows_once(s, d, options)
    assert once.columns == plain.columns
    assert Counter(map(str, once.collect())) == Counter(map(str, plain.collect()))
    assert sorted(counts.collect()) == sorted(reconcile_rows_summary(s, d, options).collect())
    none = reconcile_rows_once(s.limit(0), d, replace(options, compat_empty_side=True))
    assert none[1].isEmpty() and {r["extra_rows"] for r in none[0].collect()} == {0}
    summary = {r["table"]: r for r in reconcile_rows_summary(s, d, options).collect()}
    if mode == INDEXED:
        assert details == {
            ("t", "match"): 1, ("t", "different"): 1, ("t", "missing"): 1, ("t", "extra"): 1, ("u", "match"): 2,
        }
    else:
        # ' 1 ' is another key here; the second row of u is a later duplicate.
        assert details == {
            ("t", "different"): 1, ("t", "match"): 1, ("t", "missing"): 1, ("t", "extra"): 2,
            ("u", "different"): 1, ("u", "extra"): 1,
        }
    assert summary["t"]["rows_in_source"] == 4 and summary["u"]["rows_in_destination"] == 2
    for name, row in summary.items():
        for status, column in zip(("match", "different", "missing", "extra"),
                                  ("matching_rows", "different_rows", "missing_rows", "extra_rows")):
            assert row[column] == details.get((name, status), 0)


def test_caps_and_listings(spark):
    s = spark.range(300).selectExpr("id", "'a' AS v")
    d = spark.range(500).selectExpr("id", "if(id % 2 = 0, 'a', 'b') AS v").where("id % 3 <> 0")
    details = reconcile(s, d, "id")
    capped = rollup.cap_details(details, 10)
    counts = Counter(r["status"] for r in capped.collect())
    assert counts == {"match": 10, "different": 10, "missing": 10, "extra": 10}
    want = sorted(str(i) for i in range(300) if i % 3 == 0)[:10]
    assert sorted(r["key"] for r in capped.where("status = 'missing'").collect()) == want
    listing = rollup.diff_listing(details)
    assert listing.count() == 100
    assert set(listing.columns) == {"row_id", "field", "source_value", "destination_value"}


def test_hot_keys_and_copies(spark):
    df = spark.range(1000).selectExpr("if(id < 400, 'hot', cast(id AS string)) AS k", "id AS v")
    assert hot_keys(df, ["k"], 50) == ["hot"]
    assert hot_keys(df.limit(0), ["k"], 50) == []
    two = df.selectExpr("'t' AS t", "k")
    assert hot_keys(two, ["t", "k"], 50) == ["1:thot"]
    many = spark.createDataFrame([("a", 25_001), ("b", 0), ("c", 1)], "x string, n long")
    assert {r["x"]: r["count"] for r in repeat_rows(many, "n").groupBy("x").count().collect()} == {"a": 25_001, "c": 1}


def _nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {n: plan.count(n) for n in ("Exchange hashpartitioning(k", "FileScan", "SortAggregate")}


def test_one_exchange_for_both_sides(spark, tmp_path):
    """``first_match`` reads and shuffles each side once, counts and extras included."""
    rows = [(i % 50, f"v{i % 7}") for i in range(300)]
    for name in ("s", "d"):
        spark.createDataFrame(rows, "k long, v string").write.parquet(str(tmp_path / name))
    src, dst = (spark.read.parquet(str(tmp_path / n)) for n in ("s", "d"))
    options = ReconOptions(mode="first_match", skew="never")
    for found in (
        reconcile(src, dst, "k", options=options),
        reconcile_summary(src, dst, "t", "k", options=options),
    ):
        nodes = _nodes(found)
        assert nodes["FileScan"] == 2 and nodes["SortAggregate"] == 0
        assert nodes["Exchange hashpartitioning(k"] == 1


def test_long_counts_read_each_side_once(spark, tmp_path):
    rows = [("t" if i % 2 else "u", "k", i, {"k": str(i % 9), "v": "x"} if i % 5 else {"v": "x"}) for i in range(200)]
    schema = "`table` string, key_column string, ord long, row map<string,string>"
    for name in ("s", "d"):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    src, dst = (spark.read.parquet(str(tmp_path / n)) for n in ("s", "d"))
    for mode in ("indexed", "first_match"):
        found = reconcile_rows_summary(src, dst, ReconOptions(mode=mode, skew="never"))
        assert _nodes(found)["FileScan"] == 2
        # Rows without the key field are counted, but have no class.
        assert {r["rows_in_source"] for r in found.collect()} == {100}
        for r in found.collect():
            classes = sum(r[c] for c in ("matching_rows", "different_rows", "missing_rows"))
            assert classes == (80 if mode == "first_match" else r["matching_rows"])
