import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkrecon import ReconOptions, RunOptions, run
from sparkrecon.operators import chunks, expectations as E
from sparkrecon.operators.tables import long_form
from sparkrecon.plans.validation import load_chunks
from sparkrecon.sources.reports import ReportStore, list_report_files, report_files, table_documents


def suite_of(spark):
    df = spark.createDataFrame(
        [(None, "2020-01-02", "x", None, 1)], "n int, hire_DATE string, t string, empty string, m int"
    )
    return df, {(r["column"], r["rule"]) for r in E.infer_suite(df, "t").collect()}


def test_infer_suite(spark):
    _, rules = suite_of(spark)
    assert rules == {
        ("n", "column_exists"), ("hire_DATE", "column_exists"), ("t", "column_exists"),
        ("empty", "column_exists"), ("m", "column_exists"),
        ("hire_DATE", "date_format"), ("t", "text_type"), ("m", "numeric_type"),
    }
    assert E.suite_name("t") == "t_data_expectations"


def test_validate(spark):
    src, _ = suite_of(spark)
    dst = spark.createDataFrame(
        [("2020-01-02", 5, "7"), ("02/01/2020", 6, None), (None, 7, "x"), ("2020-1-2", 8, "1.5")],
        "hire_DATE string, t int, m string",
    )
    got = {(r["column"], r["rule"]): r for r in E.compare(src, dst, "t").collect()}
    assert not got["n", "column_exists"]["success"] and got["t", "column_exists"]["success"]
    date = got["hire_DATE", "date_format"]
    assert (date["success"], date["element_count"], date["missing_count"], date["unexpected_count"]) == (False, 4, 1, 2)
    assert abs(date["unexpected_percent"] - 200 / 3) < 1e-9
    assert got["t", "text_type"]["unexpected_count"] == 4
    assert got["m", "numeric_type"]["unexpected_count"] == 1
    assert ("n", "numeric_type") not in got
    validated = E.validate(dst, E.infer_suite(src, "t"), "t")
    assert Counter(map(str, validated.collect())) == Counter(map(str, got.values()))
    stats = E.statistics(validated).first()
    assert (stats["evaluated_expectations"], stats["successful_expectations"], stats["success"]) == (8, 3, False)


def test_dates_are_formatted(spark):
    src = spark.createDataFrame([("2020-01-02",)], "birth_date string")
    dst = src.select(F.to_date("birth_date").alias("birth_date"))
    assert all(r["success"] for r in E.compare(src, dst, "t").collect())


def test_long_and_typed_agree_on_text(spark):
    src = spark.createDataFrame([("1", "2020-01-02", None)], "k string, due_date string, e string")
    dst = spark.createDataFrame([("1", "x", "a"), ("2", None, None)], "k string, due_date string, e string")
    typed = E.compare(src, dst, "t")
    long = E.compare_rows(long_form(src, "t", ["k"]), long_form(dst, "t", ["k"]))
    assert Counter(map(str, long.select(typed.columns).collect())) == Counter(map(str, typed.collect()))


def test_positions_and_ids(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "999 - id AS v")
    got = chunks.numbered(df, ["g"], ["v"]).collect()
    assert {r["g"]: sorted((x["v"], x["row_id"]) for x in got if x["g"] == r["g"]) for r in got} == {
        g: [(v, i) for i, v in enumerate(v for v in range(1000) if (999 - v) % 2 == g)] for g in (0, 1)
    }
    ties = chunks.numbered(df, [], ["g"], unique=False).collect()
    assert sorted(r["row_id"] for r in ties) == list(range(1000))
    assert all(r["g"] == r["row_id"] // 500 for r in ties)
    made = chunks.to_chunks(spark.createDataFrame([("b", None), ("a", 'q"')], "k string, v string"), "s", "t", ["k"])
    rows = {r["id"]: json.loads(r["content"]) for r in chunks.with_chunk_ids(made).collect()}
    assert rows == {"s_t_0": {"k": "a", "v": 'q"'}, "s_t_1": {"k": "b", "v": None}}
    assert [r["chunk_count"] for r in chunks.chunk_counts(made).collect()] == [2]


def test_default_ids(spark):
    schema = "content string, metadata struct<schema:string,table:string,row_id:long,file_id:string>"
    df = spark.createDataFrame(
        [("a", (None, "t", None, "f")), ("b", ("s", None, None, "f")), ("c", (None, None, None, None)), ("d", ("s", "t", 7, None))],
        schema,
    )
    got = {r["content"]: r["id"] for r in chunks.with_chunk_ids(df, ["content"]).collect()}
    # Position within the file, or position plus the number of chunks.
    assert got == {"a": "default_t_0", "b": "s_default_1", "c": "default_default_4", "d": "s_t_7"}


def store_frame(spark, rows):
    schema = "id string, content string, metadata struct<schema:string,table:string,row_id:long,file_id:string>"
    return spark.createDataFrame([(i, c, ("s", "t", 0, f)) for i, c, f in rows], schema)


def test_store_replaces_files_and_keeps_ids(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path / "store"))
    assert store.read() is None
    def held():
        return {(r["id"], r["content"], r["metadata"]["file_id"]) for r in store.read().collect()}
    first = [("1", "a", "007"), ("2", "b", "007"), ("3", "c", "8"), ("4", "d", None)]
    store.write(store_frame(spark, first))
    assert held() == set(first)
    store.write(store_frame(spark, [("1", "new", "007"), ("3", "taken", "007"), ("4", "again", None), ("5", "e", "")]))
    assert held() == {("1", "new", "007"), ("3", "c", "8"), ("4", "d", None), ("5", "e", None)}
    # All new ids of a file are taken: nothing is left of it.
    store.write(store_frame(spark, [("3", "taken", "007")]))
    assert held() == {("3", "c", "8"), ("4", "d", None), ("5", "e", None)}
    old = store_frame(spark, first)
    new = store_frame(spark, [("1", "new", "007"), ("3", "taken", "007"), ("4", "again", None)])
    merged = {(r["id"], r["content"]) for r in chunks.upsert_chunks(old, new).collect()}
    assert merged == {("1", "new"), ("3", "c"), ("4", "d")}


def test_store_versions(spark, tmp_path):
    store = chunks.ChunkStore(spark, str(tmp_path / "store"))
    first = [("1", "a", "f"), ("2", "b", "g"), ("3", "c", None)]
    assert store.write(store_frame(spark, first)) == 1
    # One write replaces a file and appends: its plain chunk 1 gives way to the file's.
    assert store.write(store_frame(spark, [("1", "n", "f"), ("1", "p", None), ("4", "d", None)])) == 2

    def held(version=None):
        return sorted((r["id"], r["content"], r["metadata"]["file_id"]) for r in store.read(version).collect())

    second = [("1", "n", "f"), ("2", "b", "g"), ("3", "c", None), ("4", "d", None)]
    assert (held(), held(1), store.versions()) == (second, first, [1, 2])
    with pytest.raises(ValueError, match="no version 7"):
        store.read(7)

    # A write that dies before it commits, whatever it wrote, changes nothing.
    def dies(*_):
        raise OSError("lost")

    broken = chunks.ChunkStore(spark, store.path)
    broken._commit = dies
    with pytest.raises(OSError):
        broken.write(store_frame(spark, [("9", "x", "f")]))
    assert (held(), store.versions()) == (second, [1, 2])

    # Of two writes that start from one version the later fails and is repeated.
    late = chunks.ChunkStore(spark, store.path)
    commit = late._commit

    def overtaken(*args):
        store.write(store_frame(spark, [("5", "e", None)]))
        return commit(*args)

    late._commit = overtaken
    with pytest.raises(RuntimeError, match="by another"):
        late.write(store_frame(spark, [("6", "f", None)]))
    third = [*second, ("5", "e", None)]
    assert (held(), store.versions()) == (third, [1, 2, 3])

    # Wider chunks widen the store; older ones hold nulls.
    wide = store_frame(spark, [("7", "w", "g")]).withColumn("note", F.lit("n"))
    assert store.write(wide) == 4
    noted = {r["id"]: r["note"] for r in store.read().collect()}
    assert noted == {"1": None, "3": None, "4": None, "5": None, "7": "n"}
    before = held()
    assert store.compact() == 5 and held() == before
    store.expire()
    assert (held(), store.versions()) == (before, [5])
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1
    assert store.write(store_frame(spark, [])) == 6 and held() == before


def test_embeddings(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "content string")
    rows = chunks.hashed_embeddings(df, size=16).collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6
    assert rows[1]["embedding"] == [0.0] * 16

    def load():
        return lambda texts: [[len(t), 1.0] for t in texts]

    got = chunks.embed(df, load).orderBy("content").collect()
    assert [r["embedding"] for r in got] == [[0.0, 1.0], [5.0, 1.0]]


def dumps(folder):
    """Demo dumps of our own with the shape and outcome of the known ones: 50
    common tables of 5 rows, duplicate keys, tables without an id."""
    sides = []
    for side in (0, 1):
        parts = []
        for n in range(1, 51):
            ids = [1, 2, 3, 4, 5] if n != 2 else [1, 2, 3, 5, 5]
            if n >= 49:
                body = [f"('p{n}{side}{i}', CURRENT_TIMESTAMP)" for i in range(5)]
                parts.append(f"INSERT INTO table_{n} (name, created_at) VALUES\n" + ",\n".join(body) + ";")
                continue
            same = {1, 4} if n == 1 else set()
            body = [f"({i}, '{'same' if i in same else 's%d' % side} {n} {i} {j}', CURRENT_TIMESTAMP)" for j, i in enumerate(ids)]
            parts.append(f"INSERT INTO table_{n} (id, name, created_at) VALUES\n" + ",\n".join(body) + ";")
            if n == 1 and side:
                parts.append("(6, 'after the end', CURRENT_TIMESTAMP),\n(7, 'ignored', CURRENT_TIMESTAMP);")
        if side == 0:
            parts += [f"INSERT INTO extra_table_{n} (info, created_by) VALUES ('a', 'b');" for n in (1, 2)]
        folder.mkdir(exist_ok=True)
        (folder / f"schema_{side}.txt").write_text("\n".join(parts))
        sides.append(str(folder / f"schema_{side}.txt"))
    return sides


def totals(result):
    row = result.overall.first()
    return tuple(
        row[f"total_{c}"]
        for c in ("tables", "rows_source", "rows_destination", "matching_rows", "different_rows", "missing_rows", "extra_rows")
    )


def test_document_run(spark, tmp_path):
    dumps(tmp_path / "in")
    options = {"data_directory": str(tmp_path / "in"), "schemas": ["schema_0", "schema_1"],
               "report_directory": str(tmp_path / "out"), "chunk_store": str(tmp_path / "chunks")}
    result = run(spark, options)
    assert totals(result) == (50, 250, 250, 2, 238, 10, 11)
    status = Counter(r["status"] for r in result.table_status.collect())
    assert status == {"both": 50, "source_only": 2}
    assert all(r["success"] for r in result.expectations.collect())
    store = ReportStore(spark, str(tmp_path / "out"))
    listed = store.list_reports().collect()
    assert [(r["report_id"], r["total_rows"], r["match_percentage"]) for r in listed] == [(result.report_id, 250, 0.8)]
    assert store.get("nope").count() == 0 and store.get(result.report_id).count() == 1
    counts = Counter(r["status"] for r in store.details(result.report_id).collect())
    assert counts == {"match": 2, "different": 238, "missing": 10, "extra": 11}
    held = chunks.ChunkStore(spark, str(tmp_path / "chunks")).read()
    assert held.count() == 502 and held.select("id").distinct().count() == 502
    nested = table_documents(result.summary, result.details, 3).where("table = 'table_1'").first()
    assert [len(nested["details"][c]) for c in ("matching_rows", "different_rows", "missing_rows")] == [2, 3, 0]


def test_direct_run(spark, tmp_path):
    source, destination = dumps(tmp_path / "in")
    options = RunOptions(
        schemas=("one", "two"), use_direct_comparison=True, source_files=(source,), dest_files=(destination,),
        max_differences=3, run_expectations=False,
    )
    result = run(spark, options)
    assert totals(result) == (50, 250, 250, 2, 238, 10, 10)
    counts = Counter(r["status"] for r in result.listing.where("table = 'table_49'").collect())
    assert counts == {"missing": 3, "extra": 3}
    whole = Counter(r["status"] for r in result.details.collect())
    assert whole["missing"] == 10 and whole["different"] == 238
    assert result.rejects.count() == 0 and result.unreadable.count() == 0
    two = result.summary.where("table = 'table_2'").first()
    assert (two["different_rows"], two["extra_rows"]) == (5, 0)


def test_yaml_options_and_paths(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("schemas: [a, b]\ndata_directory: /data/\nschema_paths: {b: /other}\nchunk_size: 500\n")
    options = RunOptions.from_yaml(str(path))
    assert options.schema_pair() == ("a", "b")
    assert (options.directory_of("a"), options.directory_of("b")) == ("/data/a", "/other")
    assert options.recon_options == ReconOptions(mode="first_match")


def test_nested_options():
    import pytest

    options = RunOptions.from_dict(
        {"recon": {"mode": "indexed", "exclude_fields": ["a"]}, "ingest": {"recursive": True}}
    )
    assert options.recon == ReconOptions(exclude_fields=("a",)) and options.ingest.recursive
    for wrong in ({"schema": []}, {"recon": {"modus": "x"}}, {"ingest": {"deep": 1}}):
        with pytest.raises(ValueError, match="unknown options"):
            RunOptions.from_dict(wrong)


def test_details_are_whole_and_rejects_reported(spark, tmp_path):
    """300 differing rows stay 300, whatever the listing and the documents hold."""
    one, two = tmp_path / "one.sql", tmp_path / "two.sql"
    rows = [f"INSERT INTO t (asset_id, v) VALUES ({i}, 'a');" for i in range(300)]
    one.write_text("\n".join([*rows, "INSERT INTO t (asset_id, v) VALUES (1, 2, 3);"]))
    two.write_text("\n".join(rows).replace("'a'", "'b'"))
    other = tmp_path / "three.pdf"
    other.write_text("x")
    options = RunOptions(
        schemas=("one", "two"), use_direct_comparison=True, source_files=(str(one), str(other)),
        dest_files=(str(two),), run_expectations=False, max_differences=1000, document_rows=7,
        report_directory=str(tmp_path / "r"),
    )
    result = run(spark, options)
    store = ReportStore(spark, str(tmp_path / "r"))
    assert store.details(result.report_id).count() == result.listing.count() == 300
    document = spark.read.json(f"{tmp_path}/r/documents/report_id={result.report_id}").first()
    assert document["truncated"] and len(document["details"]["different_rows"]) == 7
    assert [r["reason"] for r in result.rejects.collect()] == ["arity_mismatch"]
    assert [r["path"] for r in result.unreadable.collect()] == [str(other)]


def test_key_missing_on_destination_is_an_error(spark, tmp_path):
    import pytest

    one, two = tmp_path / "a.sql", tmp_path / "b.sql"
    one.write_text("INSERT INTO t (asset_id, v) VALUES (1, 2);")
    two.write_text("INSERT INTO t (v) VALUES (2);")
    options = RunOptions(schemas=("a", "b"), use_direct_comparison=True, source_files=(str(one),), dest_files=(str(two),))
    with pytest.raises(ValueError, match="asset_id"):
        run(spark, options)


def test_load_chunks(spark, tmp_path):
    dumps(tmp_path / "in")
    counts = load_chunks(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    assert counts.count() == 102


def test_single_document_reports(spark, tmp_path):
    for name, moment, source, matching in (("a", "2024-01-01T00:00:00", 8, 3), ("b", "2024-02-01T00:00:00", 0, 0)):
        (tmp_path / f"validation_report_{name}.json").write_text(
            json.dumps(
                {
                    "meta": {"source_schema": "s", "destination_schema": "d", "timestamp": moment, "tables_compared": 2},
                    "summary": {"total_rows_source": source, "total_matching_rows": matching, "all_matched": False},
                    "table_comparisons": {"t": {"details": [1, 2]}},
                },
                indent=2,
            )
        )
    (tmp_path / "other.json").write_text("{}")
    got = [(r["report_id"], r["match_percentage"], r["different_rows"]) for r in list_report_files(spark, str(tmp_path)).collect()]
    assert got == [("b", 0.0, 0), ("a", 37.5, 0)]
    assert report_files(spark, str(tmp_path)).where("report_id = 'a'").count() == 1
