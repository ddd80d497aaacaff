"""Steps that once cost many times what their input is worth."""

import time

from pyspark.sql import functions as F

from sparkrecon.operators import chunks
from sparkrecon.operators.keys import first_fields
from sparkrecon.operators.stage import staged
from sparkrecon.operators.tables import to_rows
from sparkrecon.options import IngestOptions
from sparkrecon.sources import nesting
from sparkrecon.sources import patterns as P
from sparkrecon.sources.dumps import inserts, parse_statements, scan_directory, statements_of_text


def seconds(df) -> float:
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def test_deep_calls_cost_runs_not_tokens(spark):
    """10,000 texts of 3,000 tokens each, some microseconds a token before."""
    call = F.concat(F.repeat(F.lit("f("), 1000), F.col("id").cast("string"), F.repeat(F.lit(")"), 1000))
    marked = nesting.marked(F.col("t"), P.token_pattern(IngestOptions(), commas=False))

    def cut(n: int):
        return spark.range(0, n, 1, 4).select(call.alias("t")).select(nesting.groups(marked))

    seconds(cut(400))
    took = seconds(cut(10_000))
    assert took < 9, took


def test_keys_of_dumps_need_no_maps(spark):
    """The fields of a table's rows are read from the lists of columns; the rows, as maps,
    were put together for them before."""
    texts = spark.createDataFrame(
        [("a.sql", "INSERT INTO t (a_id, b, b) VALUES (1, 2, 3), (4, 5, 6);")], "path string, content string"
    )
    rows = to_rows(inserts(parse_statements(statements_of_text(texts))), True)
    found = first_fields(rows, "names")
    assert found.collect() == [("t", ["a_id", "b"])]
    assert found.collect() == first_fields(rows.drop("fields"), "names").collect()
    pruned = rows.select("table", "fields")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in pruned


def test_chunks_are_written_once(spark, tmp_path, monkeypatch):
    """Chunks of no file go straight to their place; they were staged and copied before."""
    kept = []
    monkeypatch.setattr(chunks, "staged", lambda df: kept.append(df.columns) or staged(df))
    store = chunks.ChunkStore(spark, str(tmp_path))
    names = [("a", 0), ("b", 1)]
    rows = spark.createDataFrame(
        [("one", t, [i], {"v": f"{t}{i}"}) for t, n in names for i in range(n, 5)],
        "schema string, table string, ord array<int>, row map<string,string>",
    )
    chunks.store_rows(rows, store)
    # Only the sorted rows were kept, with their numbers and texts.
    assert len(kept) == 1 and "content" in kept[0] and "row" not in kept[0]
    held = store.read().select("id", "content").orderBy("id").collect()
    want = [(f"one_{t}_{i - n}", f'{{"v":"{t}{i}"}}') for t, n in names for i in range(n, 5)]
    assert [tuple(r) for r in held] == want
    chunks.store_rows(rows, store)
    assert store.read().count() == len(want)
    assert store.write(chunks.with_chunk_ids(chunks.rows_to_chunks(rows.limit(0)))) == 3
    assert store.read().count() == len(want)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Files up to 256 MiB were one task's work before."""
    row = "INSERT INTO t (a, b) VALUES (1, '" + "x" * 1000 + "');\n"
    (tmp_path / "a.sql").write_text(row * 12_000)
    found = scan_directory(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 1 and sum(r["count"] for r in found) == 12_000


def test_the_rest_of_a_text_is_skipped_not_looked_up():
    """Classes of all signs took most of the time of ``quote_aware`` reading."""
    for options in (IngestOptions(), IngestOptions(backslash_escapes=False), IngestOptions.historic()):
        used = [P.closed_prefix(options), *P.closing_patterns(options).values()]
        used.append(P.token_pattern(options, commas=False))
        assert not [p for p in used if r"[\s\S]*+" in p]
