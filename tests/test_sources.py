import io
import zipfile

from sparkrecon.options import IngestOptions
from sparkrecon.sources.dumps import (
    ingest_directory,
    ingest_files,
    rejected_files,
    unreadable_documents,
)


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(
        "<w:p>" + "".join(f"<w:r><w:t xml:space='preserve'>{part}</w:t></w:r>" for part in p.split("|")) + "</w:p>"
        for p in paragraphs
    )
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr(
            "word/document.xml", f"<w:document xmlns:w='{space}'><w:body>{body}</w:body></w:document>"
        )
    return data.getvalue()


def tables(df):
    return sorted((r["schema"], r["table"], tuple(r["values"])) for r in df.collect())


def test_flat_directory(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO t VALUES (1);")
    (tmp_path / "b.txt").write_bytes("INSERT INTO t VALUES ('é');\r\nINSERT INTO t VALUES ('x\r\ny');".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx("INSERT INTO s.d (a, b)", "VALUES ('x|y', null), (')', 2), (3, );"))
    (tmp_path / "d.csv").write_text("INSERT INTO t VALUES (9);")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.sql").write_text("INSERT INTO t VALUES (7);")
    got = tables(ingest_directory(spark, str(tmp_path)))
    assert got == [
        ("a", "t", ("1",)),
        ("b", "t", ("x\ny",)),
        ("b", "t", ("é",)),
        ("s", "d", ("xy", None)),
    ]
    deep = tables(ingest_directory(spark, str(tmp_path), IngestOptions(recursive=True)))
    assert set(deep) - set(got) == {("e", "t", ("7",))}


def test_explicit_files_and_rejects(spark, tmp_path):
    one, two, three = tmp_path / "A.SQL", tmp_path / "x.csv", tmp_path / "bad.docx"
    one.write_text("INSERT INTO t VALUES (1);")
    two.write_text("INSERT INTO t VALUES (2);")
    three.write_bytes(b"no archive")
    paths = [str(p) for p in (one, two, three)]
    assert tables(ingest_files(spark, paths)) == [("A", "t", ("1",))]
    assert [tuple(r) for r in rejected_files(spark, paths).collect()] == [
        (str(two), "unsupported_extension")
    ]
    bad = unreadable_documents(spark, [str(tmp_path)]).collect()
    assert [r["reason"] for r in bad] == ["unreadable"]


def test_statement_split_equals_whole_files(spark, tmp_path):
    text = "".join(f"INSERT INTO t (a, b) VALUES ({i}, 'v{i}'), ({i}, 'é');\n" for i in range(3000))
    (tmp_path / "big.sql").write_text("-- head\n" + text, encoding="utf-8")
    whole = ingest_directory(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = ingest_directory(spark, str(tmp_path), IngestOptions(split="statement"))
        assert split.rdd.getNumPartitions() > 1
        ordered = [tuple(r["values"]) for r in split.orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [tuple(r["values"]) for r in whole.orderBy("ord").collect()]


def test_large_files_are_split_on_their_own(spark, tmp_path):
    (tmp_path / "big.sql").write_text("".join(f"INSERT INTO t VALUES ({i});" for i in range(200)))
    (tmp_path / "small.sql").write_text("INSERT INTO t VALUES ('s'); INSERT INTO t VALUES ('open')")
    options = IngestOptions(whole_file_bytes=1000)
    got = tables(ingest_directory(spark, str(tmp_path), options))
    assert got == tables(ingest_directory(spark, str(tmp_path))) and len(got) == 201
    aware = IngestOptions(whole_file_bytes=1000, quote_aware=True)
    assert tables(ingest_directory(spark, str(tmp_path), aware)) == got


def test_empty_directory(spark, tmp_path):
    assert ingest_directory(spark, str(tmp_path)).count() == 0


def test_docx_dialect(spark, tmp_path):
    (tmp_path / "m.docx").write_bytes(
        docx(r"insert into t values (1,'it\'s', 'a,b','NULL'), ('two''s', , null,'z'), (1,2,3,);")
    )
    got = [tuple(r["values"]) for r in ingest_directory(spark, str(tmp_path)).orderBy("ord").collect()]
    # Doubled quotes stay, an empty item stays, a trailing empty item does not count.
    assert got == [("1", r"it\'s", "a,b", "NULL"), ("two''s", "", None, "z")]


def test_whole_and_split_readers_agree(spark, tmp_path):
    """Tails without semicolon, blanks and signs in names, one byte that is not UTF-8."""
    one = "INSERT INTO t (a) VALUES ('é');\nINSERT INTO t (a) VALUES (2)"
    (tmp_path / "my dump+1.sql").write_bytes(one.encode() + b";\n")
    (tmp_path / "x[1].sql").write_bytes(one.encode())
    (tmp_path / "tail.sql").write_bytes(one.encode() + b"; INSERT INTO t (a) VALUES (3)")
    (tmp_path / "latin.sql").write_bytes(one.encode() + b"; -- \xe9\nINSERT INTO t (a) VALUES (4);")
    found = []
    for options in (
        IngestOptions(split="file"), IngestOptions(split="statement"),
        IngestOptions(split="auto", whole_file_bytes=5),
    ):
        rows = ingest_directory(spark, str(tmp_path), options).select("schema", "values").collect()
        found.append(sorted((r["schema"], r["values"][0]) for r in rows))
    assert found[0] == found[1] == found[2]
    latin = "é".encode().decode("latin-1")
    assert found[0] == sorted(
        [("my dump+1", "2"), ("my dump+1", "é"), ("x[1]", "é"), ("tail", "2"), ("tail", "é"),
         ("latin", "2"), ("latin", latin), ("latin", "4")]
    )
