"""The registered queries over whole small tables, against SQL or plain loops."""

import hashlib
import os
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkrecon.llm import toxicity
from sparkrecon.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import (
    WORDS,
    base_spans,
    classes,
    linked,
    shingle_set,
    u32,
    whole_ids,
)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return dict(
        duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    )


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(want.columns)
    df = df.select(want.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op4_personal_data", "op8_fingerprints", "op9_token_files", "op10_sharding"])
def test_a_row_per_document(spark, documents, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id] or ""
        if name == "op1_byte_bpe":
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if name == "op4_personal_data":
            spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
            assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        if name == "op8_fingerprints":
            assert r.n_chars == len(text)
        if name == "op10_sharding":
            assert r.text_crc32 == zlib.crc32(text.encode()) and r.grown_shard in (r.shard, 40)
    if name == "op9_token_files":
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == at
            at += r.n_tokens


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, sf_dir).collect()
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    caught = [p for p, t in tested if t == 1]
    wrong = [p for p, t in tested if t == 0]
    assert len(caught) > 20 and sum(caught) >= 0.8 * len(caught)
    assert sum(wrong) <= 0.01 * len(wrong)


def test_pipeline_against_plain_stages(spark):
    """Each stage on its own input, by plain loops where its method allows it."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
        if name == "toxicity":
            scores = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model)
            assert sorted(kept) == sorted(r.doc_id for r in scores.where("predicted = 0").collect())
        if name == "exact_dedup":
            last = {}
            for doc_id, text in sorted(rows):
                last["".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")] = doc_id
            assert sorted(kept) == sorted(last.values())
        if name == "jaccard_join":
            _, component = classes(rows)
            first = {}
            for (doc_id, _), c in zip(rows, component, strict=True):
                first[c] = min(doc_id, first.get(c, doc_id))
            assert sorted(kept) == sorted(first.values())
        if name == "personal_data":
            assert sorted(kept) == sorted(d for d, _ in rows)
            assert all(not base_spans(t) for t in kept.values())
    pieces = stages["packing"](spark, docs, SF_DIR).collect()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
        assert p.length <= 4096
    assert all(lengths[p.doc_id] == p.doc_tokens for p in pieces) and set(lengths) == set(kept)
    library = Tokenizer.from_file(WORDS)
    want = {d: u32([*library.encode(t, add_special_tokens=False).ids, 2]) for d, t in kept.items()}
    assert whole_ids(pieces) == want


def test_numbers_of_links(spark, documents):
    sets = {d: shingle_set(t) for d, t in documents.items()}
    got = {r.doc_id: r.n_links for r in QUERIES["op5_jaccard_join"](spark, SF_DIR).collect()}
    assert got == {
        d: sum(bool(linked(s, other)) for e, other in sets.items() if e != d) for d, s in sets.items()
    }
    assert max(got.values()) > 0


def test_packing_query(spark, documents):
    library = Tokenizer.from_file(WORDS)
    rows, found = QUERIES["op6_packing"](spark, SF_DIR).collect(), {}
    assert "ids" not in rows[0].asDict()
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert sorted(found) == sorted(documents)
    for d, pieces in found.items():
        ids = u32([*library.encode(documents[d] or "", add_special_tokens=False).ids, 2])
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * at])
        assert 4 * at == len(ids)
