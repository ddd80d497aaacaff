"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.llm import (
    byte_bpe,
    conversation_trie,
    exact_dedup,
    fingerprints,
    jaccard_join,
    ns_kmeans,
    packing,
    personal_data,
    sharding,
    simhash,
    token_files,
    toxicity,
    url_filter,
)
from sparkrecon.llm.common import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_IDS = public_tokenizers.path("word_bpe_49k.json")

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages. Labels: a page whose number is a document that ``labels``
    calls toxic or of low quality is one to block, any other labelled one is not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    mined = url_filter.mine_rules(pages.join(labels, "page_id").select("url", "blocked"))
    return url_filter.judge(pages, RULES, mined)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a machine fitted on rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, by a model learned on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.report(docs, personal_data.learn(docs))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked from a similarity of 0.75."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096, the ids by their checksums."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_IDS).drop("ids")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the token files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_IDS)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    index = exact_dedup.DigestIndex(spark, f"op7_digests_{uuid.uuid4().hex}")
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, and where 41 shards would put them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.assign(docs, sharding.tree_of(40), sharding.tree_of(41))
    return sharding.with_slots(rows, docs.count()).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op11_ns_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters, by five rounds."""
    return ns_kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5).rows


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked from fingerprints that differ in four bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), reach=4)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the start of another."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_files": op9_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_sharding": op10_sharding,
    "op11_ns_kmeans": op11_ns_kmeans,
    "op12_simhash": op12_simhash,
    "op13_conversation_trie": op13_conversation_trie,
}

def _lloyd_sql(rounds: int) -> str:
    """Exact k-means in SQL: ``a`` is an assignment, ``c`` are centroids."""
    nearest = """
        a{t} AS (SELECT n, min(v) AS v, min({{'d': d, 'j': j}}).d AS d, min({{'d': d, 'j': j}}).j AS j FROM (
            SELECT n, v, j, CAST(list_sum(list_transform(list_zip(v, c),
                lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{t})
            GROUP BY n)"""
    means = """
        c{u} AS (SELECT c{t}.j, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
            SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) r(i) GROUP BY j, i)
            GROUP BY j) m ON m.j = c{t}.j)"""
    steps = [nearest.format(t=0)]
    for t in range(rounds):
        steps += [means.format(t=t, u=t + 1), nearest.format(t=t + 1)]
    return f"""
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64
                AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v AS c
            FROM v WHERE vec_id IS NOT NULL ORDER BY j LIMIT 40),{",".join(steps)}
        SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.j = a.j"""


ORACLE_SQL: dict[str, str] = {
    "op13_conversation_trie": """
        WITH t AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (
            SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST,
                substr(sha256(length(r) || ':' || r || x), 1, 32)) AS l,
                xor(list_reduce(
                    list_concat([4294967295], list_transform(
                        string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                    lambda a, b: list_reduce(
                        list_concat([xor(a, b)], list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
                        lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 9 AS h
            FROM t GROUP BY c),
        b AS (
            SELECT a.c, list_concat(list_slice(coalesce(o.l, []), 1, a.h), list_slice(a.l, a.h + 1, len(a.l))) AS l
            FROM o a LEFT JOIN o ON o.c = a.c - a.c % 5),
        p AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM b),
        m AS (
            SELECT list_slice(l, 1, d) AS k, d, min(c) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(CASE WHEN len(l) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
            FROM p GROUP BY k, d),
        w AS (
            SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0
            GROUP BY ALL),
        n AS (
            SELECT m.*, coalesce(n_children, 0) AS n_children,
                CASE WHEN m.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(m.k[m.d].x) END AS saved
            FROM m LEFT JOIN w ON w.k = m.k AND w.d = m.d),
        u AS (SELECT k, d, n_children, saved, unnest(range(0, d + 1)) AS a FROM n),
        s AS (
            SELECT list_slice(k, 1, a) AS k, a AS d, CAST(sum(saved) AS BIGINT) AS saved_tokens,
                count(*) FILTER (n_children = 0) AS n_leaves
            FROM u GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children,
            s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s ON s.k = n.k AND s.d = n.d
        LEFT JOIN n q ON q.d = n.d - 1 AND q.k = list_slice(n.k, 1, n.d - 1)""",
    "op11_ns_kmeans": _lloyd_sql(5),
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                END) AS s
            FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS c
              FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (n - c)),
        r(doc_id, m) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.m) AS component_id,
            (SELECT count(*) FROM l WHERE l.x = s.doc_id) AS n_links
        FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
              FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
}
