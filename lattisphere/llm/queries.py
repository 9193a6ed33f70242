"""The opN queries: each operator over its whole table with production parameters, and the digests of its results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS s FROM g),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN g gx ON gx.doc_id = x JOIN g gy ON gy.doc_id = y WHERE 100 * c >= 75 * (len(gx.s) + len(gy.s) - c)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.z = u.x),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN m USING (doc_id)
"""


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets as S

    found = S.scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*S.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, S.BASE), F.sha2(S.joined(base), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import codec

    path = tokenizer("word_bpe_49k.json")
    digest = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(digest)
    def round_trip(texts: pa.Array) -> pa.Array:
        own, out = codec(path), []
        for ids in own.encode_many(texts.to_pylist()):
            listed, decoded = " ".join(map(str, ids)), own.decode(ids)
            out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return read_table(spark, sf_dir, "documents").select("doc_id", round_trip("text").alias("d")).select("doc_id", "d.*")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_documents, pack

    pieces = cut_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return pack(pieces, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans_tree import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_top_k

    return exact_top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import kd_shards

    docs = read_table(spark, sf_dir, "documents")
    sized = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"), "text_crc32": F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).cast("long")})
    sized = sized.select("doc_id", "size", "text_crc32", "n_chars", "source", "lang", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("copies"))
    placed = kd_shards(sized, 24, "size", ["source", "size", "lang", "doc_id"], group="copies")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), percent=75, size=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_secret_scan, op2_bpe_roundtrip, op3_html_text, op4_kmeans_tree, op5_best_fit_packing, op6_token_counts, op7_exact_topk, op8_kd_shards, op9_toxicity, op10_ngram_join)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op10_ngram_join": OP10_SQL}
