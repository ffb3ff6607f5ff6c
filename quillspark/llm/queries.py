"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import spread, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack

    pieces = pack(documents(spark, sf_dir), WORD_BPE, end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


OP1_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.chat import conversation_nodes, digests, format_trees

    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    return digests(format_trees(conversation_nodes(rows))).withColumnRenamed("tree_id", "conv_id")


OP3_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
e AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>') AS body,
           replace(replace(replace(replace(role, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>'), '>', '\>') AS head
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.secrets import digest, find_secrets

    return digest(find_secrets(documents(spark, sf_dir)), ("assign", "access", "hex"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import find_pii
    from quillspark.llm.secrets import digest

    return digest(find_pii(documents(spark, sf_dir)), ("email", "ip", "card", "phone"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.byte_bpe import decode, encode

    both = decode(encode(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.9)


OP6_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
           len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
    FROM embeddings
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reached AS (
    SELECT vec_id AS node, vec_id AS seen FROM v
    UNION
    SELECT reached.node, links.b FROM reached JOIN links ON reached.seen = links.a
),
roots AS (SELECT node, min(seen) AS component_id FROM reached GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, roots.component_id,
       v.vec_id = roots.component_id AS kept
FROM v JOIN roots ON roots.node = v.vec_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import classify

    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.token_files import read_documents, write_token_files

    manifest = write_token_files(documents(spark, sf_dir), WORD_BPE, end_id=2, length=2048)
    return read_documents(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.minhash_dedup import near_documents

    return near_documents(documents(spark, sf_dir), similarity=0.8, width=5)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.alignment import align_tokens

    return align_tokens(documents(spark, sf_dir), BYTE_BPE_FILE, PIECE_BPE)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.importance import resample

    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10000, least_words=20, seed=2024)


OP12_SQL = r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS step
    FROM range(256) AS r(n)
),
d AS (
    SELECT row_number() OVER () AS doc_row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
dw AS (SELECT doc_row, unnest(words) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
h AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
v AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                              lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM h, crc
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (w) GROUP BY bucket),
n AS (SELECT CAST(10000 + coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(10000 + coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * s_all / ((s.n + 1) * t_all))) AS BIGINT) AS gain
    FROM s LEFT JOIN t USING (bucket), n
),
weight AS (SELECT doc_row, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN gain USING (bucket) GROUP BY doc_row),
scored AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN weight USING (doc_row)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), BYTE_BPE_FILE, public_tokenizers.PATTERN, limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_packing": op2_packing,
        "op3_chat": op3_chat,
        "op4_secrets": op4_secrets,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_token_files": op9_token_files,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_alignment": op11_alignment,
        "op12_importance": op12_importance,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op3_chat": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op12_importance": OP12_SQL}
