"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, html_extraction, language_id, line_dedup, mixing, packing, pii, prefix_trie, quality, simhash, topk
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(table(spark, sf_dir, "documents")).drop("base_spans")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.remainder(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn_from_split(docs, table(spark, sf_dir, "labels"))
    held_out = language_id.remainder(F.col("doc_id"), 5) == 0
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), bound=0.93)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"))
    docs, taken = made.documents, mixing.taken_by_shard(made).withColumnsRenamed({"doc_id": "_doc", "copy": "_copy"})
    docs = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_doc"]) & (docs["copy"] == taken["_copy"]), "left")
    words = F.transform("shards", lambda s: F.concat_ws(":", s["shard"].cast("string"), s["words"].cast("string")))
    return docs.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce(F.array_join(words, ","), F.lit("")).alias("shards"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, cluster=packing.near_clusters(docs))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = byte_bpe.codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), shared)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_top_k": op2_top_k,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_prefix_trie": op12_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": """
WITH parts AS (
    SELECT vec_id, len(embedding) AS dim, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL
), bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)
), v AS (SELECT vec_id, dim, i, floor(64 * x)::BIGINT AS q FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), packed AS (SELECT vec_id, dim, list(q::DOUBLE ORDER BY i) AS q FROM v GROUP BY vec_id, dim
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM packed a JOIN packed b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    # the same keys by string functions; the edit distance decides
    "op6_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line_no, parts[i] AS raw, trim(parts[i], ' ' || chr(9) || chr(13)) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), counted AS (SELECT * FROM lines WHERE line <> ''
), firsts AS (
    SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS place FROM counted GROUP BY line
), long AS (SELECT * FROM firsts WHERE n >= 10
), halves AS (
    SELECT line, n, place, n AS ref, 'l' AS side, left(line, n // 2) AS part FROM long
    UNION ALL SELECT line, n, place, n, 'r', right(line, n - n // 2) FROM long
), probes AS (
    SELECT line, n, place, n - 1 AS ref, 'l' AS side, left(line, (n - 1) // 2) AS part FROM long
    UNION ALL SELECT line, n, place, n - 1, 'r', right(line, n - 1 - (n - 1) // 2) FROM long
    UNION ALL SELECT * FROM halves
), late AS (
    SELECT DISTINCT CASE WHEN a.place < b.place THEN b.place ELSE a.place END AS place
    FROM halves a JOIN probes b ON a.ref = b.ref AND a.side = b.side AND a.part = b.part AND a.line <> b.line
    WHERE levenshtein(a.line, b.line) <= 1
), dropped AS (
    SELECT c.doc_id, c.line_no FROM counted c JOIN firsts f ON c.line = f.line LEFT JOIN late l ON f.place = l.place
    WHERE l.place IS NOT NULL OR c.doc_id <> f.place.doc_id OR c.line_no <> f.place.line_no
), kept AS (
    SELECT l.doc_id, count(*) AS n_lines, count(d.doc_id) AS n_dropped, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE d.doc_id IS NULL), '') AS text
    FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line_no = d.line_no GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_dropped, text FROM kept
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
""",
    "op9_mixing": r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), docs AS (
    SELECT doc_id, source, size, row_number() OVER (PARTITION BY doc_id ORDER BY source, size, digest) AS copy FROM sized
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM docs GROUP BY source
), weighed AS (
    SELECT source, source_size, (k - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM weighed WINDOW rising AS (ORDER BY most / weight, source NULLS LAST)
), level AS (SELECT max(level) FILTER (WHERE most > level * weight) AS level FROM levels
), targets AS (
    SELECT source, source_size, CASE WHEN l.level IS NULL OR weight * l.level >= most THEN most::DOUBLE ELSE weight * l.level END AS target FROM weighed, level l
), ordered AS (
    SELECT d.doc_id, d.copy, d.source, d.size, t.source_size, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', 'mix', d.doc_id, d.copy)), d.doc_id, d.copy ROWS UNBOUNDED PRECEDING) - d.size AS pos,
        greatest(1, ceil((SELECT sum(size) FROM docs) / (16 * greatest(64, 2 ** ceil(log2(greatest(1, ceil((SELECT sum(size) FROM docs) / 268435456.0)))))::BIGINT)))::BIGINT AS block_words
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), placed AS (SELECT *, (pos // block_words)::BIGINT AS block FROM ordered
), blocks AS (
    SELECT source, block, min(pos) AS head, sum(size) AS words, any_value(source_size) AS source_size, floor(any_value(target) + 0.5)::BIGINT AS goal FROM placed GROUP BY source, block
), turned AS (
    SELECT source, block, head, words, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS rest,
        sum(words) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix last', source, block)), block ROWS UNBOUNDED PRECEDING) - words AS before FROM blocks
), tails AS (SELECT source, block, head, words, passes, greatest(0, least(words, rest - before)) AS tail FROM turned
), epochs AS (SELECT source, block, head, epoch, CASE WHEN epoch < passes THEN words ELSE tail END AS take FROM (SELECT *, unnest(range(0, passes::BIGINT + 1)) AS epoch FROM tails)
), drawn AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix draw', source, epoch, block)), epoch, block) AS turn FROM epochs WHERE take > 0
), tree AS (
    -- the drawn blocks as slots of a source; a node's slots in random order, the first half to the left
    SELECT 0 AS level, 0 AS node, source, turn AS slot FROM drawn
    UNION ALL SELECT level + 1, 2 * node + (row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', 'mix tree ' || level, source, slot))) > ceil(count(*) OVER (PARTITION BY node) / 2))::INT, source, slot
    FROM tree WHERE level < (SELECT ceil(log2(greatest(64, ceil(sum(size) / 268435456.0)))) FROM docs)
), leaves AS (
    SELECT source, node AS shard, row_number() OVER (PARTITION BY source ORDER BY node) AS turn FROM tree WHERE level = (SELECT max(level) FROM tree)
), dealt AS (SELECT d.*, l.shard FROM drawn d JOIN leaves l ON d.source IS NOT DISTINCT FROM l.source AND d.turn = l.turn
), draws AS (
    SELECT p.doc_id, p.copy, d.shard, sum(greatest(0, least(p.size, d.take - (p.pos - d.head))))::BIGINT AS words
    FROM placed p JOIN dealt d ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block WHERE p.size > 0 AND d.take > p.pos - d.head GROUP BY ALL
), sums AS (SELECT doc_id, copy, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM draws GROUP BY doc_id, copy)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(s.taken, 0)::BIGINT AS taken, coalesce(s.shards, '') AS shards
FROM placed p LEFT JOIN sums s ON p.doc_id IS NOT DISTINCT FROM s.doc_id AND p.copy = s.copy
""",
    # every prefix as the string of its turns' digests; each node's figures go to all its prefixes
    "op12_prefix_trie": r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), ids AS (
    SELECT c, c - ((c % 20) + 20) % 20 AS base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc
), filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), keyed AS (
    SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM filled
), turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS p FROM keyed
), built AS (
    SELECT c, 0 AS part, p, key, words FROM ids JOIN turns ON conv_id = base AND p <= h
    UNION ALL SELECT c, 1, p, key, words FROM ids JOIN turns ON conv_id = c AND p > h
), steps AS (
    SELECT c, row_number() OVER o AS d, string_agg(key, '') OVER o AS path, words FROM built WINDOW o AS (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)
), whole AS (SELECT c, d, path, words FROM steps UNION ALL SELECT c, 0, '', 0 FROM ids
), lengths AS (SELECT c, max(d) AS n FROM whole GROUP BY c
), nodes AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n) AS ends
    FROM whole JOIN lengths USING (c) GROUP BY path, d
), families AS (
    SELECT a.path, a.d, a.conv_id, a.n_convs, a.ends, p.conv_id AS parent_conv_id, count(k.path) AS n_children
    FROM nodes a LEFT JOIN nodes p ON a.d = p.d + 1 AND left(a.path, 32 * p.d) = p.path LEFT JOIN nodes k ON k.d = a.d + 1 AND left(k.path, 32 * a.d) = a.path
    GROUP BY ALL
), rising AS (
    SELECT left(path, 32 * k) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT n.path, n.words, n.n_convs, f.n_children, unnest(range(0, n.d + 1)) AS k FROM nodes n JOIN families f USING (path)) GROUP BY 1
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM families JOIN rising USING (path)
""",
}
