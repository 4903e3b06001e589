"""Registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bestfit, bpe, chat, interactions, jaccard, kdtree, licenses, lsh, packing, quality, secrets, suffixdedup, trie
from lexiloom.storage import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(
        packing.pack(
            table(spark, sf_dir, "documents"),
            public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"),
            public_tokenizers.PATTERN,
        )
    )


def op5_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_paths(chat.as_replies(said.unionByName(more))))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_digests(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("ka", "kb")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.piece_digests(bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_multiprobe_lsh": op3_multiprobe_lsh,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_kdtree_top_k": op5_kdtree_top_k,
    "op6_secret_scan": op6_secret_scan,
    "op7_reply_trees": op7_reply_trees,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {
    "op11_prefix_trie": """
WITH crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id AS c, xor(list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(unicode(s) AS BIGINT))),
        lambda v, s: xor(v // 256, t[CAST(xor(v, s) % 256 + 1 AS BIGINT)])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
    SELECT c, 0 AS own, place, role, text FROM convs JOIN turns ON conv_id = c - c % 100 AND place < h
    UNION ALL
    SELECT c, 1, place, role, text FROM convs JOIN turns ON conv_id = c AND place >= h
), members AS (
    SELECT c, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), ',') OVER w AS key, length(text) AS chars,
        count(*) OVER (PARTITION BY c) AS turns_of
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, place)
    UNION ALL
    SELECT c, 0, '', 0, (SELECT count(*) FROM rebuilt r WHERE r.c = k.c) FROM convs k
), keyed AS (
    SELECT c, depth, key, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent_key, chars, turns_of FROM members
), nodes AS (
    SELECT depth, key, any_value(parent_key) AS parent_key, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE turns_of = depth), '')) AS ends_sha256
    FROM keyed GROUP BY depth, key
), children AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.depth = k.depth AND n.key = k.key),
sums AS (
    SELECT m.depth, m.key, sum((u.n_convs - 1) * u.chars) AS saved_tokens, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
    FROM counted u JOIN keyed m ON m.c = u.conv_id AND m.depth <= u.depth GROUP BY m.depth, m.key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
    CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON n.depth = s.depth AND n.key = s.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.parent_key
""",
    "op13_filter_audit": r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), first_ids AS (
    SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), told AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
    SELECT t.part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 3 * length(t.text) AS c, regexp_matches(t.text, '[#$%&*|]') AS d,
        coalesce(t.doc_id > f.first_id, FALSE) AS e, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM texts t JOIN first_ids f ON t.text = f.text LEFT JOIN told l ON t.doc_id = l.doc_id
), failed AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
        || CASE WHEN e THEN 'E' ELSE '' END AS set_of, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, filter_order, step, x, n, good, toxic, set_of, contains(set_of, x) AS fails_it,
        before <> '' AND regexp_matches(set_of, '[' || before || '-]') AS gone
    FROM failed, steps
), rows AS (
    SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant, sum(CASE WHEN set_of = x THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM rows
""",
}
