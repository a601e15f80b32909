"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each reads its whole tables with production parameters. What null and empty texts, null ids, rows
that repeat, very long texts and empty tables give is said by the operator that a query calls;
columns that an operator has no use for are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.llm import ann, bpe, filter_audit, licenses, main_text, minhash, packing, prefix_trie, sharding, simhash, substrings, token_counts, toxicity
from isospark.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id: SimHash of 64 bits over four-word shingles, linked at 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of each vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: passages of 50 words that a smaller id has go."""
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length of each piece."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"))
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law `rows`."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return minhash.compared_to_next(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page."""
    return main_text.extracted(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, for 120 orders of five filters."""
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each different beginning of conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op10: its bands joined, and Jaccard verified."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages of corpus_pipeline leave."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_toxicity, op3_nearest_neighbours, op4_substring_dedup, op5_packing, op6_byte_bpe, op7_sharding, op8_token_counts, op9_license_scan, op10_minhash_fingerprints, op11_html_extraction, op12_filter_audit, op13_prefix_trie, minhash_near_duplicates, pipeline)}

SQL = {
    "op4_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), spots AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS pos FROM words
        ), spans AS (
            SELECT doc_id, pos, array_to_string(w[pos : pos + 49], ' ') AS span FROM spots
        ), owned AS (
            SELECT span, min(doc_id) AS owner FROM spans GROUP BY span HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT doc_id, list(pos) AS ats FROM spans JOIN owned USING (span) WHERE owner < doc_id GROUP BY doc_id
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(flatten(list_transform(ats, lambda a: range(a, a + 50)))) AS k FROM gone
        ), removed AS (
            SELECT doc_id, count(*) AS n, list(k) AS ks FROM covered GROUP BY doc_id
        ), left_over AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept
            FROM (SELECT doc_id, ks, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words JOIN removed USING (doc_id))
            WHERE NOT list_contains(ks, i) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """,
    "op12_filter_audit": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents
        ), worded AS (
            SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs
        ), firsts AS (
            SELECT t, min(doc_id) AS least FROM docs GROUP BY t
        ), known AS (
            SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
        ), failing AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
            FROM worded JOIN firsts USING (t) LEFT JOIN known USING (doc_id)
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), counted AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failing GROUP BY part, fails
        ), removal AS (
            SELECT *, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda f: instr(filter_order, f))) END AS gone FROM counted, orders
        ), steps AS (
            SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, gone, n, n_good, n_toxic FROM removal, (SELECT unnest(range(1, 6))::INT AS step)
        ), audit AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (instr(fails, f) > 0 AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n_good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
            FROM steps GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM audit
    """,
    # h is an unsigned CRC32 modulo 4, here bit by bit
    "op13_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT c, c - c % 20 AS base, (xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
                   lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT)) % 4 AS h
            FROM (SELECT DISTINCT c FROM turns)
        ), rebuilt AS (
            SELECT convs.c, pos - 10 AS pos, role, text FROM convs JOIN turns ON turns.c = base AND pos <= h
            UNION ALL SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h
        ), placed AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, len(role) || ':' || role || text AS turn, text FROM rebuilt
        ), prefixes AS (
            SELECT c, d, sha256(turn) AS own, string_agg(sha256(turn), ',') OVER (PARTITION BY c ORDER BY d) AS prefix, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM placed
            UNION ALL SELECT c, 0, '', '', 0 FROM convs
        ), lengths AS (
            SELECT c, max(d) AS length FROM prefixes GROUP BY c
        ), nodes AS (
            SELECT prefix, d, any_value(CASE WHEN d > 1 THEN left(prefix, len(prefix) - 65) ELSE '' END) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = length), '')) AS ends_sha256
            FROM prefixes JOIN lengths USING (c) GROUP BY prefix, d
        ), childless AS (
            SELECT prefix, d, (d, prefix) NOT IN (SELECT (d - 1, above) FROM nodes WHERE d > 0) AS leaf, own FROM nodes
        ), ups AS (
            SELECT c.leaf, c.own, unnest(range(0, c.d + 1)) AS d, c.prefix FROM childless c
        ), below AS (
            SELECT d, left(prefix, greatest(d * 65 - 1, 0)::BIGINT) AS prefix, sum(leaf::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM ups GROUP BY 1, 2
        ), kids AS (
            SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
        )
        SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN below USING (d, prefix) LEFT JOIN kids USING (d, prefix) LEFT JOIN nodes p ON p.prefix = n.above AND p.d = n.d - 1
    """,
}
