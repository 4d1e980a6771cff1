"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, filter_audit, prefix_trie, quality, secrets, sharding, simhash_dedup, token_counts, topk, toxicity, url_filter, warc
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digest_texts(docs, path, public_tokenizers.PATTERN)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op3_topk",
    """
    WITH v AS (
      SELECT vec_id AS id,
             list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.id AS query_id, c.id AS vec_id,
             CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.search(vectors, F.col("id") % 20 == 0, k=20)


RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those that a rule decides."""
    pages = table(spark, sf_dir, "pages")
    labelled = url_filter.with_rule(pages.select("url"), RULES).where("rule IS NOT NULL")
    model = url_filter.train(
        labelled.select("host", "path", F.col("rule_verdict").alias("verdict"))
    )
    return url_filter.judge(pages, RULES, model)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


@query(
    "op1_warc",
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
      FROM pages),
    b AS (  -- 40 hexadecimal digits as bits, read five at a time
      SELECT *, list_aggregate(list_transform(range(0, 40), lambda i:
               lpad(bin(CAST(instr('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)), 4, '0')),
             'string_agg', '') AS bits
      FROM p),
    d AS (
      SELECT page_id, n, h,
             list_aggregate(list_transform(range(0, 32), lambda i:
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda k:
                 CAST(bits[i * 5 + k + 1] AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)))::INTEGER]),
             'string_agg', '') AS payload_digest
      FROM b),
    m AS (SELECT h, n, max(page_id) AS top FROM p GROUP BY h, n)
    SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.payload_digest,
           CASE WHEN d.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN d.page_id <> m.top THEN m.top END AS refers_to
    FROM d JOIN m USING (h, n)
    """,
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index are written, then every page is looked up in them."""
    pages = table(spark, sf_dir, "pages")
    archives = warc.new_folder(pages, "warc")
    index = warc.write_index(
        warc.write_archives(pages, archives), warc.new_folder(pages, "capture-index")
    )
    keys = pages.select(warc.capture_key("url", "page_id").alias("key"))
    return warc.look_up(keys, index, archives, payloads=False).drop("payload")


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query(
    "op11_filter_audit",
    r"""
    WITH RECURSIVE t AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY text) AS least FROM t),
    l AS (
      SELECT doc_id, max(CAST(quality IS NOT DISTINCT FROM 1 AS INTEGER)) AS good,
             max(CAST(toxic IS NOT DISTINCT FROM 1 AS INTEGER)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CAST(len(words) < 200 AS INTEGER)
             + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
             + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
             + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
             + 16 * CAST(coalesce(w.doc_id > least, false) AS INTEGER) AS mask
      FROM w LEFT JOIN l USING (doc_id)),
    c AS (
      SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
    f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o(filter_order, used) AS (
      SELECT '', 0
      UNION ALL
      SELECT filter_order || letter, used | bit FROM o JOIN f ON used & bit = 0),
    s AS (
      SELECT filter_order, step, f.letter, f.bit,
             coalesce((SELECT sum(g.bit) FROM f g WHERE contains(filter_order[:step - 1], g.letter)), 0)::INTEGER AS applied
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE len(filter_order) = 5)
      JOIN f ON f.letter = filter_order[step]),
    r AS (
      SELECT part, filter_order, step, letter,
             coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
           CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM r
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query(
    "op12_prefix_trie",
    r"""
    WITH t AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos,
             tid, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
      FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
            FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT,
                   list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                 lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                   lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
      FROM t GROUP BY conv_id),
    r AS (
      SELECT c.conv_id, 0 AS own, pos, tid, words FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL
      SELECT c.conv_id, 1, pos, tid, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
    s AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, tid, words FROM r),
    p AS (  -- conversations with each of their prefixes
      SELECT conv_id, d, words,
             string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY d) AS node,
             coalesce(string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY d
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent
      FROM s
      UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
    e AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
    n AS (
      SELECT node, any_value(parent) AS parent, d, min(p.conv_id) AS conv_id, count(*) AS n_convs,
             any_value(words) AS words,
             coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (d = len), '') AS ends
      FROM p JOIN e USING (conv_id) GROUP BY node, d),
    k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
    a AS (
      SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
    u AS (  -- sums over all nodes that begin with a node
      SELECT x.node, sum(CAST(y.n_children = 0 AS INTEGER)) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved
      FROM a x JOIN a y ON starts_with(y.node, x.node) GROUP BY x.node)
    SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id,
           CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
           CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
           sha256(a.ends) AS ends_sha256
    FROM a JOIN u USING (node) LEFT JOIN n b ON b.node = a.parent
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
