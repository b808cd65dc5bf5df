"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    cross_entropy, decontaminate, language, licenses, merkle, mixing, negatives, neighbours, quality, simhash, toxicity,
    url_filter, warc,
)
from docloom.llm.common import prepare, remainder, table, word_count
from docloom.session import cut_lineage

# The rules of the URL query, and the hosts whose pages make its list.
RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; the list is the canonical URL of every page on a known bad host."""
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url")
    bad = F.lit(False)
    for name in LISTED_HOSTS:
        bad = bad | F.contains(F.concat(F.lit("."), url_filter.url_host(F.col("url"))), F.lit(f".{name}."))
    return url_filter.judge(pages, pages.where(bad), [url_filter.parse_rule(line) for line in RULES])


def sized(docs: DataFrame) -> DataFrame:
    text: Column = F.col("text")
    return docs.select(
        "doc_id", "source", word_count(text).alias("size"), mixing.prose_weight(text).alias("weight")
    )


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized(table(prepare(spark), sf_dir, "documents")))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn where crc32 of the id modulo 4 is not 2 (a null id is not learnt from), predict everywhere."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.learn(docs.where(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    return warc.digests(pages, warc.new_folder(spark))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn where crc32 of the id modulo 3 is not 1 (a null id has no label), score everywhere."""
    docs = table(prepare(spark), sf_dir, "documents")
    vectors = cut_lineage(docs.select("doc_id", quality.statistics_column(F.col("text")).alias("vector")))
    model = quality.fit_on(vectors, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = vectors.select("doc_id", held_out.alias("held_out"), model.column(F.col("vector")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item of the benchmark, with the items."""
    return decontaminate.matches(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def cross_entropy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good. Background: all documents, which are all scored."""
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cross_entropy.score(docs, cross_entropy.fit(docs, cross_entropy.good_ids(labels)))


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, candidates all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per language; rows where 7 divides the crc32 of the id are checked with a changed n_chars."""
    docs = table(prepare(spark), sf_dir, "documents")
    return merkle.verify_documents(docs, F.coalesce(remainder(F.col("doc_id"), 7) == 0, F.lit(False)))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn where crc32 of the id modulo 4 is not 2 (a null id has no label), score everywhere."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    learnt = remainder(F.col("doc_id"), 4) != 2
    model = toxicity.fit(docs.where(learnt), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where 7 divides the id the label is moved."""
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return negatives.mine_embeddings(vectors, F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash_query,
    "op2_url_filter": url_filter_query,
    "op3_cross_entropy": cross_entropy_query,
    "op4_source_mixing": mixing_query,
    "op5_neighbours": neighbours_query,
    "op6_decontamination": decontamination_query,
    "op7_language_id": language_query,
    "op8_warc": warc_query,
    "op9_licenses": licenses_query,
    "op10_quality": quality_query,
    "op11_merkle": merkle_query,
    "op12_toxicity": toxicity_query,
    "op13_hard_negatives": negatives_query,
}

_HOST = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANONICAL = r"""
    CASE WHEN contains(url, '://') THEN
        host || regexp_replace(path, '/+$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END
"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "({chars})", "text")) + ")"
# crc32 bit by bit: the reversed polynomial, over the digits of the id.
_CRC32 = """
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)
"""

LLM_SQL: dict[str, str] = {
    "op2_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, url, coalesce({_HOST}, '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
                   regexp_replace(regexp_replace(
                       regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'),
                       '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS kept
            FROM pages),
        keyed AS (SELECT *, {_CANONICAL} AS canonical FROM parts),
        listed AS (
            SELECT DISTINCT canonical FROM keyed
            WHERE canonical IS NOT NULL
              AND ({" OR ".join(f"contains('.' || host, '.{h}.')" for h in LISTED_HOSTS)})),
        rules(verdict, host, path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fitting AS (
            SELECT k.page_id, k.url,
                   arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS best
            FROM (SELECT DISTINCT page_id, url, host, path FROM keyed) k JOIN rules r
              ON (k.host = r.host OR k.host LIKE '%.' || r.host) AND starts_with(k.path, r.path)
            GROUP BY ALL)
        SELECT k.page_id, k.host, k.path, f.best.rule AS rule,
               coalesce(f.best.verdict,
                        CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM keyed k
        LEFT JOIN fitting f ON f.page_id = k.page_id AND f.url = k.url
        LEFT JOIN listed l ON l.canonical = k.canonical
    """,
    "op4_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE *
                       ((length(text) - length(translate(text, '#$%&*!|', '')))::DOUBLE
                        / greatest(length(text), 1)::DOUBLE)), 1.0::DOUBLE) AS weight
            FROM documents),
        keyed AS (
            SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
                          / 4503599627370496.0::DOUBLE) / weight AS key
            FROM sized),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS rank
            FROM sources),
        filled AS (
            SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
                   coalesce(sum(source_size) OVER before, 0)::DOUBLE AS full_size,
                   coalesce(sum(weight) OVER before, 0)::DOUBLE AS used,
                   (sum(source_size) OVER ())::DOUBLE AS all_size, (sum(weight) OVER ())::DOUBLE AS all_weight
            FROM ranked
            WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, rank
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (
            SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * full_size) / (all_weight - used) AS level FROM filled),
        targets AS (
            SELECT source, source_size,
                   least(2.0::DOUBLE * source_size,
                         (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE level <= ratio) * weight) AS target
            FROM levels),
        placed AS (
            SELECT k.*, coalesce(sum(size) OVER (
                       PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM keyed k),
        spent AS (
            SELECT p.doc_id, p.size, t.source_size, t.target, p.before, floor(t.target)::BIGINT AS budget,
                   CASE WHEN t.source_size > 0
                        THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs
            FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
        FROM spent
    """,
    "op8_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
            FROM payloads),
        referring AS (
            SELECT *, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
            FROM firsts)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
        FROM referring
    """,
    "op11_merkle": f"""
        WITH RECURSIVE hashed AS (
            SELECT doc_id, lang, {_LEAF.format(chars="n_chars")} AS leaf,
                   CASE WHEN ({_CRC32}) % 7 = 0 THEN {_LEAF.format(chars="n_chars + 1")}
                        ELSE {_LEAF.format(chars="n_chars")} END AS claimed
            FROM documents),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM hashed),
        nodes(lang, level, pos, digest, n) AS (
            SELECT lang, 0, pos, leaf, n FROM leaves
            UNION ALL
            SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY lang, level + 1, pos // 2, (n + 1) // 2),
        trees AS (
            SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
                   count(*) OVER () AS n
            FROM nodes WHERE n = 1),
        tops(level, pos, digest, n) AS (
            SELECT 0, pos, digest, n FROM trees
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
            FROM tops WHERE n > 1 GROUP BY level + 1, pos // 2, (n + 1) // 2),
        placed AS (
            SELECT l.*, t.pos AS tree, t.height, t.digest AS subroot, (SELECT max(level) FROM tops) AS over,
                   row_number() OVER () AS id
            FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang),
        folds AS (
            SELECT *, 0 AS level, claimed AS reached, '' AS seen FROM placed
            UNION ALL
            SELECT f.doc_id, f.lang, f.leaf, f.claimed, f.pos, f.n, f.tree, f.height, f.subroot, f.over, f.id, f.level + 1,
                   CASE WHEN coalesce(s.digest, p.digest) IS NULL THEN sha256(f.reached)
                        WHEN coalesce(s.pos, p.pos) % 2 = 1 THEN sha256(f.reached || coalesce(s.digest, p.digest))
                        ELSE sha256(coalesce(s.digest, p.digest) || f.reached) END,
                   f.seen || coalesce(s.digest, p.digest, '')
            FROM folds f
            LEFT JOIN nodes s ON f.level < f.height AND s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level
                 AND s.pos = xor(f.pos >> f.level, 1)
            LEFT JOIN tops p ON f.level >= f.height AND p.level = f.level - f.height
                 AND p.pos = xor(f.tree >> (f.level - f.height), 1)
            WHERE f.level < f.height + f.over),
        root AS (SELECT digest FROM tops WHERE n = 1)
        SELECT doc_id, leaf, subroot, (SELECT digest FROM root) AS root, sha256(seen) AS proof_sha256,
               reached AS folded_root, reached = (SELECT digest FROM root) AS verified
        FROM folds WHERE level = height + over
    """,
    "op13_hard_negatives": """
        WITH kept AS (
            SELECT row_number() OVER () AS uid, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_inner_product(a.q, b.q)::BIGINT AS score
            FROM kept a JOIN kept b ON a.uid <> b.uid
            WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT *, row_number() OVER () AS place FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               (row_number() OVER (PARTITION BY p.place ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n
          ON n.anchor = p.anchor AND NOT n.same
         AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5
    """,
}
