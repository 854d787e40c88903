"""The registered queries of this folder, one for each operator, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, language, line_dedup, merkle, near_dedup, packing, pseudonyms, quality, url_rules, vectors, warc
from .common import table

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The rules that come before the mined ones.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), blocked.alias("blocked"))
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.survey(warc.archive(table(spark, sf_dir, "pages")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"), pseudonyms.KEY)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_warc, op3_line_dedup, op4_bpe, op5_exact_dedup,
        op6_language, op7_pseudonyms, op8_nearest, op9_near_dedup, op10_packing,
        op11_merkle, op12_centroids, op13_quality,
    )
}

def centroid_sql(count: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """All distances in each round, written out round by round; sums of whole numbers, floored exactly."""
    near = """
        a{i} AS (
          SELECT vec_id, v, arg_min(c, (far, c)) AS c, min(far) AS far
          FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM kept, m{i})
          GROUP BY vec_id, v
        )"""
    move = """
        s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS total, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY c, j),
        f{i} AS (SELECT c, list((total - (total % n + n) % n) // n ORDER BY j) AS moved FROM s{i} GROUP BY c),
        m{next} AS (SELECT c, coalesce(moved, m) AS m FROM m{i} LEFT JOIN f{i} USING (c))"""
    steps = ",".join(near.format(i=i) + "," + move.format(i=i, next=i + 1) for i in range(rounds)) + "," + near.format(i=rounds)
    return f"""
        WITH kept AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ),
        m0 AS (
          SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m
          FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {count})
        ),{steps}
        SELECT vec_id, c::INTEGER AS cluster, far AS distance,
               sum(far) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(far) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN m{rounds} USING (c)
    """


ORACLE = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
          SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
                 min(page_id) OVER (PARTITION BY sha1(html)) AS first_id
          FROM p
        ),
        -- base32: 40 hexadecimal digits are 8 groups of 5 digits, each of 4 letters
        groups AS (
          SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::BIGINT) AS parts FROM d
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM groups
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept,
               text_sha256
        FROM d
    """,
    # crc: the bitwise CRC-32 of the decimal id; lower(...) of A-Z only; trees: 0 for languages, 1 for their roots
    "op11_merkle": r"""
        WITH RECURSIVE d AS (
          SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::UBIGINT)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)),
                     lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
          FROM documents
        ),
        e AS (
          SELECT doc_id, lang, xor(crc, 4294967295::UBIGINT) % 3 = 0 AS tampered,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS body,
                 coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
          FROM d
        ),
        leaves AS (
          SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_no,
                 row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth,
                 count(*) OVER (PARTITION BY lang) AS n,
                 sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN lowered ELSE body END) AS other
          FROM e
        ),
        nodes AS (
          SELECT 0 AS level, lang_no, nth, n, leaf AS own FROM leaves
          UNION ALL
          SELECT level + 1, lang_no, nth // 8, (n + 7) // 8, sha256(string_agg(own, '' ORDER BY nth))
          FROM nodes WHERE n > 1 GROUP BY level, lang_no, nth // 8, n
        ),
        subroots AS (SELECT lang_no, own FROM nodes WHERE n = 1),
        tops AS (
          SELECT 0 AS level, lang_no AS nth, (SELECT count(*) FROM subroots) AS n, own FROM subroots
          UNION ALL
          SELECT level + 1, nth // 8, (n + 7) // 8, sha256(string_agg(own, '' ORDER BY nth))
          FROM tops WHERE n > 1 GROUP BY level, nth // 8, n
        ),
        beside AS (
          SELECT *, coalesce(string_agg(own, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                 coalesce(string_agg(own, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM (SELECT 0 AS tree, * FROM nodes UNION ALL BY NAME SELECT 1 AS tree, -1 AS lang_no, * FROM tops)
          WINDOW w AS (PARTITION BY tree, lang_no, level, nth // 8 ORDER BY nth)
        ),
        climb AS (
          SELECT doc_id, lang_no AS own_lang, 0 AS tree, lang_no, 0::BIGINT AS level, nth, other AS own, '' AS siblings FROM leaves
          UNION ALL
          SELECT doc_id, own_lang, CASE WHEN b.n > 1 THEN c.tree ELSE 1 END, CASE WHEN b.n > 1 THEN c.lang_no ELSE -1 END,
                 CASE WHEN b.n > 1 THEN c.level + 1 ELSE 0 END,
                 CASE WHEN b.n > 1 THEN c.nth // 8 ELSE c.lang_no END,
                 CASE WHEN b.n > 1 THEN sha256(b.before || c.own || b.after) ELSE c.own END,
                 CASE WHEN b.n > 1 THEN siblings || b.before || b.after ELSE siblings END
          FROM climb c JOIN beside b ON b.tree = c.tree AND b.lang_no = c.lang_no AND b.level = c.level AND b.nth = c.nth
          WHERE b.n > 1 OR c.tree = 0
        ),
        ends AS (
          SELECT c.doc_id, c.own_lang, c.own, c.siblings FROM climb c JOIN tops t ON c.tree = 1 AND t.level = c.level AND t.nth = c.nth WHERE t.n = 1
        ),
        root AS (SELECT own AS root FROM tops WHERE n = 1)
        SELECT doc_id, leaf, s.own AS subroot, root, sha256(siblings) AS proof_sha256, ends.own AS folded_root, ends.own = root AS verified
        FROM leaves JOIN ends USING (doc_id) JOIN subroots s ON s.lang_no = ends.own_lang, root
    """,
    "op12_centroids": centroid_sql(),
}
