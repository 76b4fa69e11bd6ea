"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import bpe, filter_audit, langid, line_dedup, lz_fingerprint, mixing, pii, resampling, simhash, token_file, topk, toxicity, url_filter
from casequarry.llm.common import checkpoint_dir, remainder, table
from casequarry.sources.tables import spread

#: The rules of op8: host, path, verdict. Fixed values.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    learned = labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(*toxicity.sample(learned, docs))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_sentence",
    )


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return line_dedup.deduplicated(docs).select("doc_id", "text", F.col("__removed_lines").alias("removed_lines"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), weights=(3, 1, 2), share=1.5, max_epochs=2.0, seed=42)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@functools.cache
def vocabulary(path: str | None = None) -> bytes:
    return bpe.read_vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), vocabulary(), public_tokenizers.PATTERN)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding"), 64.0).alias("weights"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.train(docs.where(remainder(F.col("doc_id"), 3) != 1))
    return langid.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spread(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(pii.KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.listed((*pii.KINDS, "term")).alias("spans"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, percent=10, least_words=20, seed=2024)


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_file.write(spread(table(spark, sf_dir, "documents")), folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_file.read(spark, folder)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(spread(table(spark, sf_dir, "documents")))
    return filter_audit.audit(filter_audit.labelled(failed, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_lz_fingerprint, op3_line_dedup, op4_mixing, op5_simhash, op6_bpe, op7_topk, op8_url_filter, op9_langid, op10_pii,
        op11_resampling, op12_token_file, op13_filter_audit,
    )
}

#: Regular expressions and hashes of these are the same in DuckDB; the other operators have no SQL.
ORACLE_SQL = {
    "op4_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
        weighed AS (
            SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
        levels AS (
            SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
        draws AS (
            SELECT s.doc_id, s.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('42:' || s.doc_id), s.doc_id, s.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (whole * size + greatest(0, least(size, floor(target - whole * source_size + 0.5)::BIGINT - ahead)))::BIGINT AS taken
        FROM draws""",
    "op7_topk": """
        WITH sound AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM sound),
        scores AS (
            SELECT q.vec_id AS query_id, v.vec_id, sum(q.x * v.x)::BIGINT AS score
            FROM parts q JOIN parts v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scores)
        SELECT * FROM ranked WHERE rank <= 20""",
    "op8_url_filter": r"""
        WITH parsed AS (
            SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS sep FROM pages),
        places AS (
            SELECT page_id,
                   CASE WHEN sep > 0 THEN translate(regexp_extract(substr(url, sep + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM parsed),
        rules(rule_host, rule_path, verdict) AS (VALUES
            ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict FROM places JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
        won AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, w.rule, coalesce(w.verdict, 'allow') AS verdict FROM places p LEFT JOIN won w USING (page_id)""",
    "op11_resampling": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        aimed AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        crc(steps) AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
        known AS (SELECT DISTINCT unnest(w) AS f FROM (SELECT w FROM texts UNION ALL SELECT w FROM aimed)),
        spelt AS (
            SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes FROM known),
        placed AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc),
        found AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) AS f FROM texts) JOIN placed USING (f)),
        raw AS (SELECT bucket, count(*)::DOUBLE AS s FROM found GROUP BY bucket),
        target AS (SELECT bucket, count(*)::DOUBLE AS t FROM (SELECT unnest(w) AS f FROM aimed) JOIN placed USING (f) GROUP BY bucket),
        totals AS (SELECT coalesce((SELECT sum(s) FROM raw), 0) AS every, coalesce((SELECT sum(t) FROM target), 0) AS aims),
        gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (every + 10000) / ((s + 1) * (aims + 10000))))::BIGINT AS gain
            FROM raw LEFT JOIN target USING (bucket), totals),
        weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM found JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
            FROM texts LEFT JOIN weights USING (doc_id)),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
        SELECT s.*, r.rank::BIGINT AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id AND r.rank <= 10 * able // 100""",
    "op13_filter_audit": r"""
        WITH measured AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        flags AS (
            SELECT doc_id, part, concat(
                CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
            FROM measured),
        cells AS (
            SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, count(*) AS n FROM flags LEFT JOIN labels USING (doc_id) GROUP BY ALL),
        letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        placed AS (
            SELECT *, coalesce(list_min(list_transform(range(1, length(fails) + 1), lambda i: strpos(filter_order, substr(fails, i, 1)))), 6) AS first FROM cells, orders),
        steps AS (SELECT *, substr(filter_order, step, 1) AS f FROM placed, (SELECT unnest(range(1, 6)) AS step)),
        counted AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (first < step AND contains(fails, f)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND bad), 0)::BIGINT AS toxic_lost
            FROM steps GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted""",
}
