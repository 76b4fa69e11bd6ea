"""Queries of searches that would be all pairs if nothing were ruled out, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.operators import keywords, likeness, neighbours
from casequarry.sources.tables import spread, table

MIN_LIKENESS = 0.35
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def q66_alike_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a query against every document: its three likest by words, from 0.35 on."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("seq"), F.col("text").alias("description"))
    found = likeness.most_alike(None, docs, k=3, least=MIN_LIKENESS)
    return found.select("query_id", "entry_id", "rank", F.round("score", 9).alias("score"))


def q67_keyword_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as rules, whose keywords are their words of five letters or more: which rules every document meets."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    catalogue = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.posexplode(words).alias("ord", "keyword"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return keywords.rules_met(docs, "doc_id", "text", catalogue)


def q74_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every vector from 0.35 on."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(rows, rows, dims=64, k=3, least=MIN_LIKENESS, digits=6)


#: Bytes of texts whose letters are counted at a time.
BYTES_AT_ONCE = 1 << 20


def _letters(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASCII letters are single bytes of UTF-8 that stand for nothing else, so bytes are counted, a piece of any length at a time."""
    kinds, n = np.full(256, len(LETTERS), np.int64), len(LETTERS) + 1
    for cased in (LETTERS, LETTERS.upper()):
        kinds[np.frombuffer(cased.encode(), np.uint8)] = np.arange(len(LETTERS))
    for part in parts:
        texts = part["text"].cast(pa.large_string())
        counts = np.zeros((len(texts), n), np.int64)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        for start in range(int(ends[0]), int(ends[-1]), BYTES_AT_ONCE):
            stop = min(start + BYTES_AT_ONCE, int(ends[-1]))
            first, last = np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, stop, "left")
            rows = np.repeat(np.arange(last - first) * n, np.diff(np.clip(ends[first : last + 1], start, stop)))
            found = np.bincount(rows + kinds[np.frombuffer(texts.buffers()[2], np.uint8)[start:stop]], minlength=(last - first) * n)
            counts[first:last] += found.reshape(-1, n)
        flat = pa.array(np.ascontiguousarray(counts[:, :-1]).ravel().astype(np.int32))
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(LETTERS))
        yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(offsets, flat)], ["id", "vector"])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every letter from a to z stands in every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_letters, "id long, vector array<int>")


def q75_nearest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents whose letters are distributed most alike, for every document with a letter."""
    rows = profiles(spark, sf_dir)
    return neighbours.nearest(rows, rows, dims=len(LETTERS), k=3, least=MIN_LIKENESS, digits=6)


QUERIES = {f.__name__: f for f in (q66_alike_by_words, q67_keyword_catalogue, q74_nearest_vectors, q75_nearest_profiles)}

_NEAREST_SQL = """scored AS (SELECT a.id AS query_id, b.id AS match_id, round(list_dot_product(a.e, b.e), 6) AS score FROM units a JOIN units b ON a.id <> b.id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id)::INT AS rank FROM scored WHERE score >= 0.35::DOUBLE)
        SELECT query_id, match_id, score, rank FROM ranked WHERE rank <= 3"""

ORACLE_SQL = {
    "q74_nearest_vectors": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        units AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), {_NEAREST_SQL}""",
    "q75_nearest_profiles": f"""WITH texts AS (SELECT doc_id AS id, translate(text, '{LETTERS.upper()}', '{LETTERS}') AS t FROM documents),
        v AS (SELECT id, list_transform(string_split('{",".join(LETTERS)}', ','), lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS e FROM texts),
        units AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0), {_NEAREST_SQL}""",
    "q66_alike_by_words": """WITH sets AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda w: lower(w))) AS words FROM documents),
        kept AS (SELECT * FROM sets WHERE len(words) > 0),
        pairs AS (SELECT q.doc_id AS query_id, c.doc_id AS entry_id, len(list_intersect(q.words, c.words)) AS common, len(q.words) + len(c.words) AS sizes
                  FROM kept q JOIN kept c ON least(len(q.words), len(c.words)) >= 0.349 * greatest(len(q.words), len(c.words))),
        scored AS (SELECT query_id, entry_id, common::DOUBLE / (sizes - common) AS score FROM pairs),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id)::INT AS rank FROM scored WHERE score >= 0.35::DOUBLE)
        SELECT query_id, entry_id, rank, round(score, 9) AS score FROM ranked WHERE rank <= 3""",
    "q67_keyword_catalogue": """WITH words AS (SELECT item_id AS rule_id, regexp_extract_all(text, '[A-Za-z]{5,}') AS w FROM benchmark),
        spelt AS (SELECT rule_id, unnest(w) AS keyword, generate_subscripts(w, 1) AS i FROM words),
        catalogue AS (SELECT rule_id, keyword, min(i) AS ord FROM spelt GROUP BY rule_id, keyword),
        known AS (SELECT DISTINCT lower(keyword) AS k FROM catalogue),
        texts AS (SELECT doc_id, lower(text) AS t FROM documents),
        hits AS (SELECT doc_id, k FROM texts JOIN known ON contains(t, k)),
        met AS (SELECT doc_id, rule_id, count(*) AS n_hits, list(keyword ORDER BY ord) AS written FROM hits JOIN catalogue ON lower(keyword) = k GROUP BY doc_id, rule_id)
        SELECT doc_id, rule_id, n_hits, array_to_string(written[1:3], '、') AS clues FROM met""",
}
