"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of the lower-cased text per language, smooths them and keeps a matrix
of log-probabilities (buckets x languages), whose size is fixed by the parameters and which is
broadcast. Scoring turns a batch of texts into sparse rows of buckets and multiplies them with that
matrix in numpy, a bounded piece at a time, so a very long text takes no more memory than its own.

Training may use a bounded sample: at most about ``sample_per_lang`` labelled documents of each
language, chosen by a hash of the id, so that languages with fewer documents are used whole. The
sample's n-gram counts are summed by the executors; the driver receives one number per language and
bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.llm.common import fresh

UNDETERMINED = "und"
#: Everything that separates words; letters of any script, and marks, stay.
NOT_WORD = re.compile(r"[\W\d_]+")
#: Numbers that a piece of a batch gathers from the matrix at once.
GATHER = 1 << 19


@dataclass(frozen=True)
class Settings:
    """buckets: power of two; orders: n-gram lengths; smoothing: added to every count.

    max_langs bounds the matrix, which is broadcast: a table that names more languages is an error.
    """

    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    sample_per_lang: int = 5000
    max_langs: int = 2000


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray = field(repr=False)
    settings: Settings = field(default_factory=Settings)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode category L."""
    return text is not None and any(map(str.isalpha, text))


def sparse(texts: list[str], settings: Settings, piece: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as sparse rows, in pieces: number of the text (ascending) and bucket of every n-gram, repeats included.

    Words are joined by single spaces, which take part, so that word beginnings and ends count. A piece
    begins at most ``piece`` n-grams of a length, of as many texts as fit or of a part of a long one.
    """
    first = 0
    while first < len(texts):
        plain, size, last = [], 0, first
        while last < len(texts) and (last == first or size < piece):
            plain.append(NOT_WORD.sub(" ", f" {texts[last].lower()} "))
            size += len(plain[-1])
            last += 1
        lengths = np.array([len(p) for p in plain])
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        row, end = np.repeat(np.arange(first, last), lengths), np.repeat(np.cumsum(lengths), lengths)
        for start in range(0, size, piece):
            stop = min(start + piece, size)
            for n in settings.orders:
                begins = min(stop, size - n + 1)
                if begins <= start:
                    continue
                mixed = np.full(begins - start, n, dtype=np.uint64)
                for i in range(n):
                    mixed = (mixed ^ codes[start + i : begins + i]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                inside = np.arange(start, begins) + n <= end[start:begins]  # n-grams don't reach into the next text
                yield row[start:begins][inside], (mixed[inside] & np.uint64(settings.buckets - 1)).astype(np.int64)
        first = last


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Log-probabilities of texts (rows) by language: the batch's sparse rows times the matrix, and the prior."""
    out = np.tile(model.prior, (len(texts), 1))
    for row, bucket in sparse(texts, model.settings, max(1024, GATHER // max(1, len(model.langs)))):
        if len(row):
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[begins]] += np.add.reduceat(model.matrix[bucket], begins, axis=0)
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; und and 0.0 if it is null or has no letter, or nothing was learned."""
    langs, found = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sound = [i for i, text in enumerate(texts) if model.langs and has_letter(text)]
    if sound:
        logs = scores([texts[i] for i in sound], model)
        best = logs.argmax(axis=1)
        found[sound] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, top in zip(sound, best.tolist(), strict=True):
            langs[i] = model.langs[top]
    return langs, found


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``docs`` (doc_id, text, lang); rows with a null text or lang are left out.

    No labelled row gives a model without languages, which calls every text und.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    named = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(settings.max_langs + 1).collect()
    if len(named) > settings.max_langs:
        raise ValueError(f"more than max_langs = {settings.max_langs} languages are named")
    per_lang = {row["lang"]: row["n"] for row in named}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros(0), np.zeros((settings.buckets, 0), dtype=np.float32), settings)
    share = {lang: min(1.0, settings.sample_per_lang / n) for lang, n in per_lang.items()}
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang])])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rates[F.col("lang")] * 1_000_003)
    at = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), settings.buckets), dtype=np.int64)
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), np.array([at[lang] for lang in batch.column(1).to_pylist()], dtype=np.int64)
            sound = [i for i, text in enumerate(texts) if has_letter(text)]
            for row, bucket in sparse([texts[i] for i in sound], settings):
                total += np.bincount(own[sound][row] * settings.buckets + bucket, minlength=total.size).reshape(total.shape)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"row": row.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[row, bucket]})

    sums = drawn.select("text", "lang").mapInArrow(count, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((settings.buckets, len(langs)))
    for row in sums.toLocalIterator():
        counts[row["bucket"], row["row"]] = row["n"]
    smooth = counts + settings.smoothing
    prior = np.log(np.array([per_lang[lang] for lang in langs], dtype=float) / sum(per_lang.values()))
    return Model(langs, prior, np.log(smooth / smooth.sum(axis=0)), settings)


def classify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior (0 to 1) as two more columns.

    Every whole text is scored. Null texts and texts without a letter get ``und`` and 0.0. Other
    columns, rows and repeats stay as they are; a column named like a new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for part in texts:
            langs, found = predict(part.tolist(), known)
            yield pd.DataFrame({"lang": langs, "score": found})

    (both,) = fresh(docs, "langid")
    return docs.withColumn(both, predicted(F.col(text))).withColumns({lang: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)


def accepted(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a document passes: its language was determined, more likely than all others together."""
    return (lang != UNDETERMINED) & (score >= least)
