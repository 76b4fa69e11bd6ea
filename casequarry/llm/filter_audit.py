"""An audit of how quality filters act together, over every order in which they could be applied.

Which filters a document fails is a number of as many bits. For each such number and each order a table
says at which step the document goes: 32 rows and 120 columns for five filters. Documents are looked up
there a batch at a time, what goes at which step is counted by label with ``np.bincount``, and each task gives
one array of counts a part, which are summed. Everything asked of an order follows from these counts and
those of the numbers themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
NAMES = "ABCDE"
#: Labels: neither, good, toxic, both.
LABELS = 4
#: A task gives away what it has counted when it holds so many parts.
PARTS = 256


def orders(names: str = NAMES) -> list[str]:
    """Every order of the filters, sorted."""
    return ["".join(p) for p in itertools.permutations(sorted(names))]


def first_failures(names: str = NAMES) -> np.ndarray:
    """[failed filters as bits, order]: the step, from 0, at which a document goes; the number of filters if it stays."""
    places = np.array([[order.index(name) for name in names] for order in orders(names)])
    failed = np.arange(1 << len(names))[:, None] >> np.arange(len(names)) & 1
    return np.where(failed[:, None, :] == 1, places[None], len(names)).min(axis=2).astype(np.int64)


def own_failures(text: str = "text") -> Column:
    """Bits of the filters A to D that a text (null: empty) fails by itself.

    A: fewer than 200 words; B: less than half of the words distinct; C: more than 3 % of its characters in
    A-Z; D: holds one of the characters number sign, dollar, per cent, ampersand, asterisk, bar.
    """
    whole = f"coalesce({text}, '')"
    by_words = f"transform(array(regexp_extract_all({whole}, r'{WORD}', 0)), w -> (CASE WHEN size(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100L * size(array_distinct(w)) < 50L * size(w) THEN 2 ELSE 0 END))[0]"
    capitals = f"CASE WHEN 100L * regexp_count({whole}, '[A-Z]') > 3L * length({whole}) THEN 4 ELSE 0 END"
    marks = f"CASE WHEN {whole} RLIKE '[#$%&*|]' THEN 8 ELSE 0 END"
    return F.expr(f"{by_words} + {capitals} + {marks}")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and failed (bits of A to E) of each of ``docs`` (doc_id, text, lang).

    E: some smaller doc_id of the whole table has the same text, by SHA-256. Rows with the same id have no order
    between them, so neither is a copy of the other; a row without an id comes after all that have one, and
    is a copy if one of those has its text. Texts are read once; only ids and digests are moved, and a
    text that a third of all rows share is summed up on each executor before it is.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    slim = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures().alias("own"), digest.alias("digest")))
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.coalesce(F.col("doc_id") > F.col("first"), F.col("doc_id").isNull()) & F.col("first").isNotNull(), F.lit(False))
    return slim.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("failed"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with label: 1 if the document has quality 1 among ``labels`` (doc_id, quality, toxic), and 2 more if it is toxic.

    A document without a label, or with a null one, is neither; of several labels the highest count.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"))
    return failed.join(known, "doc_id", "left").select("part", "failed", (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("label"))


def audit(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """What every filter removes in every order: ``rows`` have part, failed (bits by the place in ``names``), label.

    One row for each part, filter_order and step (from 1), zeros included: kept after the step, removed at
    it, redundant (failing its filter, but gone before), unique_fails (failing no other), good_lost,
    toxic_lost (of those removed), shapley (what its filter removes, summed over all orders). Repeated rows count each; a
    null part is the empty string; an empty table gives no rows.
    """
    table, n = first_failures(names), len(names)
    width = table.shape[1] * (n + 1)
    cells = np.arange(table.shape[1]) * (n + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            failed, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            codes = parts.indices.to_numpy()
            for code, part in enumerate(parts.dictionary.to_pylist()):
                here = codes == code
                steps = table[failed[here]] + cells + (label[here] * width)[:, None]
                found = np.concatenate([np.bincount(steps.ravel(), minlength=LABELS * width), np.bincount(failed[here], minlength=1 << n)])
                sums[part] = sums[part] + found if part in sums else found
                if len(sums) >= PARTS:
                    yield _partial(sums)
                    sums = {}
        if sums:
            yield _partial(sums)

    def report(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(LABELS * width + (1 << n), np.int64)
        total[found["pos"].to_numpy()] = found["n"].to_numpy()
        return _report(key[0], total, names)

    whole = rows.select(F.coalesce("part", F.lit("")).alias("part"), F.col("failed").cast("long"), F.col("label").cast("long"))
    partial = whole.mapInArrow(count, "part string, counts array<bigint>")
    summed = partial.select("part", F.posexplode("counts").alias("pos", "n")).where("n > 0").groupBy("part", "pos").agg(F.sum("n").alias("n"))
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return summed.groupBy("part").applyInPandas(report, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in numbers))


def _partial(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["part", "counts"])


def _report(part: str, total: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """A part's rows, from how many go at [label, order, step] and how many fail each set of filters."""
    n, every = len(names), orders("".join(names))
    by_set = total[-(1 << n) :]
    gone = total[: -(1 << n)].reshape(LABELS, len(every), n + 1)
    removed = gone.sum(axis=0)[:, :n]
    filters = np.array([[names.index(name) for name in order] for order in every])
    fails = np.array([by_set[(np.arange(1 << n) >> f & 1) == 1].sum() for f in range(n)])
    alone = by_set[1 << np.arange(n)]
    shapley = np.bincount(filters.ravel(), weights=removed.ravel(), minlength=n).astype(np.int64)
    columns = {
        "kept": by_set.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[filters] - removed, "unique_fails": alone[filters],
        "good_lost": (gone[1] + gone[3])[:, :n], "toxic_lost": (gone[2] + gone[3])[:, :n], "shapley": shapley[filters],
    }
    index = {"part": part, "filter_order": np.repeat(every, n), "step": np.tile(np.arange(1, n + 1), len(every))}
    return pd.DataFrame(index | {name: values.ravel() for name, values in columns.items()})
