"""The pipeline against its stages in plain Python."""

import math
import re

import public_tokenizers
import pyarrow.parquet as pq
from test_contracts import plain_line_dedup
from test_near_copies import five_words

import corpus_pipeline
from casequarry.llm import bpe, langid


def test_stages(spark, small):
    """Each stage on all that the one before kept; the columns stay those of documents until the last."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    columns = docs.columns
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        states[name] = docs.collect()
        docs = spark.createDataFrame(states[name], docs.schema)
        assert name == "encode" or docs.columns == columns
    model = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    kept = {i for i, d in before.items() if (p := langid.predict([d["text"]], model))[0][0] != "und" and p[1][0] >= 0.5}
    assert {r["doc_id"] for r in states["language"]} == kept
    order = sorted(kept)
    texts = {i: out[0] for i, out in zip(order, plain_line_dedup([before[i]["text"] for i in order]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in states["lines"]} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in states["lines"])
    sets = {i: five_words(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if root[j] < root[i] and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                    root[i], changed = root[j], True
    assert {r["doc_id"] for r in states["near_duplicates"]} == {i for i in root if root[i] == i}
    sizes, taken = {}, {}
    for r in states["near_duplicates"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for r in states["mix"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert math.isclose(sum(taken.values()), 1.5 * sum(sizes.values()), rel_tol=0.01) and all(taken[s] <= 2 * sizes[s] for s in taken)
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert sorted(bytes(codec.decode(r["tokens"])).decode() for r in states["encode"]) == sorted(r["text"] for r in states["mix"])
    assert all(r["n_tokens"] == len(r["tokens"]) for r in states["encode"])


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "tokens", "n_tokens"] and out.count() > 0


def test_run_over_no_documents(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_go_through(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "no id here but some words", "en", "a", 25, None), (3, "words and words", "en", None, 15, ""), (3, "words and words", "en", None, 15, ""), (4, "z" * 100000, "de", "b", 100000, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.size` string").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in found.collect()} <= {None, 3, 4}


def test_tables_are_read_as_written(small):
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(pq.read_schema(f"{small}/documents.parquet").names)
