"""Resampling, token files and the filter audit against plain Python, on whole small tables and awkward rows."""

import functools
import itertools
import math
import os
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casequarry.llm import filter_audit, queries, resampling, token_file
from tests.llm.test_contracts import AWKWARD, awkward, empty, folder, rows_of  # noqa: F401

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, __found string, part string, bucket long, word string"


def encoded(encode, *texts):
    ids, lengths = encode(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.cache
def library():
    return Tokenizer.from_file(TOKENIZER)


def tupled(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_draw(docs, target, percent=10, least=20, seed=2024, longest=1, buckets=10_000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    found = [(d, *features(t)) for d, t in docs]
    raw, aimed = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in features(t)[1])
    every, aims = sum(raw.values()), sum(aimed.values())
    gain = {b: math.floor(1000 * math.log((aimed[b] + 1) * (every + buckets) / ((raw[b] + 1) * (aims + buckets)))) for b in raw}
    rows = []
    for d, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: percent * len(able) // 100]
    ranks = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    rest = Counter(r[:4] for r in rows)
    rest.subtract(Counter(r[:4] for r in drawn))
    return sorted(ranks + [(*r, None) for r, n in rest.items() for _ in range(n)], key=repr)


def test_resampling(spark, folder):  # noqa: F811
    docs = [(d["doc_id"], d["text"]) for d in rows_of(folder)]
    assert tupled(queries.op11_resampling(spark, folder)) == plain_draw(docs, [r["text"] for r in rows_of(folder, "benchmark")])


def test_resampling_repeats_ties_and_pairs_of_words(spark):
    texts = ["One two three four", "one two, three four", None, "", "x", "Ünïcode ２ ABC abc abc", "five six " * 300]
    docs = [(i % 5 if i % 6 else None, texts[i % 7]) for i in range(60)]
    df = spark.createDataFrame([(d, t, None, "a", "b", 1, "c") for d, t in docs], SCHEMA)
    target = spark.createDataFrame([("three four five",), (None,)], "text string")
    found = resampling.resample(df, target, percent=50, least_words=1, seed=7, longest=2, buckets=97)
    assert tupled(found) == plain_draw(docs, ["three four five", None], 50, 1, 7, 2, 97)
    assert resampling.resample(df, target.limit(0), percent=0, least_words=1).where("rank IS NOT NULL").count() == 0


def test_resampling_draws_what_the_target_is_like(spark, small):
    found = queries.op11_resampling(spark, small).collect()
    drawn = [r["weight"] for r in found if r["rank"]]
    others = [r["weight"] for r in found if not r["rank"] and r["n_features"] >= 20]
    assert np.mean(drawn) > np.mean(others)


def test_scores_stay_in_one_literal(spark, small):
    docs = queries.table(spark, small, "documents")
    plan = resampling.weighted(docs, np.arange(10_000))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=400), max_size=8))
def test_packing_is_undone(blocks):
    sizes = np.array([len(b) for b in blocks if b], np.int64)
    ids = np.array([i for b in blocks for i in b], np.uint64)
    words, counts = token_file.pack(ids, sizes)
    assert counts.sum() == len(words) and (token_file.unpack(words, counts, sizes) == ids).all()
    at = 0
    for i, b in enumerate(b for b in blocks if b):  # each block by itself, from its own offset
        mine = slice(int(counts[:i].sum()), int(counts[: i + 1].sum()))
        assert token_file.unpack(words[mine], counts[i : i + 1], sizes[i : i + 1]).tolist() == b
        at += len(b)


def test_packing_is_tight():
    full = lambda ids: len(token_file.pack(np.array(ids, np.uint64), np.array([len(ids)]))[0])
    assert full([0] * 240) == 2 and full([1] * 60) == 1 and full([30_000] * 8) == 2 and full([40_000] * 9) == 3
    assert full([1 << 60]) == 2 and full([(1 << 60) - 1]) == 1 and full([5] * 3) == 1


def test_blocks_of_documents():
    assert token_file.block_sizes(np.array([0, 1, 4096, 4097, 9000])).tolist() == [1, 4096, 4096, 1, 4096, 4096, 808]


def plain_tokens(docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]


def with_starts(coded):
    rows, start = [], 0
    for d, ids in coded:
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(rows, key=repr)


def test_token_file(spark, folder):  # noqa: F811
    docs = sorted(((d["doc_id"], d["text"]) for d in rows_of(folder)), key=lambda d: d[0])
    assert tupled(queries.op12_token_file(spark, folder)) == with_starts(plain_tokens(docs))


def test_pieces_encode_like_the_whole_text():
    tokenizer, encode = Tokenizer.from_file(TOKENIZER), token_file.word_encoder(TOKENIZER, None)
    odd = ["<|endoftext|> a<|startoftext|>b", "é ́x a b c\x0bd\x1ce", "ΣΑΣ ΟΔΟΣ", "İstanbul I'LL don't", "a\r\nb\tc", "가 ᆨ", " \n", "ab" * 9000 + "\n" + "c" * 50]
    for text in [t for t in AWKWARD if t] + odd:
        assert encoded(encode, text, "and", text) == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "and", text)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("abstdrevlmST'09<|>.,- \n\x1c\x0bßÀÿ×÷ªµİſKΣς\u0301\u00a0")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_encodes_like_the_library(text):
    assert encoded(token_file.word_encoder(TOKENIZER, None), text) == [library().encode(text, add_special_tokens=False).ids]


def test_generations_of_known_parts(monkeypatch):
    monkeypatch.setattr(token_file, "KNOWN_PARTS", 3)
    tokenizer, encode = Tokenizer.from_file(TOKENIZER), token_file.word_encoder.__wrapped__(TOKENIZER, 1)
    for text in ("a b c d e", "a f g", "h i j k a", "a b, c", "x" * 50 + " a", "x" * 50 + " a"):
        assert encoded(encode, text, "", text)[::2] == [[*tokenizer.encode(text, add_special_tokens=False).ids, 1]] * 2


def test_bytes_that_are_no_text():
    encode = token_file.word_encoder(TOKENIZER, None)
    bad = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, 6], pa.int32()).buffers()[1], pa.py_buffer(b"ab \xff c")])
    assert encode(bad)[0].tolist() == library().encode("ab \ufffd c", add_special_tokens=False).ids


def test_token_file_awkward_ids_ranges_and_rolling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "RANGE_ROWS", 8)
    monkeypatch.setattr(token_file, "FILE_WORDS", 40)
    monkeypatch.setattr(token_file, "TEXT_BYTES", 100)
    texts = ["", None, "one two", "word " * 9000, "three", "３ ４", "one two"]
    docs = [([None, 5, 5, 5, 9, -3][i % 6], texts[i % 7]) for i in range(200)] + [(-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    df = spark.createDataFrame([(d, t, None, "a", "b", 1, "c") for d, t in docs], SCHEMA).repartition(5)
    token_file.write(df, f"file:{tmp_path}/t", TOKENIZER, 1)
    files = spark.read.parquet(f"{tmp_path}/t/files")
    assert files.select("bucket").distinct().count() > 3 and files.count() > files.select("bucket").distinct().count()
    names = {r["file"] for r in files.collect()}
    assert names <= set(os.listdir(f"{tmp_path}/t"))
    found = sorted(token_file.read(spark, f"{tmp_path}/t", with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    position = 0
    for r in found:
        assert r["start"] == position and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        position += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((d, tuple(i)) for d, i in plain_tokens(docs))


def test_files_of_attempts_that_failed_dont_count(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    token_file.write(df, str(tmp_path), TOKENIZER)
    before = tupled(token_file.read(spark, str(tmp_path)))
    (tmp_path / "000000-0000-left.s8b").write_bytes(b"S8BTOKEN half a file")
    assert tupled(token_file.read(spark, str(tmp_path))) == before


def plain_audit(docs, labels):
    known = {}
    for d, q, t in labels:
        if d is not None:
            known[d] = (known.get(d, (0, 0))[0] | (q == 1), known.get(d, (0, 0))[1] | (t == 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = t in first and (d is None or d > first[t])
        rows.append((lang or "", {f for f, x in fails.items() if x}, *known.get(d, (0, 0))))
    out = []
    for part in sorted({r[0] for r in rows}):
        mine, table, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone)
                table.append((part, order, step, len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*row[:-1], shapley[row[-1]]) for row in table]
    return sorted(out, key=repr)


def test_filter_audit(spark, folder):  # noqa: F811
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in rows_of(folder)]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in rows_of(folder, "labels")]
    assert tupled(queries.op13_filter_audit(spark, folder)) == plain_audit(docs, labels)


def test_filter_audit_repeats_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    texts = ["", None, "same", "AB#", "w " * 250, " ".join(map(str, range(250))), "same"]
    docs = [([None, 1, 1, 2, 3][i % 5], texts[i % 7], [None, "a", "b", "", "c", "d"][i % 6]) for i in range(90)]
    labels = [(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "a", "b", 1, "c") for d in docs], SCHEMA)
    failed = filter_audit.failures(df)
    found = filter_audit.audit(filter_audit.labelled(failed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert tupled(found) == plain_audit(docs, labels)


def test_first_failures():
    table, orders = filter_audit.first_failures(), filter_audit.orders()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    assert table[0b10010, orders.index("ACEBD")] == 2 and table[0b10010, orders.index("ABCDE")] == 1


@pytest.mark.parametrize("name", ["op11_resampling", "op12_token_file", "op13_filter_audit"])
def test_nothing_in_nothing_out(spark, empty, name):  # noqa: F811
    assert queries.QUERIES[name](spark, empty).collect() == []
