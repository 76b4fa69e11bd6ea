"""The ten queries against plain Python, on whole small tables and on rows made to be awkward."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.llm import line_dedup, queries

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("size", "string").add("bucket", "string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINES = [f"line {i} of a passage that several documents share" for i in range(14)]

AWKWARD = [
    None,
    "",
    " \t\n\x0b",
    "ein Wort",
    "one",
    "One",
    "a b c d e f g",
    "A B C D E F G",
    "çé À 𝒳 ２３ ñ",
    "12345 !!! 987",
    "it's we're I'll 'sx don't'",
    "x" * 5000,
    ("word " * 3000).strip(),
    "\n".join(LINES),
    "lead\n" + "\n".join(LINES) + "\ntail",
    "\n".join(LINES),
    "mail a.b@c.de, x_y@z and q@w.e.r; ip 10.0.0.255 or 1.2.3.456 or 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (234) 555-0199 then +12 and ++49 30 123456-",
    "a@b.c_d@e.f and x@y@z.com 👍 +1.2.3.4",
    "9" * 3000 + " a" * 40 + "a@" * 500 + ".b" * 3000,
    "a@b" + ".c" * 4000,
    "  trailing   spaces  \n\n\n  and   breaks \t",
    "½ ²",
    "① Ⅷ 12",
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A data folder whose documents are awkward: nulls, repeats, long and empty texts, extra columns."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "Ä"][i % 4], None if t is None else len(t), "x", "y") for i, t in enumerate(AWKWARD)]
    rows += [(40, "one of a pair", None, "a", 13, None, None), (41, "one of a pair", "en", "a", 13, None, None), (47, "Zug und Bahn", "de", None, 12, "", "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 30)] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = [None, "", "no-scheme/en/", "http://", "https://EXAMPLE.com/en/7?x#y", "http://a.b.Example.Net/de/81", "x://net/de/", "http://org/es", "http://org/es/#", "http://notexample.com/en/7", "http://h/a://b.com/en/", "ftp://u.com?/en/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls * 2)], "page_id long, url string, key string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "one of a PAIR, a b c"), (3, "çé ２３ word 12345")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [0.5 * ((i * 7) % 11) - 2.0, float(i % 3), -0.25, 1.0 / (i + 1)]) for i in range(70)]
    vectors += [(80, None), (81, [None, 1.0, 0.0, 0.0]), (82, [float("nan"), 1.0, 0.0, 0.0]), (83, [float("inf"), 1.0, 0.0, 0.0]), (84, [1.0]), (100, []), (None, [1.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, awkward, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module", params=["small", "awkward"])
def folder(request, small):
    return small if request.param == "small" else request.getfixturevalue("awkward")


def rows_of(folder, name="documents"):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def by_id(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert df.collect() == []


def test_toxicity(spark, folder):
    found = by_id(queries.op1_toxicity(spark, folder))
    docs = rows_of(folder)
    assert set(found) == {d["doc_id"] for d in docs}
    for d in docs:
        row = found[d["doc_id"]]
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_lz_fingerprint(spark, folder):
    found = by_id(queries.op2_lz_fingerprint(spark, folder))
    docs = sorted(rows_of(folder), key=lambda d: d["doc_id"])
    prints = {}
    for i, d in enumerate(docs):
        text, following = d["text"] or "", docs[(i + 1) % len(docs)]
        next_text = following["text"] or ""
        edited = text[: len(text) - len(text) // 4] + next_text[: len(text) // 4]
        row = found[d["doc_id"]]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == plain_fingerprint(text)
        assert row["edited_fingerprint"] == plain_fingerprint(edited)
        assert row["near_edited"] == plain_likeness(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == plain_likeness(row["fingerprint"], found[following["doc_id"]]["fingerprint"])
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]


def plain_fingerprint(text):
    data, phrases, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in phrases:
            phrases.add(data[start:end])
            start = end
    mask = 0xFFFFFFFF

    def mixed(h):
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        return h ^ h >> 16

    return "".join(f"{h:08x}" for h in sorted({mixed(zlib.crc32(p)) for p in phrases})[:64])


def plain_likeness(a, b):
    a, b = ({p[i : i + 8] for i in range(0, len(p), 8)} for p in (a, b))
    union = sorted(a | b)[:64]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def plain_chunks(text):
    """Chunks as (first line, number of lines)."""
    lines = text.split("\n")
    mask = (1 << 64) - 1
    hashes = [xxhash.xxh64_intdigest(line.encode(), 42) for line in lines]
    rolled = [h if not i else h ^ ((hashes[i - 1] << 1 | hashes[i - 1] >> 63) & mask) for i, h in enumerate(hashes)]
    rolled = [h - (1 << 64) if h >> 63 else h for h in rolled]
    starts = [i for i in range(len(lines)) if not i or rolled[i] < rolled[i - 1] and (i + 1 == len(lines) or rolled[i] <= rolled[i + 1])]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def plain_line_dedup(texts, with_chunks=True):
    """text, chunks, removed chunks, removed lines of each text, the first of equal pieces being kept."""
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append((None, 0, 0, 0))
            continue
        lines, chunks = text.split("\n"), plain_chunks(text)
        says = [i for i, line in enumerate(lines) if re.search(r"[^ \t\n\x0b\f\r]", line)]
        found = {(s, n) for s, n in chunks if sum(s <= i < s + n for i in says) >= 2}
        found |= {(i, j - i + 1) for i, j in zip(says, says[1:])} | {(i, 1) for i, line in enumerate(lines) if len(WORD.findall(line)) > 50}
        hits = set()
        for start, n in sorted(found):
            piece = "\n".join(lines[start : start + n])
            if piece in seen:
                hits.add((start, n))
            seen.add(piece)
        covered, gone, run = {i for s, n in hits for i in range(s, s + n)}, set(), []
        for i in range(len(lines) + 1):
            if i in covered:
                run.append(i)
            elif run:
                chunk = with_chunks and any(c in hits and run[0] <= c[0] <= run[-1] for c in chunks)
                if chunk or len(WORD.findall("\n".join(lines[j] for j in run))) > 50:
                    gone |= set(run)
                run = []
        out.append(("\n".join(line for i, line in enumerate(lines) if i not in gone), len(chunks), sum(c in hits for c in chunks), len(gone)))
    return out


def test_chunks_decide(spark, small):
    texts = [d["text"] for d in sorted(rows_of(small), key=lambda d: d["doc_id"])]
    assert plain_line_dedup(texts) != plain_line_dedup(texts, with_chunks=False)


def test_line_dedup_keeps_headings_blank_lines_and_maps(spark):
    passage = "\n\n".join(f"paragraph {i} " + "word " * 9 for i in range(6))
    texts = ["Intro\n\nalpha", "Intro\n\nbeta", "a\n\n\n\nb", "c\n\n\n\nd", "x\n" + passage + "\ny", "z\n" + passage, "Re\nHi\nthere", "Re\nHi\nyou"]
    docs = spark.createDataFrame([(i, t, {"k": [i]}) for i, t in enumerate(texts)] * 2, "doc_id long, text string, extra map<string,array<int>>")
    found = [r["text"] for r in line_dedup.deduplicated(docs.dropDuplicates(["doc_id"])).orderBy("doc_id").collect()]
    assert found == [r[0] for r in plain_line_dedup(texts)] and found[:5] == texts[:5] and found[5] == "z" and line_dedup.deduplicated(docs).count() == 16


def test_line_dedup(spark, folder):
    found = by_id(queries.op3_line_dedup(spark, folder))
    docs = sorted(rows_of(folder), key=lambda d: d["doc_id"])
    for d, want in zip(docs, plain_line_dedup([d["text"] for d in docs]), strict=True):
        row = found[d["doc_id"]]
        assert (row["text"], row["removed_lines"]) == (want[0], want[3]), d["doc_id"]


def test_line_dedup_of_rows_that_repeat(spark):
    passage = "\n".join(LINES[:3])
    rows = [(1, passage, 0), (1, passage, 1), (1, "before\n" + passage, 2), (None, passage + "\nafter", 3), (2, None, 4), (3, "w " * 60, 5), (4, "alone\n" + "w " * 60 + "\nlast", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int").withColumns({name: F.lit("x") for name in ("__of", "__text_hash", "__kept", "__chunks", "tokens")})
    out = line_dedup.deduplicated(docs)
    got = {r["__id"]: r["text"] for r in out.collect()}
    assert sorted(out.columns) == sorted([*docs.columns, "__removed_chunks", "__removed_lines"])
    assert got[3] == passage + "\nafter" and {got[0], got[1]} == {""} and got[2] == "before"
    assert got[4] is None and got[5] == "w " * 60 and got[6] == "alone\nlast"


def test_line_dedup_removes_a_moved_passage(spark, awkward):
    found = by_id(queries.op3_line_dedup(spark, awkward))
    assert found[13]["removed_lines"] == 0 and found[15]["text"] == "" and found[14]["text"] == "lead\ntail"


def test_mixing(spark, folder):
    found = by_id(queries.op4_mixing(spark, folder))
    docs = rows_of(folder)
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    sources = {}
    for d in docs:
        sources[d["source"]] = sources.get(d["source"], 0) + size[d["doc_id"]]
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, wanted = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sources.values())
    while True:  # share the excess anew until no source is above its cap
        left = wanted - sum(2 * sources[s] for s in full)
        weights = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sources[s] if s in full else left * weight[s] / weights for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sources[s]}
        if not over:
            break
        full |= over
    taken = dict.fromkeys(names, 0)
    for d in docs:
        row = found[d["doc_id"]]
        assert row["size"] == size[d["doc_id"]] and row["source_size"] == sources[d["source"]]
        assert math.isclose(row["target"], target[d["source"]], abs_tol=1e-6)
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[d["source"]] += row["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def plain_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, folder):
    found = by_id(queries.op5_simhash(spark, folder))
    docs = rows_of(folder)
    prints = {d["doc_id"]: plain_simhash(d["text"]) for d in docs if len(d["text"] or "") < 30000}
    least = {i: i for i in prints}

    def root(i):
        return i if least[i] == i else root(least[i])

    for i in prints:
        assert found[i]["fingerprint"] == f"{prints[i]:016x}"
    prints = {i: int(r["fingerprint"], 16) for i, r in found.items()}
    least = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    assert {i: r["component_id"] for i, r in found.items()} == {i: root(i) for i in prints}


def test_bpe(spark, folder):
    found = by_id(queries.op6_bpe(spark, folder))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.vocabulary().splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in rows_of(folder):
        ids, row = plain.encode_ordinary(d["text"] or ""), found[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_topk(spark, folder):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op7_topk(spark, folder).collect())
    vectors = {}
    for r in rows_of(folder, "embeddings"):
        if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"]):
            vectors[r["vec_id"]] = [math.floor(64 * x) for x in r["embedding"]]
    want = []
    for q in sorted(v for v in vectors if v % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], w)), v) for v, w in vectors.items() if v != q)[:20]  # noqa: B905
        want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores)]
    assert got == want


def test_url_filter(spark, folder):
    found = by_id(queries.op8_url_filter(spark, folder), "page_id")
    for page in rows_of(folder, "pages"):
        url, host, path = page["url"] or "", "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        row = found[page["page_id"]]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_langid(spark, folder):
    found = by_id(queries.op9_langid(spark, folder))
    right = []
    for d in rows_of(folder):
        row = found[d["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1
        if d["text"] is None or not any(map(str.isalpha, d["text"])):
            assert row["lang_pred"] == "und"
        elif row["held_out"]:
            right.append(row["lang_pred"] == d["lang"])
    if len(right) > 40:
        assert np.mean(right) > 0.95


def plain_langid(docs):
    """Posteriors by the textbook: counts of hashed n-grams in dictionaries, whole table learned."""
    mask = (1 << 64) - 1

    def buckets(text):
        plain = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                h = n
                for c in plain[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & mask
                    h ^= h >> 29
                yield h & 0x7FFF

    counts, rows = {}, {}
    for d in docs:
        if d["text"] is not None and d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1:
            rows[d["lang"]] = rows.get(d["lang"], 0) + 1
            own = counts.setdefault(d["lang"], [0] * 32768)
            if any(map(str.isalpha, d["text"])):
                for b in buckets(d["text"]):
                    own[b] += 1
    logs = {lang: [math.log((c + 0.5) / (sum(own) + 16384)) for c in own] for lang, own in counts.items()}

    def predicted(text):
        if text is None or not any(map(str.isalpha, text)) or not logs:
            return "und", 0.0
        grams = list(buckets(text))
        score = {lang: math.log(rows[lang] / sum(rows.values())) + math.fsum(own[b] for b in grams) for lang, own in logs.items()}
        top = max(sorted(score), key=score.get)
        return top, 1 / sum(math.exp(s - score[top]) for s in score.values())

    return predicted


def test_langid_posteriors_by_brute_force(spark, folder):
    found, docs = by_id(queries.op9_langid(spark, folder)), [d for d in rows_of(folder) if len(d["text"] or "") < 20000]
    predicted = plain_langid(rows_of(folder))
    for d in docs[:: max(1, len(docs) // 60)]:
        lang, score = predicted(d["text"])
        assert math.isclose(found[d["doc_id"]]["score"], score, abs_tol=1e-6), d["doc_id"]
        assert score < 0.5001 or found[d["doc_id"]]["lang_pred"] == lang


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def test_pii(spark, folder):
    found = by_id(queries.op10_pii(spark, folder))
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    tests = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)),
        "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    for d in rows_of(folder):
        row, spans = found[d["doc_id"]], []
        for kind, pattern in patterns.items():
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, d["text"] or "") if tests[kind](m[0])]
            assert row[f"n_{kind}"] == len(own), (d["doc_id"], kind)
            spans += own
        assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert row["spans"].startswith(",".join(spans))
