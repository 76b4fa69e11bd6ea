"""The operators' own interfaces and properties, beyond the query contracts."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_contracts import plain_chunks

from casequarry.llm import bpe, langid, line_dedup, lz_fingerprint, mixing, pii, queries, simhash, topk, toxicity, url_filter
from casequarry.llm.components import components

PIECES = st.sampled_from(["a", "b", "Z", "é", "ñ", "猫", "𝒳", "1", "２", " ", "  ", "\n", "\t", " ", " ", ".", "!", "'", "'s", "'ll", "'re", "don't", "👍", "́", "the ", "<|endoftext|>"])
TEXTS = st.lists(PIECES, max_size=60).map("".join)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.vocabulary().splitlines())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codecs():
    return [bpe.Codec(queries.vocabulary(), public_tokenizers.PATTERN, leaf_chars=n) for n in (1, 2, 3, 7, 20)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_encoding_is_the_whole_encoding(plain, codecs, text):
    want = plain.encode_ordinary(text)
    for codec in codecs:
        assert codec.encode(text) == want
        assert codec.decode(want) == text.encode()


def test_long_texts_without_a_cut(plain, codecs):
    for text in ("ab" * 3000, "!?" * 2000, " " * 3000, "\n" * 500 + "x", "'" * 999, "猫" * 1500):
        assert codecs[-1].encode(text) == plain.encode_ordinary(text)
    assert codecs[0].encode("") == [] and codecs[0].decode([]) == b""


def test_encode_and_decode_tables(spark, plain):
    docs = spark.createDataFrame([(1, "some text here", "k"), (2, None, None), (2, "", None)], "doc_id long, text string, tokens string")
    tokens = bpe.encode_documents(docs.drop("tokens"), queries.vocabulary(), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], r["tokens"]) for r in tokens.collect()) == [(1, plain.encode_ordinary("some text here")), (2, []), (2, [])]
    back = bpe.decode_documents(tokens, queries.vocabulary(), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == [(1, b"some text here"), (2, b""), (2, b"")]


@settings(max_examples=100, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 60))
def test_shared_parse_is_the_whole_parse(text, tail, kept):
    kept = min(kept, len(text))
    own, edited = lz_fingerprint.fingerprint_pair(text, tail, kept)
    assert list(own) == list(lz_fingerprint.fingerprint(text))
    assert list(edited) == list(lz_fingerprint.fingerprint(text[:kept] + tail))


def test_likeness_follows_the_edit():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text, other = " ".join(words), " ".join("".join(rng.choice(list("qrstuvwx"), 5)) for _ in range(400))
    prints = lz_fingerprint.fingerprint(text)
    near = [lz_fingerprint.likeness(prints, lz_fingerprint.fingerprint(" ".join(words[:n]) + other)) for n in (400, 300, 100)]
    assert near[0] > near[1] > near[2] and lz_fingerprint.likeness(prints, prints) == 1.0


def test_fingerprint_columns(spark):
    docs = spark.createDataFrame([(1, "some text of words", "some text of work"), (2, None, "x"), (3, "", "")], "doc_id long, text string, other string")
    both = lz_fingerprint.fingerprinted(lz_fingerprint.fingerprinted(docs), "other", "second")
    found = {r["doc_id"]: r for r in both.withColumn("near", lz_fingerprint.likeness_of(F.col("fingerprint"), F.col("second"))).collect()}
    assert 0.5 < found[1]["near"] < 1 and found[2]["near"] == 0.0 and found[3]["near"] == 1.0 and found[3]["fingerprint"] == ""
    assert both.select(lz_fingerprint.likeness_of(F.lit(None).cast("string"), F.col("second"))).first()[0] is None


@pytest.mark.parametrize("rows_a_range", [4, 1000])
def test_crowded_ids_are_dealt_to_several_ranges(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(lz_fingerprint, "RANGE_ROWS", rows_a_range)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 50} " * (i % 9)) for i in range(150)] + [(400, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    signed = lambda text: (h := xxhash.xxh64_intdigest(text, 42)) - (1 << 64 if h >> 63 else 0)
    plain = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1]), r[1]))
    want = []
    for (i, text), (_, following) in zip(plain, plain[1:] + plain[:1], strict=True):
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other = lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(following)
        want.append((str(i), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.as_text(own), lz_fingerprint.likeness(own, other)))
    got = [(str(r["doc_id"]), r["edited_sha256"], r["fingerprint"], r["near_next"]) for r in lz_fingerprint.neighbours(docs).collect()]
    assert sorted(got) == sorted(want)
    if rows_a_range == 4:
        sizes = [r["n"] for r in lz_fingerprint._in_order(docs).where("extra = 0").groupBy("bucket").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 20 and max(sizes) < 40


def test_neighbours_with_ties_and_nulls(spark):
    docs = spark.createDataFrame([(None, "aaaa"), (1, "bbbbbbbb"), (1, "cccccccc"), (1, "cccccccc"), (2, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_chars"]) for r in lz_fingerprint.neighbours(docs).collect())
    assert found == [("1", 8), ("1", 8), ("1", 8), ("2", 0), ("None", 4)]


LINES = st.lists(st.sampled_from(["alpha", "beta", "gamma delta", "", "eps"]), min_size=1, max_size=30)


@settings(max_examples=100, deadline=None)
@given(LINES, LINES)
def test_boundaries_resist_shifts(lines, lead):
    """Chunks of a text reappear behind another beginning, but for those at the seam."""
    cut = lambda rows: [rows[a : a + n] for a, n in plain_chunks("\n".join(rows))]
    own, shifted = cut(lines), cut(lead + lines)
    assert own[3:] == shifted[len(shifted) - len(own[3:]) :] if own[3:] else True


def test_line_dedup_keeps_other_columns_and_repeated_rows(spark):
    passage = "\n".join(f"shared line {i}" for i in range(20))
    rows = [(2, "own\n" + passage, 5, "a"), (1, passage, 5, "b"), (1, passage, 5, "b"), (3, None, None, "c"), (None, passage, 5, "d"), (4, "\n\n\n", 3, "e"), (5, "\n\n\n", 3, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, hash string")
    out = line_dedup.deduplicated(docs)
    assert out.columns[:4] == docs.columns
    found = {(r["doc_id"], r["hash"]): r for r in out.collect()}
    assert out.count() == 7 and found[(None, "d")]["text"] == passage  # a null id comes first
    assert found[(1, "b")]["__removed_lines"] == 20 and found[(2, "a")]["text"] == "own" and found[(2, "a")]["n_chars"] == 3
    assert found[(3, "c")]["text"] is None and found[(5, "f")]["text"] == "\n\n\n"


edges = st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=25)


@settings(max_examples=8, deadline=None)
@given(edges)
def test_components(spark, pairs):
    least = {}
    for a, b in pairs:
        if a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(least) and {r["node"]: r["root"] for r in found} == least


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 12)] + [0, -1, 1 << 31, -(1 << 63)]
    close = set(base)
    for x in base:
        for n in (1, 2, 3, 4, 5):
            y = x & (1 << 64) - 1
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            close.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(close)
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} == want


def test_mixed_documents(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "s" + str(i % 2), None, i) for i in range(40)] + [(50, "a  b\nc d e", None, 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, target long")
    taken = {r["doc_id"]: r for r in mixing.mix(docs, share=1.2, seed=1).collect()}
    out = mixing.mixed_documents(docs, share=1.2, seed=1)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    whole = {i: r["size"] * math.floor(r["taken"] / r["size"] + 0.5) for i, r in taken.items() if r["taken"]}
    assert words == {i: n for i, n in whole.items() if n}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), share=1.2, seed=1).collect()}
    assert again == {i: r["taken"] for i, r in taken.items()}
    other = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=1.2, seed=2).collect()}
    assert other != again


def test_rows_without_an_id_or_with_the_same_are_mixed(spark):
    rows = [(None, "a b c d", "s")] * 9 + [(None, "e f g", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(7) for n in ("size", "taken", "__size", "key", "at", "row")})
    taken = mixing.mix(docs.drop("row"), share=0.7)
    found = taken.collect()
    assert len(found) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in found)
    by_source = {r["source_size"]: 0 for r in found}
    for r in found:
        by_source[r["source_size"]] += r["taken"]
    target = {r["source_size"]: r["target"] for r in found}
    assert all(abs(by_source[s] - target[s]) < 9 for s in target)  # equal rows share what is left, rounded down
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_buckets_don_t_change_the_draw(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 11), "s") for i in range(300)], "doc_id long, text string, source string")
    one = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=1.5).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=1.5).collect()} == one


def test_toxicity_learns_sentences_from_documents(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)]
    texts, labels = [], []
    for i in range(400):
        body = [" ".join(rng.choice(names, 8)) for _ in range(6)]
        labels.append(int(i % 5 == 0))
        if labels[-1]:
            body[i % 6] += " " + ("vile", "Foul")[i % 2]
        texts.append(". ".join(body))
    model = toxicity.fit(texts, labels)
    docs = spark.createDataFrame([(1, "good words here. nothing. so vile, this. end"), (2, "good words here. nothing"), (3, None), (4, "FOUL"), (5, "")], "doc_id int, text string")
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert found[1]["score"] > 0.5 and found[1]["worst_sentence"] == 2 and found[4]["score"] > 0.5
    assert max(found[i]["score"] for i in (2, 3, 5)) < 0.5 and found[3]["worst_sentence"] == -1
    located = toxicity.offending_sentences(docs, model).collect()
    assert [(r["doc_id"], r["sentence"], r["text"]) for r in located] == [(1, 2, " so vile, this"), (4, 0, "FOUL")]
    assert toxicity.fit([], []) == toxicity.Model({}, -20.0, 0.0)


def test_toxicity_pairs_and_scores_by_brute_force(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()][:40] + ["", "One. two!\nONE two two", "...", "½ 12"]
    seen = {}
    for text in texts:
        for f in {f for w in toxicity.WORD.findall(text.lower()) for f in toxicity.features(w)}:
            seen[f] = seen.get(f, 0) + 1
    want = []
    for i, text in enumerate(texts):
        for sentence in toxicity.sentences(text.lower()):
            if found := {f for w in toxicity.WORD.findall(sentence) for f in toxicity.features(w) if seen[f] >= 3}:
                want.append((i, found))
    names, row, column, owner = toxicity._pairs(texts, 3)
    got = [(int(i), set()) for i in owner]
    for r, c in zip(row, column, strict=True):
        got[r][1].add(names[c])
    assert got == want and len(row) == sum(len(found) for _, found in want)
    model = toxicity.Model({name: (-1) ** i * 0.1 * (i % 7) for i, name in enumerate(names)}, -2.0, 0.01)
    scored = toxicity.score_documents(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), model).collect()
    for r in scored:
        clean = 0.99
        for sentence in toxicity.sentences(r["text"].lower()):
            if known := {f for w in toxicity.WORD.findall(sentence) for f in toxicity.features(w) if f in model.weights}:
                z = -2.0 + sum(model.weights[f] for f in known)
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert math.isclose(r["score"], 1 - clean, abs_tol=1e-9)


def test_toxicity_score_doesnt_grow_with_length_and_takes_any_sum():
    names = [f"{a}{b}{c}" for a in "qxz" for b in "abcdefghijkl" for c in "abcdefghijkl"]
    model = toxicity.Model({"bad": 9.0, **dict.fromkeys(names, -3.0)}, -7.28, 0.0015)
    long = " ".join(f"Nothing is known here {i}." for i in range(20_000))
    assert abs(toxicity.score_text(long, model)[0] - 0.0015) < 1e-9 and toxicity.score_text(long + " a bad one.", model)[0] > 0.5
    mild = " ".join(names)
    assert toxicity.Scorer(model).sentence(mild) == 0.0 and abs(toxicity.score_text(mild, model)[0] - 0.0015) < 1e-9
    harsh = toxicity.Model(dict.fromkeys(names, 3.0), 0.0, 0.0)
    assert toxicity.score_text(mild, harsh)[0] == 1.0 == toxicity.Scorer(harsh).sentence(mild)


def test_toxicity_of_null_and_repeated_rows(spark):
    model = toxicity.fit(["kind words", "foul words"] * 20, [0, 1] * 20)
    docs = spark.createDataFrame([(1, "foul words"), (1, "foul words"), (None, "foul words"), (2, None), (2, "")], "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["text"] or "", round(r["score"], 9)) for r in toxicity.score_documents(docs, model).collect()))
    assert len(found) == 5 and found[0][2] == found[1][2] == found[2][2] > found[3][2] == found[4][2] == round(model.leak, 9)


def test_toxicity_rests_features_without_harm():
    noise = [f"word{i} filler{i % 7} and{i % 3} so on. Another sentence {i % 11} here" for i in range(300)]
    texts = [t + (". You vile wretch" if i % 4 == 0 else "") for i, t in enumerate(noise)]
    labels = [int(i % 4 == 0) for i in range(300)]
    for look in (1, 10):
        scorer = toxicity.Scorer(toxicity.fit(texts, labels, toxicity.Settings(look=look)))
        assert [scorer(t)[0] >= 0.5 for t in texts] == [bool(label) for label in labels]


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(100)] + [(5, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    assert len(toxicity.sample(labels, docs, toxicity.Settings(max_docs=30))[0]) == 30
    assert sum(map(len, toxicity.sample(labels, docs, toxicity.Settings(max_chars=95))[0])) <= 95


def test_langid(spark):
    rows = [(i, f"the thing and this {i}", "en") for i in range(40)] + [(100 + i, f"der die und das nicht {i}", "de") for i in range(40)] + [(300, "x", None), (301, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    asked = spark.createDataFrame([("nicht das",), ("this thing",), ("42 !",), ("",), (None,), ("ß" * 5000,)], "text string")
    found = [(r["lang_pred"], r["score"]) for r in langid.classify(asked, model).collect()]
    assert [lang for lang, _ in found][:5] == ["de", "en", "und", "und", "und"] and all(0 <= s <= 1 for _, s in found)
    assert langid.predict(["words"], langid.train(docs.limit(0)))[0] == ["und"]
    with pytest.raises(ValueError, match="max_langs"):
        langid.train(docs, langid.Settings(max_langs=1))


def test_topk_blocks_don_t_change_the_result(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 4, 6)]) for i in rng.permutation(120)] + [(5, [1, 1]), (5, [1, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, weights array<long>")
    found = [sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 9, *sizes).collect())) for sizes in ((8192, 2048), (7, 3))]
    assert found[0] == found[1] and len(found[0]) == 6 * 9


def test_blocked_filter_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"host{i}\n/p",) for i in range(5000)], "key string")
    bits = url_filter.build_filter(keys, 5000)
    hashes = np.array([r[0] for r in keys.select(F.xxhash64("key")).collect()]).view(np.uint64)
    assert url_filter.might_hold(bits, hashes).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert url_filter.might_hold(bits, others).mean() < 0.02


def test_a_filter_dealt_in_shares_passes_the_same_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE_BLOCKS", 16)
    entries = spark.createDataFrame([(f"host{i}\n/p",) for i in range(3000)], "key string")
    keyed = spark.createDataFrame([(f"host{i}\n/p" if i % 3 else None, i) for i in range(2000, 6000)] + [("host7\n/p", 7)] * 3, "key string, n int")
    blocks = url_filter.blocks_for(3000)
    passed = {r["n"] for r in url_filter.dealt_hits(keyed, entries, blocks).collect()}
    bits = url_filter.build_filter(entries, 3000)
    rows = keyed.where("key IS NOT NULL").select("n", F.xxhash64("key").alias("h")).collect()
    held = url_filter.might_hold(bits, np.array([r["h"] for r in rows]).view(np.uint64))
    assert passed - {r["n"] for r in keyed.where("key IS NULL").collect()} == {r["n"] for r, hit in zip(rows, held, strict=True) if hit}
    whole, dealt = (sorted(map(tuple, url_filter.listed_hits(keyed, entries, size).collect())) for size in (1 << 20, 1))
    assert whole == dealt and len(whole) == sum(1 for i in range(2000, 3000) if i % 3) + 3


def test_url_rules_without_a_filter_and_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://AA.b.com/x"), (2, None), (None, "http://b.com/xy")], "page_id long, url string")
    rules = spark.createDataFrame([("b.com", "/x", "block"), ("b.com", "/x", "allow"), ("aa.b.com", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    for limit in (64 << 20, 1):
        found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, limit).collect()}
        assert found == {1: ("aa.b.com", "allow"), 2: (None, "allow"), None: ("b.com/x", "block")}
    assert url_filter.judge(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def test_disclosing_terms_are_found_and_generalised(spark):
    fillers = ["morning", "evening", "window", "garden", "river", "mountain", "paper", "silver"]
    rows = [(i, f"{fillers[i % 8]} note {i}: surgeon Zarkov may be reached at z@clinic.org for the {fillers[(i + 3) % 8]}") for i in range(5)]
    rows += [(10 + i, f"{fillers[i % 8]} may be reached at noon for the {fillers[(i + 1) % 8]} note of day {i}") for i in range(200)]
    rows += [(900 + i, "much copied Unrelated words around copy@a.org here") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [docs_text[s["start"] : s["end"]] for s in r["term"]] for r in pii.find(docs).collect() for docs_text in [dict(rows)[r["doc_id"]]]}
    assert found[0] == ["surgeon", "Zarkov"] and found[4] == ["surgeon", "Zarkov"]
    assert not any(found[i] for i in found if 10 <= i < 900)
    assert found[900] == found[949] == ["much", "copied", "Unrelated", "words", "around", "here"]  # one text with one entity, however often it is copied
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "morning note 0: [TERM] [TERM] may be reached at [EMAIL] for the garden"
    assert clean[10] == dict(rows)[10]
