"""PII: term spans against plain Python, sanitised rows, and time on long texts."""

import re
import time
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
import regex

from casequarry.llm import pii, queries
from test_contracts import AWKWARD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]{2,}")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def sound(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain_terms(texts, context=120):
    """For each text its term spans, by counting every pair outright."""
    spans = [sorted((m.start(), m.end(), (kind, m[0].lower())) for kind, p in PATTERNS.items() for m in re.finditer(p, t) if sound(kind, m[0])) for t in texts]
    words = [[(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(t)] for t in texts]
    with_entity = {t for t, s in zip(texts, spans, strict=True) if s}
    total = len(with_entity) + sum(not s for s in spans)
    holding, together, entity_texts, done = defaultdict(int), defaultdict(int), defaultdict(set), set()
    for t, found, own in zip(texts, spans, words, strict=True):
        if t in done:
            continue
        done |= {t} if found else set()
        for term in {m[0] for m in TERM.finditer(t.lower())}:
            holding[term] += 1
        weights = defaultdict(int)
        for start, end, term in own:
            if any(start < e and s < end for s, e, _ in found):
                continue
            before, after = [x for x in found if x[0] < start - context], [x for x in found if x[0] >= end + context]
            near = [x for x in found if start - context <= x[0] < end + context]
            for s, e, entity in before[-1:] + near + after[:1]:
                weight = min(1000, 1000 * context // max(s - end, start - e, 1))
                weights[entity, term] = max(weights[entity, term], weight)
        for pair, weight in weights.items():
            together[pair] += weight
        for _, _, entity in found:
            entity_texts[entity].add(t)
    told = set()
    for (entity, term), weight in together.items():
        if weight / (1000 * (holding[term] + 1)) >= max(0.5, (len(entity_texts[entity]) / total) ** 0.5):
            told.add(term)
    return [[(s, e) for s, e, term in own if term in told and not any(s < b and a < e for a, b, _ in found)] for own, found in zip(words, spans, strict=True)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_term_spans_of_whole_tables(spark, sf):
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()
    want = {d["doc_id"]: own for d, own in zip(docs, plain_terms([d["text"] for d in docs]), strict=True)}
    got = {}
    for row in queries.op10_pii(spark, f"/root/testdata/{sf}").collect():
        got[row["doc_id"]] = [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s.startswith("term:")]
    assert got == want and any(want.values())


def test_terms_count_in_documents_without_the_entity_too(spark):
    texts = [f"Zebulon writes {i} times from a.b@c.org to us" for i in range(6)]
    texts += ["all that Zebulon said elsewhere, with no address", "plain words to us", "plain words from us"] + [t or "" for t in AWKWARD]
    rows = [(None if i % 4 == 1 else i % 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[6]], "doc_id long, text string")
    want = sorted((str(i), t, tuple(own)) for (i, t), own in zip([*rows, rows[6]], plain_terms([*texts, texts[6]]), strict=True))
    found = pii._found(docs, pii.Settings()).join(docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS of").distinct(), "of")
    got = sorted((str(r["doc_id"]), r["text"], tuple((s["start"], s["end"]) for s in r["term"])) for r in found.collect())
    assert got == want and (9, 16) in next(x[2] for x in got if "elsewhere" in x[1])


def test_every_row_is_sanitised_by_its_own_text(spark):
    rows = [(None, "Write to x@y.org or z", 1), (2, "ask q@w.net, then 10.0.0.1", 2), (2, "nothing here", 3), (2, None, 4), (2, "nothing here", 5), (5, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    got = {r["__id"]: (r["doc_id"], r["text"]) for r in pii.sanitised(docs, pii.Settings(residual=-1)).collect()}
    assert got == {1: (None, "Write to [EMAIL] or z"), 2: (2, "ask [EMAIL], then [IP]"), 3: (2, "nothing here"), 4: (2, ""), 5: (2, "nothing here"), 6: (5, "")}


def test_time_follows_the_number_of_addresses(spark):
    took = []
    for n in (4_000, 32_000):
        docs = spark.createDataFrame([(1, "".join(f"name{i} u{i}@host{i}.org\n" for i in range(n)))], "doc_id long, text string")
        began = time.monotonic()
        row = pii.find(docs).first()
        took.append(time.monotonic() - began)
        assert len(row["email"]) == n and row["email"][1]["start"] == len("name0 u0@host0.org\nname1 ")
    assert took[1] < 8 * took[0] + 10
