"""Personal data by information-theoretic sanitisation. DataFrame functions only.

Base spans come from patterns (email, ip, card, phone); their values are the protected entities. The
corpus then tells how strongly a term t reveals an entity e:

    PMI(t; e) = log2(p(e | t) / p(e)),   IC(e) = -log2 p(e),   p(e | t) = n(t, e) / (n(t) + smoothing).

IC - PMI = -log2 p(e | t) is what stays uncertain about e once t is seen. A term discloses e if that is at
most ``residual`` bits and at most half of IC, so rare entities, which are most, count like others, and a
common word near a common entity doesn't. A disclosing term is a span of kind ``term`` wherever it stands,
in documents without the entity too, and is generalised to its kind or removed like the base spans.

n(t, e) sums a weight over the texts that hold both: 1 up to ``context`` characters apart, and beyond
that the weight falls with the distance. A term of a text is held against every entity within ``context``
and against the nearest one on either side at any distance, so the work follows the length of a text and
not the product of its terms and entities. Equal texts that hold an entity count once, since copies are
no evidence. n(t) counts those and every document without an entity: what is published often tells little.
Weights are whole thousandths, so sums don't depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.llm.common import columns_of, cut, fresh

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, written so that each position is tried once: a run of characters is taken
#: whole or not at all, and only its beginning, or the end of the match before, can start a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
#: A term: a run of letters, marks and digits of any script.
TERM = r"[\p{L}\p{M}\p{N}]{2,}+"

SPAN = "array<struct<start:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int>>"
#: Running sums are taken in blocks of so many items, so that copying their arrays stays cheap.
BLOCK = 64
#: Disclosing terms, and the documents without an entity that hold one, are broadcast up to so many rows;
#: beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: What a co-occurrence within the context weighs.
FULL = 1000


@dataclass(frozen=True)
class Settings:
    """context: characters between an entity and a term within which a co-occurrence counts in full.

    residual: bits that may stay uncertain about an entity when a term discloses it. smoothing: added to
    the number of texts that hold a term.
    """

    context: int = 120
    residual: float = 1.0
    smoothing: float = 1.0


def running(values: str, combine: str) -> str:
    """SQL for all prefix results of an associative ``combine`` of a and b over an array of int.

    Taken block by block, so copying the growing arrays costs little for long ones.
    """
    grown = f"aggregate(%s, cast(array() AS array<int>), (d, b) -> concat(d, array(CASE WHEN size(d) = 0 THEN %s ELSE {combine.format(a='d[size(d) - 1]', b='%s')} END)))"
    short, of_block = grown % ("v", "b", "b"), grown % (f"slice(v, k * {BLOCK} + 1, {BLOCK})", "b", "b")
    totals = grown % ("bs", "b[size(b) - 1]", "b[size(b) - 1]")
    carried = f"flatten(transform(bs, (x, i) -> CASE WHEN i = 0 THEN x ELSE transform(x, y -> {combine.format(a='t[i - 1]', b='y')}) END))"
    blocks = f"transform(sequence(0, cast(ceil(size(v) / {BLOCK}) AS int) - 1), k -> {of_block})"
    long = f"transform(array({blocks}), bs -> transform(array({totals}), t -> {carried})[0])[0]"
    return f"transform(array({values}), v -> CASE WHEN size(v) <= {BLOCK} THEN {short} ELSE {long} END)[0]"


SUM, MOST = "{a} + {b}", "greatest({a}, {b})"


def located(text: str, pattern: str) -> str:
    """SQL for all matches of ``pattern``, leftmost and not overlapping, with code point positions."""
    steps = "zip_with(p.found, slice(p.gaps, 1, size(p.found)), (f, g) -> length(g) + length(f))"
    spans = f"zip_with(p.found, {running(steps, SUM)}, (f, e) -> named_struct('start', e - length(f), 'end', e, 'value', f))"
    return f"transform(array(named_struct('found', regexp_extract_all({text}, r'{pattern}', 0), 'gaps', split({text}, r'{pattern}', -1))), p -> {spans})[0]"


#: Whether the digits of ``s.value`` pass the Luhn check: every second one from the end counts twice, its digits summed.
LUHN = """aggregate(sequence(1, length(regexp_replace(s.value, '[^0-9]', ''))), 0, (t, i) -> t + int(CASE
    WHEN i % 2 = 1 THEN int(substr(reverse(regexp_replace(s.value, '[^0-9]', '')), i, 1))
    ELSE (2 * int(substr(reverse(regexp_replace(s.value, '[^0-9]', '')), i, 1))) div 10 + (2 * int(substr(reverse(regexp_replace(s.value, '[^0-9]', '')), i, 1))) % 10 END)) % 10 = 0"""
N_DIGITS = "length(regexp_replace(s.value, '[^0-9]', ''))"
#: What a match of each kind has to pass, and what a text needs for a match.
PASSES = {
    "email": "true",
    "ip": rf"s.value RLIKE r'^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$'",
    "card": f"CASE WHEN {N_DIGITS} BETWEEN 13 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"{N_DIGITS} BETWEEN 9 AND 15",
}
NEEDS = {"email": "contains({text}, '@')", "ip": "{text} RLIKE '[0-9]'", "card": "{text} RLIKE '[0-9]'", "phone": "contains({text}, '+')"}


def base_spans(kind: str, text: str) -> str:
    """SQL for the spans of a kind in a text, which isn't null; texts without a character it needs aren't searched."""
    return f"CASE WHEN {NEEDS[kind].format(text=text)} THEN filter({located(text, PATTERNS[kind])}, s -> {PASSES[kind]}) ELSE cast(array() AS {SPAN}) END"


def below(ordered: str, limit: str) -> str:
    """SQL for how many of an ascending array's numbers are smaller than ``limit``, by halving."""
    steps = ", ".join(str(1 << i) for i in reversed(range(31)))
    fits = f"h <= size({ordered}) - n AND {ordered}[n + h - 1] < {limit}"
    return f"aggregate(filter(array({steps}), h -> h <= size({ordered})), 0, (n, h) -> CASE WHEN {fits} THEN n + h ELSE n END)"


def terms(text: str) -> str:
    """SQL for the distinct terms of a whole text, lower-cased."""
    return f"array_distinct(regexp_extract_all(lower({text}), r'{TERM}', 0))"


def apart(words: str, spans: str) -> str:
    """SQL for those of ``words`` that touch none of ``spans``, sorted by start; both have start and end."""
    alone = f"transform(array({below('q.starts', 'w.end')}), m -> m = 0 OR q.reach[m - 1] <= w.start)[0]"
    ends = running(f"transform({spans}, s -> s.end)", MOST)
    view = f"named_struct('starts', transform({spans}, s -> s.start), 'reach', {ends})"
    return f"CASE WHEN size({spans}) = 0 THEN {words} ELSE transform(array({view}), q -> filter({words}, w -> {alone}))[0] END"


def pairs(words: str, entities: str, context: int) -> str:
    """SQL for entity, term, weight of every term and each entity within ``context``, and the nearest on either side."""
    gap = "greatest(e.start - w.end, w.start - e.end, 1)"
    weighed = f"named_struct('entity', e.entity, 'term', lower(w.value), 'weight', least({FULL}, int({FULL * context} div {gap})))"
    first, after = f"greatest({below('q', f'w.start - {context}')}, 1)", f"{below('q', f'w.end + {context}')} + 2"
    near = f"transform(array({first}), n -> slice({entities}, n, {after} - n))[0]"
    return f"transform(array(transform({entities}, e -> e.start)), q -> flatten(transform({words}, w -> transform({near}, e -> {weighed}))))[0]"


def all_spans() -> str:
    """SQL for the base spans of all kinds by start, each with a hash of its kind and value."""
    of = "transform({0}, s -> named_struct('start', s.start, 'end', s.end, 'entity', xxhash64('{0}', lower(s.value))))"
    return f"array_sort(concat({', '.join(of.format(kind) for kind in KINDS)}))"


def spanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with one array of spans for each kind of base span in a text column that isn't null."""
    return docs.withColumns({kind: F.expr(base_spans(kind, text)) for kind in KINDS})


def disclosing_terms(docs: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The distinct terms that disclose an entity, one row each.

    ``docs`` has the texts of all documents; ``found`` has, for each document with an entity, ``of`` (the hash
    of its text), ``entities``, ``words`` (outside of entities) and ``terms`` (of the whole text). No row of
    either leaves a scan but in sums a term, or a term and an entity of one text.
    """
    n_docs = docs.count()
    texts = found.groupBy("of").agg(F.count("*").alias("copies"))
    copies, distinct = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    total = float(n_docs - copies + distinct)
    met = found.select("of", F.explode(F.expr(pairs("words", "entities", settings.context))).alias("p"))
    together = met.groupBy("of", "p.entity", "p.term").agg(F.max("p.weight").alias("weight")).groupBy("entity", "term").agg(F.sum("weight").alias("together"))
    named = found.select("of", F.explode(F.array_distinct(F.transform("entities", lambda e: e["entity"]))).alias("entity"))
    entities = named.distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    everywhere = docs.select(F.explode(F.expr(terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    held = found.select("of", F.explode("terms").alias("term")).groupBy("of", "term").agg(F.count("*").alias("rows"))
    again = held.groupBy("term").agg((F.sum("rows") - F.count("*")).alias("again"))
    seen = everywhere.join(again, "term").select("term", (F.col("n") - F.col("again")).alias("n_term"))
    share = F.col("together") / (F.lit(float(FULL)) * (F.col("n_term") + F.lit(settings.smoothing)))
    least = F.greatest(F.lit(2.0**-settings.residual), F.sqrt(F.col("n_entity") / F.lit(total)))
    return together.join(seen, "term").join(entities, "entity").where(share >= least).select("term").distinct()


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The personal data of every whole text of ``docs`` (doc_id, text), a null text being empty.

    Returns doc_id, one array of (start, end) for each of email, ip, card, phone and term, in code
    points, the end exclusive. Documents are rows: repeated ids are searched each, and null ids too.
    Matches that fail their check are dropped without another try inside them. A term that touches a
    base span is no span of its own. An empty table gives no rows.
    """
    return _found(docs, settings).drop("of")


def _found(docs: DataFrame, settings: Settings) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("of"))
    searched = spanned(slim, "text").withColumn("entities", F.expr(all_spans()))
    some = F.size("entities") > 0
    words, own = F.expr(apart(located("text", TERM), "entities")), F.expr(terms("text"))
    base = cut(searched.select("doc_id", "of", *[_places(kind).alias(kind) for kind in KINDS], "entities", F.when(some, words).alias("words"), F.when(some, own).alias("terms")))
    told = _small(cut(disclosing_terms(slim, base.where(some), settings)))
    key = ["doc_id", "of"]
    beside = base.where(some).select(*key, F.explode("words").alias("w"))
    holding = slim.select(*key, F.explode(own).alias("term")).join(told, "term", "left_semi").select(*key).distinct()
    elsewhere = _same(holding, base.where(some).select(*key), "left_anti")
    others = _same(slim, _small(cut(elsewhere)), "left_semi").select(*key, F.explode(F.expr(located("text", TERM))).alias("w"))
    shown = beside.unionByName(others).select(*key, F.lower("w.value").alias("term"), "w.start", "w.end").join(told, "term", "left_semi")
    added = shown.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("term"))
    joined = _same(base.drop("words", "terms"), added, "left")
    return joined.select(*key, *KINDS, F.coalesce("term", F.array().cast(PLACES)).alias("term"))


def _small(rows: DataFrame) -> DataFrame:
    """A computed table, broadcast if it is under its bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """A join on doc_id, null being equal to null, and the hash of the text."""
    other = b.withColumnsRenamed({"doc_id": "__id", "of": "__of"})
    return a.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), how)


def _places(spans: str) -> Column:
    return F.expr(f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end))")


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans of the kinds in their order, then by start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def redacted(text: str, spans: str) -> str:
    """SQL for the text with each of ``spans`` (start, end, label), sorted by start, generalised to its label.

    Of overlapping spans the first one's label stands, and what the others cover beyond it is removed.
    The text is cut into blocks once, so a span costs what it covers and not the length of the text.
    """
    size = 1 << 10

    def piece(start: str, end: str) -> str:
        some = f"array_join(slice(q.blocks, int({start} div {size}) + 1, int({end} div {size} - {start} div {size}) + 1), '')"
        return f"CASE WHEN {end} > {start} THEN substr({some}, int({start} % {size} + 1), int({end} - {start})) ELSE '' END"

    done = "CASE WHEN i = 0 THEN 0 ELSE q.reach[i - 1] END"
    part = f"transform(array({done}), o -> concat({piece('o', 's.start')}, CASE WHEN s.start >= o THEN s.label ELSE '' END))[0]"
    last = "q.reach[size(q.reach) - 1]"
    ends = running(f"transform({spans}, s -> s.end)", MOST)
    view = f"named_struct('blocks', regexp_extract_all({text}, r'(?s).{{1,{size}}}', 0), 'reach', {ends})"
    whole = f"concat(array_join(transform({spans}, (s, i) -> {part}), ''), {piece(last, f'length({text})')})"
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE transform(array({view}), q -> {whole})[0] END"


def sanitised(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with all spans of the texts generalised to ``[KIND]``.

    Every row stays, with its other columns: rows without an id and rows that repeat one are sanitised
    each by its own text, and a null text becomes empty.
    """
    kinds = (*KINDS, "term")

    labelled = [f"transform({kind}, s -> named_struct('start', s.start, 'end', s.end, 'label', '[{kind.upper()}]'))" for kind in kinds]
    id_, hash_, spans, whole = fresh(docs, "id", "hash", "spans", "whole")
    marked = _found(docs, settings).select(F.col("doc_id").alias(id_), F.col("of").alias(hash_), F.expr(f"array_sort(concat({', '.join(labelled)}))").alias(spans)).dropDuplicates([id_, hash_])
    filled = docs.withColumn(whole, F.coalesce("text", F.lit("")))
    joined = filled.join(marked, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(whole) == F.col(hash_)), "left")
    return joined.select(*[F.expr(redacted(whole, spans)).alias("text") if name == "text" else column for name, column in zip(docs.columns, columns_of(docs.columns), strict=True)])
