"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.functions import fixed


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it.

    Without it a text that many conditions look at would be lower-cased, or cleaned, for each of them.
    """
    return F.transform(F.array(value), use)[0]


def first_filled(*columns: Column | str) -> Column:
    """The first of the texts that is neither null nor empty; an empty text if there is none."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of at least four Latin letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def has_any(lowered: Column, keywords: Iterable[str]) -> Column:
    """Whether a lower-cased text contains one of the keywords."""
    found = F.lit(False)
    for keyword in dict.fromkeys(k.lower() for k in keywords):
        found = found | F.contains(lowered, F.lit(keyword))
    return found


def hits(lowered: Column, keywords: Iterable[str]) -> Column:
    """The keywords that a lower-cased text contains, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in keywords]).cast("array<string>"))


def without_negations(text: Column) -> Column:
    """The text without the lines that say something was not found."""
    lines = F.split(text, r"\R")
    return F.array_join(F.filter(lines, lambda line: ~has_any(F.lower(line), fixed.NEGATIONS)), "\n")


def without_tags(text: Column, tags: Iterable[str] = fixed.TAGS) -> Column:
    return F.regexp_replace(text, f"</?(?:{'|'.join(tags)})>", "")


def coloured(text: Column) -> Column:
    """Confidence tags as coloured markdown."""
    for tag in fixed.TAGS:
        text = F.regexp_replace(text, f"<{tag}>(.*?)</{tag}>", f":{tag}[**$1**]")
    return F.coalesce(text, F.lit(""))


def tagged(text: Column, tag: str) -> Column:
    """What stands between a pair of tags, on one line, each time."""
    return F.regexp_extract_all(text, F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))


def review_count(text: Column) -> Column:
    """How many items are marked doubtful."""
    return F.size(tagged(text, "orange")) + F.size(tagged(text, "red"))


def has_dimension(text: Column) -> Column:
    """Whether a text holds a dimension; digits, blanks and the bounds of words are those of ASCII, also beside other letters."""
    return text.rlike("(?i)" + fixed.DIMENSIONS_ASCII)


def cleaned(text: Column) -> Column:
    """The text without dimensions, what follows the end mark or a later section, and doubled blanks.

    ``without_repeats`` is the one further step, and needs Python.
    """

    def without(value: Column, numbers: bool) -> Column:
        for pattern, replacement in fixed.CLEANING:
            if (r"\d" in pattern) == numbers:
                value = F.regexp_replace(value, pattern, replacement)
        return value

    # most patterns need a digit, and most texts have none
    text = let(text, lambda value: F.when(value.rlike("[0-9]"), without(value, True)).otherwise(value))
    text = without(text, False)
    sections = F.split(F.substring_index(text, fixed.END_MARK, 1), fixed.LATER_SECTION, 2)
    return F.regexp_replace(F.regexp_replace(sections[0], "[ \t]+", " "), r"^\s+|\s+\z", "")


@F.pandas_udf(T.StringType())
def without_repeats(text: pd.Series) -> pd.Series:
    """The text cut where a sentence of its third section begins that stood in it before.

    Sentences of up to 20 characters don't count, and tags and case make no difference. Sequential by
    nature: each sentence is held against all before it.
    """
    import re

    section, tags, stops = re.compile(r"(?m)^(?:###\s+)?3\."), re.compile(r"<[^>]+>"), re.compile(r"\.\s+")

    def cut(value: str | None) -> str | None:
        begun = section.search(value) if value else None
        if not begun:
            return value
        body, known = value[begun.end() :], set()
        for sentence in (part.strip() for part in stops.split(body)):
            if len(sentence) > 20:
                plain = tags.sub("", sentence).lower().strip()
                if plain in known:
                    body = body[: body.find(sentence)]
                    break
                known.add(plain)
        return value[: begun.end()] + body.rstrip()

    return text.map(cut)


def issues(text: Column) -> Column:
    """What a description lacks: length, its sections, a verdict in the second, a vocabulary term."""
    heading = lambda n: rf"(?m)^(?:###?\s*)?{n}\."

    def found(value: Column) -> Column:
        parts = F.split(value, heading(2), 2)
        third_first = F.length(F.split(value, heading(3), 2)[0]) < F.length(parts[0])
        silent = ~F.coalesce(F.split(F.get(parts, 1), heading(3), 2)[0], F.lit("")).rlike(r"\b(True|False)\b")
        lacking = [F.when(~value.rlike(heading(n)), F.lit(fixed.NO_SECTION.format(n))) for n in (1, 2, 3)]
        lacking.append(F.when(value.rlike(heading(2)) & (third_first | silent), F.lit(fixed.NO_VERDICT)))
        lacking.append(F.when(~let(F.lower(value), lambda lowered: has_any(lowered, fixed.VOCABULARY)), F.lit(fixed.NO_TERM)))
        short = F.length(F.regexp_replace(value, r"^\s+|\s+\z", "")) < 50
        return F.when(short, texts([fixed.TOO_SHORT])).otherwise(F.array_compact(F.array(*lacking).cast("array<string>")))

    return let(F.coalesce(text, F.lit("")), found)


def selections(text: Column) -> Column:
    """The processes listed in the fourth section: structs of process_id, name and evidence."""
    block = F.regexp_extract(text, r"(?is)###\s*4\.?\s*PROCESS SELECTION(.*?)(?=###\s*\d|\z)", 1)
    line = r"(?m)^\s*[-•]\s*\[([A-Z0-9\-]+)\]\s+([^:：]+)[：:]\s*(.+)$"
    parts = [F.regexp_extract_all(block, F.lit(line), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("process_id", "name", "evidence"), strict=True)])
    return F.transform(rows, lambda r: F.struct(*[F.trim(r[n]).alias(n) for n in ("process_id", "name", "evidence")]))


def answer(text: Column) -> Column:
    """answer, reason and confidence from lines of ``key: value``, the last of a key counting."""
    lines = F.filter(F.split(text, r"\R"), lambda line: F.contains(line, F.lit(":")))

    def last(key: str) -> Column:
        mine = F.filter(lines, lambda line: F.lower(F.trim(F.substring_index(line, ":", 1))) == key)
        return F.trim(F.regexp_replace(F.try_element_at(mine, F.lit(-1)), "^[^:]*:", ""))

    confidence = F.lower(F.coalesce(last("confidence"), F.lit("medium")))
    return F.struct(
        F.lower(F.coalesce(last("answer"), F.lit("false"))).isin("true", "yes", "1").alias("answer"),
        F.coalesce(last("reason"), F.left(text, F.lit(300))).alias("reason"),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise(F.lit("medium")).alias("confidence"),
    )


def is_note(text: Column) -> Column:
    """Whether a line of a title block is an important note."""
    marked = F.lit(False)
    for symbol in fixed.NOTE_SYMBOLS:
        marked = marked | F.contains(text, F.lit(symbol))
    return let(F.lower(text), lambda lowered: has_any(lowered, fixed.NOTE_KEYWORDS)) | marked


def note_icon(text: Column) -> Column:

    def chosen(lowered: Column) -> Column:
        icon = F.lit("•")
        for keywords, shown in reversed(fixed.NOTE_ICONS):
            icon = F.when(has_any(lowered, keywords), F.lit(shown)).otherwise(icon)
        return icon

    return let(F.lower(text), chosen)


def summary(path: Column, symbols: Column, seconds: Column, description: Column) -> Column:
    """One line on a result."""
    short = F.when(F.coalesce(description, F.lit("")) == "", F.lit("(no description)")).otherwise(F.replace(F.left(description, F.lit(80)), F.lit("\n"), F.lit(" ")))
    return F.format_string("%s: symbols=%d, time=%.1fs | %s", path, symbols, seconds, short)


def shortened(text: Column, length: int = 350) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\ ", "___")


def view_context(labels: Column) -> Column:
    """The block of a prompt that says which image shows which view; empty without labels."""
    primary = lambda label: has_any(F.lower(label), fixed.PRIMARY_VIEWS)
    lines = F.transform(
        labels,
        lambda label, i: F.concat(F.lit("  Image "), (i + 1).cast("string"), F.lit(": "), label, F.lit(" View "), F.when(primary(label), F.lit("(primary evidence)")).otherwise(F.lit("(supporting reference)"))),
    )
    return F.when(F.size(labels) > 0, F.concat(F.lit("Images, in this order:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))


def prompt(*blocks: Column) -> Column:
    """Blocks of a prompt in a fixed order; null ones are left out."""
    return F.concat_ws("", *blocks)


def parent_report(name: Column, material: Column, structure: Column, features: Column) -> Column:
    """What is known of a parent drawing, in one line; empty parts are left out."""
    part = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}："), value))
    return F.concat_ws(" / ", part("零件名稱", F.trim(name)), part("材質", material), part("結構", structure), part("特徵", F.array_join(features, ", ")))


def title(shape: Column, description: Column, default: str = "(untitled)") -> Column:
    """A shape, or the first 40 characters of a description, or a default."""
    return F.coalesce(F.nullif(shape, F.lit("")), F.nullif(F.left(description, F.lit(40)), F.lit("")), F.lit(default))


def view_role(label: Column, exact: bool = True) -> Column:
    """Whether a view is primary evidence: by its exact label, or by any part of it whatever the case."""
    primary = label.isin(*fixed.PRIMARY_VIEWS) if exact else has_any(F.lower(label), fixed.PRIMARY_VIEWS)
    return F.when(primary, F.lit("primary")).otherwise(F.lit("supporting"))


def normalised(given: Column, recognised: Column) -> Column:
    """A recognised text's normal form: the one given, or the text trimmed and in lower case."""
    return F.coalesce(F.nullif(given, F.lit("")), F.lower(F.trim(recognised)))


def short_label(label: Column) -> Column:
    """A label up to its full-width bracket."""
    return F.trim(F.substring_index(label, "（", 1))


def page_labels(name: Column, pages: Column) -> Column:
    """One label a page: the name, with the page's number if there are several."""
    several = F.transform(F.sequence(F.lit(1), pages), lambda i: F.concat(name, F.lit(" (page "), i.cast("string"), F.lit(")")))
    return F.when(pages > 1, several).when(pages == 1, F.array(name)).otherwise(texts([]))


def paired(files: Column, labels: Column) -> Column:
    """Files and labels by position, as far as both go."""
    n = F.least(F.size(files), F.size(labels))
    return F.arrays_zip(F.slice(files, F.lit(1), n).alias("file"), F.slice(labels, F.lit(1), n).alias("label"))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def entry_id(time: Column, name: Column) -> Column:
    """An entry's id: its second and its file's name up to the first dot."""
    return F.concat(F.date_format(time, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring_index(name, ".", 1))


def doubtful(text: Column) -> Column:
    """What a description marks as doubtful, the least sure first."""
    return F.concat(tagged(text, "red"), tagged(text, "orange"))


def retrieval_allowed(use_retrieval: Column, use_model: Column) -> Column:
    """Whether similar cases are looked up: only where the model that reads them is used."""
    return F.coalesce(use_retrieval & use_model, F.lit(False))


def review_list(description: Column, warnings: Column) -> Column:
    """What a reviewer has to look at: doubtful marks, the least sure first, then warnings, each once."""
    return F.array_distinct(F.concat(F.coalesce(doubtful(description), texts([])), F.coalesce(warnings, texts([]))))
