"""Keyword and pattern rules: processes, skills, and what a parent drawing says.

A rule catalogue is a sequence of (process_id, name, description keywords, notes keywords). It is part
of the plan as literals, so that a text meets all rules in one row and nothing is joined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.functions import fixed, text

Rule = tuple[str, str, Sequence[str], Sequence[str]]


def _catalogue(rules: Sequence[Rule]) -> Column:
    def one(order: int, rule: Rule) -> Column:
        process_id, name, seen, noted = rule
        return F.struct(F.lit(process_id).alias("process_id"), F.lit(name).alias("name"), text.texts(seen).alias("seen"), text.texts(noted).alias("noted"), F.lit(order).alias("ord"))

    kind = "array<struct<process_id:string,name:string,seen:array<string>,noted:array<string>,ord:int>>"
    return F.array(*[one(i, rule) for i, rule in enumerate(rules)]).cast(kind)


def infer(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str], description: str = "description", notes: str = "notes", known: str = "priors", least: float = 0.5) -> DataFrame:
    """Processes that the description or the notes of each row call for, one row each.

    Adds process_id, process_name, confidence (1.0 for both, 0.9 for the notes, 0.7 for the description,
    and 0.1 more, up to 1, if ``known`` names the process or its id), source, clues (up to three
    keywords each), and rank within the row by confidence, then the catalogue's order.
    """
    inputs = F.struct(
        F.lower(text.without_negations(F.coalesce(F.col(description), F.lit("")))).alias("seen"),
        F.lower(F.coalesce(F.col(notes), F.lit(""))).alias("noted"),
        F.transform(F.coalesce(F.col(known), text.texts([])), F.lower).alias("known"),
    )

    def judged(rule: Column, given: Column) -> Column:
        within = lambda words, where: F.filter(words, lambda w: F.contains(given[where], F.lower(w)))
        return F.struct(rule.alias("rule"), within(rule["seen"], "seen").alias("seen"), within(rule["noted"], "noted").alias("noted"))

    def scored(hit: Column, given: Column) -> Column:
        seen, noted, rule = F.size(hit["seen"]) > 0, F.size(hit["noted"]) > 0, hit["rule"]
        base = F.when(seen & noted, 1.0).when(noted, 0.9).otherwise(0.7)
        bonus = F.when(F.array_contains(given["known"], F.lower(rule["name"])) | F.array_contains(given["known"], F.lower(rule["process_id"])), 0.1).otherwise(0.0)
        listed = lambda words: F.array_join(F.slice(words, 1, 3), "、")
        clues = F.array_compact(
            F.array(
                F.when(noted, F.concat(F.lit("notes: "), listed(hit["noted"]))), F.when(seen, F.concat(F.lit("seen: "), listed(hit["seen"])))
            )
        )
        return F.struct(
            (-F.round(F.least(F.lit(1.0), base + bonus), 2)).alias("down"),
            rule["ord"].alias("ord"),
            rule["process_id"].alias("process_id"),
            rule["name"].alias("process_name"),
            F.when(seen & noted, "COMBINED").when(noted, "BOM").otherwise("VLM").alias("source"),
            clues.alias("clues"),
        )

    def ranked(given: Column) -> Column:
        met = F.filter(F.transform(_catalogue(rules), lambda rule: judged(rule, given)), lambda hit: (F.size(hit["seen"]) > 0) | (F.size(hit["noted"]) > 0))
        return F.array_sort(F.filter(F.transform(met, lambda hit: scored(hit, given)), lambda s: -s["down"] >= least))

    rows = docs.select(*keep, F.posexplode(text.let(inputs, ranked)).alias("pos", "p"))
    return rows.select(*keep, (F.col("pos") + 1).alias("rank"), "p.process_id", "p.process_name", (-F.col("p.down")).alias("confidence"), "p.source", "p.clues")


def _has(lowered: Column, pattern: str) -> Column:
    """Whether a lower-cased text has one of a pattern's alternatives; plain ones are searched as text."""
    plain, other = [], []
    for alternative in re.split(r"\|(?![^\[]*\])", pattern):
        (plain if re.fullmatch(r"\w+", alternative) else other).append(alternative)
    found = text.has_any(lowered, plain)
    return found | lowered.rlike(f"(?U){'|'.join(other)}") if other else found


def skills(context: Column) -> Column:
    """The skills whose pattern a text has, in the rules' order; none for a blank text."""

    def found(lowered: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_has(lowered, pattern), F.lit(skill)) for skill, pattern, _ in fixed.SKILLS]).cast("array<string>"))

    return text.let(F.lower(F.coalesce(context, F.lit(""))), found)


def described(found: Column) -> Column:
    """Descriptions of skills, joined; an unknown one stands for itself."""
    names = F.create_map(*[F.lit(x) for skill, _, name in fixed.SKILLS for x in (skill, name)])
    return F.array_join(F.transform(found, lambda s: F.coalesce(names[s], s)), ", ")


def first_label(lowered: Column, labels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first label with a hit, or null."""
    return F.coalesce(*[F.when(text.has_any(lowered, keywords), F.lit(label)) for label, keywords in labels])


def all_labels(lowered: Column, labels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Every label with a hit, in order."""
    return F.array_compact(F.array(*[F.when(text.has_any(lowered, keywords), F.lit(label)) for label, keywords in labels]).cast("array<string>"))


def parent_context(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with what its text says of material, customer, cleanroom, surfaces and specials, the
    keywords found, and the processes that these trigger, sorted."""
    groups = [k for _, k in fixed.MATERIALS] + [k for _, k in fixed.CUSTOMERS] + [fixed.CLEANROOM] + [k for _, k in fixed.SURFACES] + [k for _, k in fixed.SPECIALS]
    names = ("material", "customer", "cleanroom", "surfaces", "specials", "keywords")

    def said(lowered: Column) -> Column:
        found = (
            first_label(lowered, fixed.MATERIALS),
            first_label(lowered, fixed.CUSTOMERS),
            F.when(text.has_any(lowered, fixed.CLEANROOM), F.lit("detected")),
            all_labels(lowered, fixed.SURFACES),
            all_labels(lowered, fixed.SPECIALS),
            F.array_sort(F.array_distinct(text.hits(lowered, [k for group in groups for k in group]))),
        )
        return F.struct(*[value.alias(name) for name, value in zip(names, found, strict=True)])

    def with_triggered(context: Column) -> Column:
        none = text.texts([])
        parts = [text.texts(fixed.DEFAULT_PROCESSES), F.when(context["cleanroom"].isNotNull(), text.texts(fixed.CLEANROOM_PROCESSES)).otherwise(none)]
        parts += [F.when(context["customer"] == name, text.texts(codes)).otherwise(none) for name, codes in fixed.CUSTOMER_PROCESSES]
        parts += [F.when(F.array_contains(context["specials"], name), text.texts(codes)).otherwise(none) for name, codes in fixed.SPECIAL_PROCESSES]
        return F.struct(*[context[name].alias(name) for name in names], F.array_sort(F.array_distinct(F.concat(*parts))).alias("triggered"))

    context = text.let(text.let(F.lower(F.coalesce(F.col(column), F.lit(""))), said), with_triggered)
    return docs.select("*", F.inline(F.array(context)))


def vocabulary_use(docs: DataFrame, vocabulary: Sequence[str] = fixed.VOCABULARY, column: str = "description") -> DataFrame:
    """term, n_entries: how many rows use each term, of those that any uses.

    A row gives the numbers of the terms it uses, and those are counted where they are before a row for
    each term and task is shuffled.
    """

    def used(lowered: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(term.lower())), F.lit(term)) for term in vocabulary]))

    terms = docs.select(F.explode(text.let(F.lower(F.coalesce(F.col(column), F.lit(""))), used)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n_entries"))


def most_used(docs: DataFrame, k: int = 10, vocabulary: Sequence[str] = fixed.VOCABULARY, column: str = "description") -> DataFrame:
    """The k terms that most rows use, ties by the vocabulary's order: rank, term, n_entries."""
    used = vocabulary_use(docs, vocabulary, column)
    order = Window.orderBy(F.desc("n_entries"), F.array_position(text.texts(list(vocabulary)), F.col("term")))
    return used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rank", "term", "n_entries")


def parent_payload(docs: DataFrame, column: str = "payload") -> DataFrame:
    """``docs`` with the model's JSON on a parent drawing as material, structure, features, notes.

    Features that are one string are an array of it, and whatever else isn't an array is an empty one;
    missing fields are empty texts. Text that isn't a JSON object gives empty values throughout.
    """
    field = lambda name: F.get_json_object(column, f"$['{name}']")
    filled = lambda *names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names], F.lit(""))
    raw = field("global_features")
    whole = F.from_json(column, "global_features string", {"mode": "PERMISSIVE"})["global_features"]
    is_list, is_number = F.coalesce(F.left(F.trim(raw), F.lit(1)) == "[", F.lit(False)), F.col(column).rlike(r'"global_features"\s*:\s*[^"\s]')
    features = F.when(is_list & is_number, F.from_json(raw, "array<string>")).when(~is_number & whole.isNotNull(), F.array(whole)).otherwise(text.texts([]))
    named = {"material": filled("material_spec", "material"), "structure": filled("3d_structure"), "features": F.coalesce(features, text.texts([])), "notes": filled("bom_notes")}
    return docs.withColumns(named)
