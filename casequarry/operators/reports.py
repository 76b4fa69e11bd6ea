"""Reports: batch totals, results as JSON, first-seen rows, and comparison across conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.functions import text


def batch_report(results: DataFrame) -> DataFrame:
    """One row: total, failed (rows with errors), success."""
    failed = F.count_if(F.size(F.coalesce("errors", text.texts([]))) > 0)
    return results.agg(F.count("*").alias("total"), failed.alias("failed"), (F.count("*") - failed).alias("success"))


def as_json(columns: Sequence[str]) -> Column:
    """The columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def shown_symbols(symbols: Column) -> Column:
    """Symbols for output: confidence to 3 digits."""
    return F.transform(symbols, lambda s: F.struct(s["name"].alias("name"), F.round(s["confidence"], 3).alias("confidence")))


def shown_lines(lines: Column) -> Column:
    """Recognised lines for output: blank ones are left out."""
    return F.filter(lines, lambda line: F.trim(line) != "")


def result_record(results: DataFrame, path: str = "path") -> DataFrame:
    """One JSON a result for output, as ``record``: symbols and lines as shown, seconds to 2 digits, no vectors.

    ``results`` has path, seconds, description, first_description, symbols (structs of name, type, confidence,
    bbox), lines (array of text), warnings and errors.
    """
    symbols = F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"), F.round(s["confidence"], 3).alias("confidence"), s["bbox"].alias("bbox")))
    fields = [
        F.col(path).alias("image"), F.round("seconds", 2).alias("elapsed_seconds"), F.col("description").alias("vlm_description"), F.col("first_description").alias("vlm_description_v1"),
        symbols.alias("symbols"), shown_lines(F.col("lines")).alias("ocr_texts"), "warnings", "errors",
    ]
    return results.select(path, F.to_json(F.struct(*fields)).alias("record"))


def named_symbol(results: DataFrame, name: str) -> DataFrame:
    """``results`` (symbols: structs with a name) with only the symbols of one name, whatever the case, and whether there is one."""
    some = F.filter("symbols", lambda s: F.lower(s["name"]) == F.lower(F.lit(name)))
    return results.withColumn("symbols", some).withColumn("found", F.size("symbols") > 0)


def section(title: str, body: Column) -> Column:
    """A titled block of a report; null without a body."""
    return F.when(F.coalesce(F.trim(body), F.lit("")) != "", F.concat(F.lit(f"--- {title} ---\n"), F.trim(body)))


def result_text(name: Column, seconds: Column, sections: dict[str, Column]) -> Column:
    """A result as text: a heading with its name and time, then its blocks; empty ones are left out."""
    heading = F.format_string("=== %s (%.1fs) ===", name, seconds)
    return F.concat_ws("\n", heading, *[section(title, body) for title, body in sections.items()])


def in_order(values: Column) -> Column:
    """The distinct values of an array in the order they first have."""
    return F.array_distinct(values)


def with_notes(parts: DataFrame, notes: DataFrame, part: str) -> DataFrame:
    """``parts`` with the text that ``notes`` (part, bom) has for them, empty where it has none; of several the least."""
    one = notes.groupBy(part).agg(F.min("bom").alias("bom"))
    return parts.join(one, part, "left").withColumn("bom", F.coalesce("bom", F.lit("")))


def first_seen(rows: DataFrame, by: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an order; a minimum, so a hot key is summed up where it lies."""
    columns = [c for c in rows.columns if c not in order]
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    first = rows.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *columns)).alias("__r"))
    return first.select(*[F.col(f"__r.{c}").alias(c) for c in rows.columns])


def top_predictions(predictions: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """The k surest predictions of at least a confidence; ties by ord."""
    return predictions.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "ord").limit(k)


def finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf"))


def matrix(parts: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every part under every condition; both are small stated lists."""
    return parts.crossJoin(conditions)


def compared(results: DataFrame, part: str, condition: str, conditions: Sequence[str], value: str) -> DataFrame:
    """One row a part, one column a condition, each the sorted distinct values joined by a blank."""
    listed = F.array_join(F.array_sort(F.collect_set(value)), " ")
    return results.groupBy(part).pivot(condition, list(conditions)).agg(listed)


def pages_joined(lines: DataFrame, group: str) -> DataFrame:
    """Recognised lines (group, page, line, text) as one text each, with the number of lines.

    A page has a heading only if there are several.
    """
    per_page = lines.groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda r: r["text"]), "\n")
    pages = per_page.select(group, "page", body.alias("body"), F.size("lines").alias("n"))
    joined = pages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"), F.sum("n").alias("n_lines"))
    headed = F.transform("pages", lambda p: F.concat(F.lit("[page "), p["page"].cast("string"), F.lit("]\n"), p["body"]))
    return joined.select(group, F.when(F.size("pages") > 1, F.array_join(headed, "\n")).otherwise(F.col("pages")[0]["body"]).alias("text"), "n_lines")
