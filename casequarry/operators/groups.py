"""Drawing groups: parents, children by longest prefix, and orphans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.functions import fixed


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def group_of_parent(name: Column) -> Column:
    """A parent's group: its stem without a mark of annotation, or the stem if nothing else is left."""
    bare = F.trim(F.regexp_replace(stem(name), fixed.ANNOTATED, ""))
    return F.coalesce(F.nullif(bare, F.lit("")), stem(name))


def without_view(name: Column) -> Column:
    """A stem without the view name it ends with; the longest view names are tried first."""
    bare = F.regexp_replace(name, r"(?i)\.pdf$", "")
    tries = [F.trim(F.regexp_replace(bare, rf"(?iu)[-_ ]+{re.escape(token)}.*$", "")) for token in sorted(fixed.VIEW_TOKENS, key=len, reverse=True)]
    return F.coalesce(F.get(F.filter(F.array(*tries), lambda t: (t != "") & (t != bare)), 0), bare)


def parents(files: DataFrame, *within: str) -> DataFrame:
    """group_id, parent: the first pdf of a group by name, or the first one marked as not annotated; one for each of ``within``."""
    pdfs = files.where(suffix(F.col("name")) == "pdf").select(*within, "name", group_of_parent(F.col("name")).alias("group_id"))
    order = F.struct(~F.contains(stem(F.col("name")), F.lit(fixed.UNANNOTATED)), F.col("name"))
    return pdfs.groupBy(*within, "group_id").agg(F.min_by("name", order).alias("parent")).drop(*within)


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``rows`` with the longest of ``prefixes`` that its text starts with, whatever the case; else null.

    Each row is looked up once for every length that some prefix has, by equality, so the work is
    linear in the rows and not in rows times prefixes; the lengths are few, and are all that the
    driver gets.
    """
    lengths = [r[0] for r in prefixes.select(F.length(prefix).alias("n")).distinct().orderBy(F.desc("n")).collect()]
    if not lengths:
        return rows.withColumn(prefix, F.lit(None).cast("string"))
    distinct = rows.select(F.col(text).alias("__text")).distinct()
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("__text"))
    heads = F.transform(fitting, lambda n: F.lower(F.substr(F.col("__text"), F.lit(1), n)))
    keyed = distinct.select("__text", F.explode(heads).alias("__key"))
    known = prefixes.groupBy(F.lower(prefix).alias("__key")).agg(F.min(prefix).alias(prefix))
    found = keyed.join(known, "__key").groupBy("__text").agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(found, F.col(text) == F.col("__text"), "left").drop("__text")


def discover(files: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """group_id, parent (or null), children (sorted) of a listing (name).

    Images belong to the group whose id is their longest prefix; others form groups by their stems
    without view names, which may be an existing group's. ``heads`` are the groups' parents, by default those of the
    listing; a group with several has a row, with all its children, for each.
    """
    heads = parents(files) if heads is None else heads
    images = files.where(suffix(F.col("name")).isin(*fixed.IMAGE_SUFFIXES)).select("name")
    placed = longest_prefix(images, "name", heads.select("group_id"), "group_id")
    placed = placed.withColumn("group_id", F.coalesce("group_id", without_view(stem(F.col("name")))))
    children = placed.groupBy("group_id").agg(F.array_sort(F.collect_list("name")).alias("children"))
    joined = heads.join(children, "group_id", "full")
    return joined.select("group_id", "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def groups_of_path(files: DataFrame, name: str | None) -> DataFrame:
    """Groups of a folder, or of one file: a pdf is a parent without children, an image a lone child."""
    if name is None:
        return discover(files)
    one, none = files.where(F.col("name") == name), F.array().cast("array<string>")
    pdf = suffix(F.col("name")) == "pdf"
    image = suffix(F.col("name")).isin(*fixed.IMAGE_SUFFIXES)
    group = F.when(pdf, group_of_parent(F.col("name"))).otherwise(without_view(stem(F.col("name"))))
    return one.where(pdf | image).select(group.alias("group_id"), F.when(pdf, F.col("name")).alias("parent"), F.when(pdf, none).otherwise(F.array("name")).alias("children"))


def mode(parent: Column, children: Column) -> Column:
    """How a group is analysed: both, its children alone, its parent alone as a child, or not at all."""
    some = F.size(children) > 0
    return F.when(parent.isNotNull() & some, "full").when(some, "child_only").when(parent.isNotNull(), "parent_as_child").otherwise("skip")


def existing(children: DataFrame, files: DataFrame) -> DataFrame:
    """``children`` (name) with whether each is among the files."""
    there = files.select("name").distinct().withColumn("exists", F.lit(True))
    return children.join(there, "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def overridden(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Groups (group_id, parent, children) as found, but as ``stated`` where they are stated."""
    return found.join(stated.select("group_id").distinct(), "group_id", "left_anti").unionByName(stated)
