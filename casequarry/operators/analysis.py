"""The analysis of requests: rules, retrieval, two passes of a model, inference, in one chain.

A request has request_id, image_hash, notes, parent_text. The model and the embedding are providers;
what they return is kept before it is used twice, so no request is sent twice by a later stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.functions import text
from casequarry.operators import providers, retrieval, rules
from casequarry.session import kept

#: Skill and what its hit is called in a prompt. Fixed values.
ANCHORS = (
    ("scan_weld_symbols", "Weld Symbol"),
    ("scan_thread_marks", "Thread / Tap Mark"),
    ("scan_holes", "Hole / Thru-hole"),
    ("scan_bend_lines", "Bend Line"),
    ("scan_surface_marks", "Surface Finish Mark"),
    ("scan_tolerance_marks", "Tolerance Callout"),
    ("scan_insert_marks", "Insert / Rivet"),
)
#: Codes of the agents' candidates by their domain. Fixed values.
AGENT_CODES = {
    "geometry": ("C01", "C03", "C05", "D01", "D10", "E11", "F05", "F06", "K01"),
    "structure": ("D06", "F01", "F03", "F14", "F23", "Q01"),
    "surface": ("E01", "E02", "F11", "H01", "H03", "H04", "H06", "H14", "O02", "Q04", "Q07"),
    "quality": ("H26", "H27", "I02", "I04", "I12", "I19", "Q11"),
}
CACHED = "exact hash match: the stored description is used"


def anchored(notes: Column) -> Column:
    """The skills that notes call for, as anchors of a prompt."""
    names = F.create_map(*[F.lit(x) for pair in ANCHORS for x in pair])
    return F.transform(rules.skills(notes), lambda s: F.concat(F.lit("[System] Detected "), names[s]))


def prompted(notes: Column, anchors: Column, guide: str = "", case: Column | None = None) -> Column:
    """The prompt of a pass: notes, anchors, a similar case, the guide; empty blocks are left out."""
    block = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body, F.lit("\n")))
    parts = [block("Notes", notes), block("Confirmed", F.array_join(anchors, "\n"))]
    parts += [block("Similar case", case)] if case is not None else []
    return text.prompt(*parts, block("Guide", F.lit(guide)), F.lit("Describe the part."))


def agents(spark: SparkSession) -> DataFrame:
    """domain, code: the agents' candidates, one row a code."""
    rows = [F.struct(F.lit(domain).alias("domain"), F.lit(code).alias("code")) for domain, codes in AGENT_CODES.items() for code in codes]
    return spark.range(1).select(F.inline(F.array(*rows)))


def request(requests: DataFrame) -> DataFrame:
    """``requests`` with notes: the locked ones if there are any, else the ones typed in."""
    return requests.withColumn("notes", F.coalesce(F.nullif(F.trim("locked_notes"), F.lit("")), F.col("typed_notes"), F.lit("")))


def classified(requests: DataFrame, key: str, column: str, observer: providers.Factory, classifiers: dict[str, providers.Factory]) -> DataFrame:
    """One observation of each request, then every domain's classification of that observation.

    Returns key, observation, answers (a map from domain to answer; no answer is ``(no output)``), error. The
    observation is kept before the classifiers read it, so it is made once; where it failed nothing is
    classified. A domain's classifier is told its candidate codes.
    """
    seen = kept(providers.apply(requests.select(key, column), column, observer, "observation", "string").drop(column))
    out = seen.withColumn("__prompt", F.col("observation"))
    for domain, factory in classifiers.items():
        codes = ", ".join(AGENT_CODES.get(domain, ()))
        asked = out.withColumn("__prompt", F.when(F.col("observation").isNotNull(), F.concat(F.lit(f"[{domain}] candidates: {codes}\n"), "observation")))
        out = providers.apply(asked.withColumnRenamed("error", "__error"), "__prompt", factory, f"__{domain}", "string").drop("error").withColumnRenamed("__error", "error")
    pairs = [x for domain in classifiers for x in (F.lit(domain), F.coalesce(f"__{domain}", F.lit("(no output)")))]
    answers = F.when(F.col("observation").isNotNull(), F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,string>"))
    return out.select(key, "observation", answers.alias("answers"), "error")


def confirmed_symbols(hits: DataFrame, key: str) -> DataFrame:
    """key, symbols, anchors: the distinct symbols found on any view of a drawing, sorted, and as anchors of a prompt."""
    found = hits.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    return found.withColumn("anchors", F.transform("symbols", lambda name: F.concat(F.lit("[CV-CONFIRMED] "), name)))


def counts(features: DataFrame) -> DataFrame:
    """``features`` (bend_lines, holes: arrays) with has_bends and hole_count; a null array is empty."""
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))
    return features.withColumns({"has_bends": size("bend_lines") > 0, "hole_count": size("holes")})


def analyse(requests: DataFrame, cases: DataFrame, catalogue: Sequence[rules.Rule], model: providers.Factory, embedder: providers.Factory, guide: str = "", k: int = 3) -> DataFrame:
    """request_id, description, first_description, match_type, reference, inferences, selections, warnings, error.

    A request whose hash is stored gets that case's description, and neither model nor inference. Others
    are described, and described again with the best similar case if there is one. ``cases`` has the
    columns of retrieval and correct_processes (array).
    """
    effective = text.first_filled("notes", "parent_text")
    asked = requests.withColumns({"effective": effective, "anchors": anchored(effective)})
    stored = cases.select(F.col("entry_id").alias("reference"), F.col("description").alias("stored"), "correct_processes")
    exact = retrieval.exact_match(requests.withColumnRenamed("request_id", "query_id"), cases).join(stored, F.col("entry_id") == F.col("reference"))
    none = F.array().cast("array<struct<process_id:string,confidence:double>>")
    chosen = F.array().cast("array<struct<process_id:string,name:string,evidence:string>>")
    nothing = F.lit(None).cast("string")
    cached = exact.select(
        F.col("query_id").alias("request_id"), F.col("stored").alias("description"), nothing.alias("first_description"), "match_type", F.col("reference").cast("string").alias("reference"),
        none.alias("inferences"), chosen.alias("selections"), text.texts([CACHED]).alias("warnings"), nothing.alias("error"),
    )
    rest = asked.join(cached.select("request_id"), "request_id", "left_anti").withColumn("prompt", prompted(F.col("effective"), F.col("anchors"), guide))
    first = providers.apply(rest, "prompt", model, "raw", "string").withColumn("first_description", text.without_repeats(text.cleaned(F.col("raw"))))
    first = kept(providers.apply(first.withColumnRenamed("error", "first_error"), "first_description", embedder, "text_vec", "array<double>").drop("error", "raw", "prompt"))
    queries = first.select(F.col("request_id").alias("query_id"), nothing.alias("image_hash"), F.col("first_description").alias("description"), F.lit(None).cast("array<double>").alias("image_vec"), "text_vec")
    hits = retrieval.cascade(queries, cases, k).join(stored, F.col("entry_id") == F.col("reference"))
    found = hits.groupBy("query_id").agg(
        F.min_by(F.struct("reference", "stored", "match_type"), "rank").alias("best"), F.flatten(F.collect_list(F.coalesce("correct_processes", text.texts([])))).alias("priors")
    )
    second = first.join(found, F.col("request_id") == F.col("query_id"), "left")
    again = F.when(F.col("best").isNotNull(), prompted(F.col("effective"), retrieval.anchors(F.col("anchors"), text.texts([]), retrieval.priors(F.col("best.stored"))), guide, F.col("best.stored")))
    second = providers.apply(second.withColumn("prompt", again), "prompt", model, "raw", "string")
    described = second.withColumn("description", F.coalesce(text.without_repeats(text.cleaned(F.col("raw"))), "first_description"))
    described = kept(described.select("request_id", "description", "first_description", "effective", "best", "priors", F.coalesce("first_error", "error").alias("error")))
    inferred = rules.infer(described, catalogue, ["request_id"], notes="effective").groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "process_id", "confidence"))), lambda p: F.struct(p["process_id"].alias("process_id"), p["confidence"].alias("confidence"))).alias("inferences")
    )
    done = described.join(inferred, "request_id", "left")
    described_at_all = F.coalesce("description", F.lit("")) != ""
    warned = F.when(described_at_all, text.issues(F.col("description"))).otherwise(text.texts([]))
    fresh = done.select(
        "request_id", "description", "first_description", F.col("best.match_type").alias("match_type"), F.col("best.reference").cast("string").alias("reference"),
        F.when(described_at_all, F.coalesce("inferences", none)).otherwise(none).alias("inferences"), F.when(described_at_all, text.selections(F.col("description"))).otherwise(chosen).alias("selections"), warned.alias("warnings"), "error",
    )
    return cached.unionByName(fresh)
