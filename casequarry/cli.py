"""Command line: ``python -m casequarry.cli VERB``.

Verbs work on tables of Parquet: ``run`` a registered query, ``analyse`` requests against a case store,
``symbols`` with one name, ``batch`` report on a table of descriptions, ``ask`` for an answer in key-value
text, ``similar`` cases of a store, ``crop`` label boxes, ``shadow`` record or sum up evaluations. Results go to
standard output as JSON lines, what went wrong to standard error.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casequarry.functions import text
from casequarry.operators import analysis, boxes, evaluate, reports
from casequarry.service import CaseStore
from casequarry.session import local_session, setting
from casequarry.sources import tables


def _show(df) -> None:
    for row in df.toLocalIterator():
        line = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n"
        sys.stdout.write(line.encode(sys.stdout.encoding or "utf-8", "replace").decode(sys.stdout.encoding or "utf-8"))


def run(spark, args) -> None:
    from casequarry.registry import QUERIES

    _show(QUERIES[args.query](spark, args.folder))


def batch(spark, args) -> None:
    rows = spark.read.parquet(args.table)
    checked = rows.withColumn("errors", text.issues(F.col(args.column)))
    if args.output:
        checked.write.mode("overwrite").json(args.output)
    _show(reports.batch_report(checked))


def _provider(path: str):
    """A provider's factory by its place, ``module:name``, called if it makes one."""
    module, _, name = path.partition(":")
    made = getattr(importlib.import_module(module), name)
    return made() if getattr(made, "__name__", "").startswith("stand_in") else made


def analyse(spark, args) -> None:
    box = CaseStore(spark, args.store, _provider(args.embedder))
    catalogue = tables.rule_catalogue(spark, args.rules) if args.rules else ()
    requests = analysis.request(spark.read.parquet(args.table)) if args.locked else spark.read.parquet(args.table)
    _show(box.analyse(requests, catalogue, _provider(args.model), tables.guide(spark, args.guide) if args.guide else ""))


def symbols(spark, args) -> None:
    found = spark.read.parquet(args.table)
    _show(reports.named_symbol(found, args.name) if args.name else analysis.confirmed_symbols(found.select(args.key, F.explode("symbols.name").alias("name")), args.key))


def similar(spark, args) -> None:
    _show(CaseStore(spark, args.store, _provider(args.embedder)).similar(spark.read.parquet(args.table), args.k))


def ask(spark, args) -> None:
    _show(spark.read.text(args.file, wholetext=True).select(text.answer(F.col("value")).alias("a")).select("a.*"))


def crop(spark, args) -> None:
    _show(boxes.named_views(boxes.labelled_views(spark.read.parquet(args.table), args.drawing), args.drawing))


def shadow(spark, args) -> None:
    if args.record:
        found = evaluate.differences(spark.read.parquet(args.record))
        found.write.mode("append").parquet(args.log)
        _show(found)
    if args.stats:
        log = spark.read.parquet(args.log)
        _show(evaluate.rates(log))
        for column in ("missing", "wrong"):
            _show(evaluate.listing(evaluate.most_common(log, column)).withColumnRenamed("listed", f"most_{column}"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="casequarry", description=__doc__)
    parser.add_argument("--cores", default="*")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verb = verbs.add_parser("run")
    verb.add_argument("query")
    verb.add_argument("folder")
    verb = verbs.add_parser("analyse")
    verb.add_argument("store")
    verb.add_argument("table")
    verb.add_argument("--rules")
    verb.add_argument("--guide")
    verb.add_argument("--locked", action="store_true", help="notes come from locked_notes, else typed_notes")
    verb.add_argument("--model", default=setting("model", "casequarry.operators.providers:stand_in_model"))
    verb.add_argument("--embedder", default=setting("embedder", "casequarry.operators.providers:stand_in_embedder"))
    verb = verbs.add_parser("symbols")
    verb.add_argument("table")
    verb.add_argument("--name")
    verb.add_argument("--key", default="drawing")
    verb = verbs.add_parser("similar")
    verb.add_argument("store")
    verb.add_argument("table")
    verb.add_argument("-k", type=int, default=3)
    verb.add_argument("--embedder", default=setting("embedder", "casequarry.operators.providers:stand_in_embedder"))
    verb = verbs.add_parser("batch")
    verb.add_argument("table")
    verb.add_argument("--column", default="description")
    verb.add_argument("--output")
    verb = verbs.add_parser("ask")
    verb.add_argument("file")
    verb = verbs.add_parser("crop")
    verb.add_argument("table")
    verb.add_argument("--drawing", default="drawing")
    verb = verbs.add_parser("shadow")
    verb.add_argument("log")
    verb.add_argument("--record")
    verb.add_argument("--stats", action="store_true")
    args = parser.parse_args(argv)
    verb_of = {"run": run, "analyse": analyse, "symbols": symbols, "similar": similar, "batch": batch, "ask": ask, "crop": crop, "shadow": shadow}
    try:
        verb_of[args.verb](local_session(args.cores), args)
    except (ValueError, KeyError, PySparkException) as error:
        sys.stderr.write(f"casequarry {args.verb}: {str(error).splitlines()[0]}\n")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
