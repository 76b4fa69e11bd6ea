"""Dimensions in texts of other letters, against the query's SQL."""

import duckdb
from pyspark.sql import functions as F

from casequarry.functions import fixed, text


def test_dimensions_beside_other_letters(spark):
    """As in SQL: digits, blanks and bounds of words are ASCII's, and only Φ has other cases."""
    texts = ["é5 mm", "5 mmé", "5 mé", "٥ mm", "5\u00a0mm", "5\u000bmm", "xΦ 5", " Φ 5", "xφ5", "xϕ 5", "éM6", "M6é", "M６", "5 ınch", "5 İNCH", "_M6", "5 °", "ſT5", "KT5", "T5ſ", "R 2.5", "5m", "5mx", "± 3", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["leaks"] for r in rows.select("i", text.has_dimension(F.col("t")).alias("leaks")).collect()}
    wanted = duckdb.connect().execute("SELECT regexp_matches(unnest($1), '(?i)" + fixed.DIMENSIONS + "')", [texts]).fetchall()
    assert found == {i: w for i, (w,) in enumerate(wanted)}
    assert found[0] and found[6] and not found[3]
