"""The place of every row in a global order, without a task that sees all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.session import kept

#: The number of a row within its partition, in an id that counts upwards in each.
WITHIN = (1 << 33) - 1


def numbered(rows: DataFrame, by: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``by``.

    Rows are dealt by ranges whose bounds Spark samples over all of ``by``, sorted there, and numbered as they
    lie; what the ranges before hold is added. So rows that agree in the first columns of ``by``, nulls among them,
    are dealt by the others. Rows that agree in all of it are in one range, in no certain order. The driver
    gets one count a range. ``ranges`` is by default the number of shuffle partitions.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({f"__by_{i}": column for i, column in enumerate(by)})
    names = [f"__by_{i}" for i in range(len(by))]
    lying = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    dealt = kept(lying.withColumn("__at", F.monotonically_increasing_id()))
    range_ = F.shiftrightunsigned("__at", 33).cast("int")
    found = {r["range"]: r["n"] for r in dealt.groupBy(range_.alias("range")).agg(F.count("*").alias("n")).collect()}
    sizes = np.array([found.get(i, 0) for i in range(max(found, default=0) + 1)], np.int64)
    before = F.split(F.lit(",".join(map(str, (np.cumsum(sizes) - sizes).tolist()))), ",").cast("array<bigint>")
    return dealt.withColumn(name, F.element_at(before, range_ + 1) + F.col("__at").bitwiseAND(F.lit(WITHIN)) + 1).drop("__at")
