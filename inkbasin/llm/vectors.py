"""Rows of vectors for the searches: which take part, and as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbasin.llm.common import row_keys


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (array of double), _rid of the rows that can be compared.

    Left out: null vectors, those holding null or non-finite components, zero vectors unless `zero`, and vectors of
    another length than most have (the shorter length, if two are as common), as no distance to the others exists.
    """
    v = F.col("embedding").cast("array<double>")
    rows = rows.select("vec_id", v.alias("v")).filter(F.size("v") > 0).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    lengths = sorted(((-r[1], r[0]) for r in rows.groupBy(F.size("v")).count().collect()))
    if len(lengths) > 1:
        rows = rows.filter(F.size("v") == lengths[0][1])
    return row_keys(rows, "vec_id", "v")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)
