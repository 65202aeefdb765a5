"""Vector functions (V1, V2, V6, V7, F17): built-in higher-order functions over array<float>; matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """V1; null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_similarity(a: Column, b: Column) -> Column:
    """V2: 1 / (1 + distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


def drift(message: Column, centroid: Column) -> Column:
    """V6: in 0..1; 0 without a centroid."""
    away = (1 - cosine(message, centroid)) / 2
    return F.when(away.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), away))).otherwise(0.0)  # greatest and least pass over nulls


def drift_score(embedding: Column, entity: Column, explicit: Column) -> Column:
    """V7."""
    e, n, x = S.DRIFT_WEIGHTS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), e * embedding + n * entity.cast("double") + x * explicit.cast("double")))


def centroids(vectors: DataFrame, keys: list[str], least: int = S.COLD_START) -> DataFrame:
    """A5: mean per dimension; null below the cold-start count.  Sums combine map-side per dimension."""
    per = vectors.select(*keys, F.posexplode("embedding").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    got = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("dims"), F.max("n").alias("n"))
    return got.select(*keys, "n", F.when(F.col("n") >= least, F.transform("dims", lambda d: d["m"])).alias("centroid"))


def rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors of an Arrow list column that are *width* long and hold no null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    good = np.flatnonzero((lengths == width) & ~np.asarray(column.is_null()))
    matrix = values[offsets[good][:, None] + np.arange(width)[None, :]] if len(good) else np.empty((0, width))
    finite = np.isfinite(matrix).all(axis=1)
    return good[finite], matrix[finite]
