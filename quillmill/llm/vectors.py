"""What the vector operators share: which vectors take part, and reading them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that are not null, empty or zero and whose components are all finite numbers."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
