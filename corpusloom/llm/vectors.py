"""What the two vector operators share: which rows take part, and vectors that occur more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import require


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and a finite vector that isn't zero, of the length that most rows have."""
    rows = require(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def matrix(column):
    """The vectors of a pandas column as rows of doubles."""
    import numpy as np

    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def unit(rows):
    """Rows scaled to length 1; first by their largest component, so that no square over- or underflows."""
    import numpy as np

    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``n`` smallest vec_ids, ascending; cut to n per task before shuffling."""
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return rows.distinct().withColumn("_n", nth).filter(F.col("_n") <= n).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
