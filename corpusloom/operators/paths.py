"""Which paths exist: files and the directories above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def known_paths(files: DataFrame) -> DataFrame:
    """Distinct (repo, path) of every file and directory; contents are never read for it."""
    both = F.concat(F.array("path"), T.ancestors(F.col("path")))
    return files.select("repo", F.explode(both).alias("path")).distinct()


def known_dirs(files: DataFrame) -> DataFrame:
    return files.select("repo", F.explode(T.ancestors(F.col("path"))).alias("path")).distinct()
