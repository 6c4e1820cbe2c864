"""corpusloom: Spark-native analytics over source-code and documentation corpora.

Every operator is ``DataFrame(s) + parameters -> DataFrame`` and every table carries a ``repo`` key, so one
plan serves one repository or a million of them.
"""

__version__ = "0.1.0"
