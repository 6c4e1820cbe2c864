"""Native column functions. None of them uses a Python UDF."""
