"""Streams: usage counts, commit activity, staleness on change, and a response cache with expiry.

State always expires: every stateful job has an event-time watermark. Checkpoints go where the caller says,
which on a cluster is the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import sections as SE
from corpusloom.operators import snapshots as SN
from corpusloom.operators.filters import consented
from corpusloom.operators.paths import known_paths


def telemetry_counts_stream(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events per command and tumbling window; consent is checked before anything is counted."""
    counted = consented(events).withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "command").agg(
        F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "command", "n")


def activity_30d_stream(commits: DataFrame, window: str = "30 days", slide: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Commits per repo in a sliding window."""
    counted = commits.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w"), "repo").agg(
        F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "repo", "n")


def activity_days_stream(commits: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Commits per repo and finished day, for append mode: a day leaves the state once the watermark has passed it."""
    counted = commits.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "repo").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), "repo", "n")


def trailing_activity(days: DataFrame, span_days: int = 30) -> DataFrame:
    """(repo, day, n): commits of the ``span_days`` days up to each day that has any, by a range frame over daily counts."""
    number = F.unix_date(F.to_date("day"))
    frame = W.partitionBy("repo").orderBy(number).rangeBetween(1 - span_days, 0)
    return days.select("repo", "day", F.sum("n").over(frame).alias("n"))


#: Keys of the response cache share the state of a bucket, so that one call of the Python step serves many keys.
CACHE_BUCKETS = 4096


def response_cache_stream(responses: DataFrame, ttl_seconds: int = 3600, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """Responses (repo, key, ts) that had to be fetched: the first per key, then the first once the stored one is too old.

    Keys are dealt into ``buckets`` by their hash. The state of a bucket is its keys with the times of their stored
    responses; a key leaves it once the watermark has passed the end of its stored response, and rows older than the watermark
    are dropped before, so such a key would be fetched anyway. Only the key columns and the time enter the Python step, and
    a call holds the rows that one batch has for one bucket. Rows without a time are left out.
    """
    ttl = ttl_seconds * 1_000_000

    def fetch(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = pd.DataFrame(dict(zip(["repo", "key", "us"], state.get, strict=True))) if state.exists else pd.DataFrame({"repo": [], "key": [], "us": []})
        rows = pd.concat([b[["repo", "key", "us"]] for b in batches], ignore_index=True).sort_values("us", kind="stable", ignore_index=True)
        both = pd.concat([kept.astype({"us": "int64"}), rows.astype({"us": "int64"})], ignore_index=True)
        codes = both.groupby(["repo", "key"], sort=False, dropna=False).ngroup().to_numpy()
        stored = dict(zip(codes[: len(kept)].tolist(), kept["us"].tolist(), strict=True))
        fetched = np.zeros(len(rows), dtype=bool)
        for k, (code, us) in enumerate(zip(codes[len(kept) :].tolist(), rows["us"].tolist(), strict=True)):
            last = stored.get(code)
            if last is None or us - last > ttl:
                stored[code] = us
                fetched[k] = True
        names = both.iloc[np.unique(codes, return_index=True)[1]]
        names = [[None if pd.isna(x) else x for x in names[c]] for c in ("repo", "key")]
        passed = state.getCurrentWatermarkMs() * 1000
        live = [code for code, us in stored.items() if us + ttl >= passed]
        if live:
            state.update(([names[0][c] for c in live], [names[1][c] for c in live], [stored[c] for c in live]))
            state.setTimeoutTimestamp(max((max(stored[c] for c in live) + ttl) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield rows[fetched]

    narrow = responses.withWatermark("ts", f"{ttl_seconds} seconds").select("repo", "key", "ts", F.unix_micros("ts").alias("us"))
    dealt = narrow.filter("us IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("repo", "key"), F.lit(buckets)))
    fetched = dealt.groupBy("bucket").applyInPandasWithState(
        fetch, "repo string, key string, us bigint", "repos array<string>, keys array<string>, stored array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return fetched.select("repo", "key", F.timestamp_micros("us").alias("ts"))


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append finished rows to a parquet table, exactly once, until the input available now is used up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start()


def start_complete(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace the whole result on every batch (small aggregate results only); written by executors."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def staleness_batch(
    docs: DataFrame,
    read_files: Callable[[], DataFrame],
    read_baseline: Callable[[], DataFrame],
    status_path: str,
    baseline_path: str,
):
    """``foreachBatch`` body: check the sections that cite a changed file, write their status, then the new baseline.

    A section is touched when a changed file is one of its references or lies below a referenced directory.
    Output is keyed by the batch number and replaces its own partition, and a batch only reads baselines of batches
    before it, so a repeated batch finds and writes the same.
    """
    keys = ["repo", "doc", "section", "section_ord"]

    def replace(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    def check(changes: DataFrame, batch_id: int) -> None:
        repos = changes.select("repo").distinct()
        sections = SE.parse_sections(docs.join(repos, "repo", "left_semi"))
        refs = SE.section_refs(sections)
        touched = refs.join(known_paths(changes), ["repo", "path"], "left_semi").select(*keys).distinct()
        refs = refs.join(touched, keys, "left_semi")
        files = read_files().join(repos, "repo", "left_semi")
        baseline = read_baseline()
        if "batch_id" in baseline.columns:
            baseline = baseline.filter(F.col("batch_id").isNull() | (F.col("batch_id") < batch_id))
        states = SN.ref_changes(refs, SN.path_hashes(files, refs), baseline)
        status = SE.section_status(states, baseline.select("repo"))
        numbered = F.lit(batch_id).cast("bigint").alias("batch_id")
        replace(status.select("repo", "doc", "section", "status", "n_refs", "n_changed", numbered), status_path)
        replace(SN.baseline_rows(refs, files, F.current_timestamp()).select("*", numbered), baseline_path)

    return check


def staleness_stream(
    changes: DataFrame,
    docs: DataFrame,
    read_files: Callable[[], DataFrame],
    read_baseline: Callable[[], DataFrame],
    status_path: str,
    baseline_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Check documentation whenever files change: only sections that cite a changed file are looked at."""
    body = staleness_batch(docs, read_files, read_baseline, status_path, baseline_path)
    return changes.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
