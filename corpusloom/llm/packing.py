"""Packing into fixed windows by minimum bin slack over the histogram of lengths.

Documents are cut at multiples of the window, so that all pieces but each document's last fill a window. What is
left is a multiset of lengths below the window size: at most that many distinct values, however large the corpus,
and so small enough to plan in one place. For the longest piece left, a subset-sum over bitsets finds the
multiset of other lengths that fills the window closest; it is repeated while its lengths last. The plan is a
table of rank ranges per length, which the pieces join by their rank among the pieces of their length.

Defined cases: null text is empty (its end id alone is a piece); rows that share a doc_id are packed each; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import partitions, require
from corpusloom.llm.tokens import Encoder

ROWS_AT_ONCE = 256


def cut_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, words: bool = True) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids, ended by ``end_id``, in pieces of a window at
    most; ``ids`` are little-endian unsigned 32-bit integers."""

    def cut(batches):
        import pyarrow as pa

        enc = Encoder(tokenizer, words)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = enc.ids(text.as_py() or "") + end
                    n = len(ids) // 4
                    rows += [(doc_id, a, min(window, n - a), ids[4 * a : 4 * (a + window)], n) for a in range(0, n, window)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of ``counts`` (length: copies) whose sum is closest below or at ``room``.

    Bit s of ``reached`` says that some multiset sums to s. Copies are taken in chunks of 1, 2, 4, ...; the bitset
    before each chunk is kept, and the way back through them gives the copies used.
    """
    full, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            steps.append((length, chunk, reached))
            reached |= (reached << (length * chunk)) & full
            left, chunk = left - chunk, chunk * 2
        if reached >> room & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + chunk
            at -= length * chunk
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, length: pieces) of each way to fill a window, until no length is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        used = fullest(left | {longest: left[longest] - 1}, window - longest)
        used[longest] = used.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in used.items())
        out.append((copies, used))
        for k, n in used.items():
            left[k] -= n * copies
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces that have doc_id, start and length (1 to ``window``).

    The histogram has ``window`` rows at most and the plan a few for each of them, whatever the input: those are the
    only things collected or broadcast. Ranks come from (length, hash bucket) groups and the counts of the buckets
    before, so a length that a third of all pieces share is not ranked in one task.
    """
    spark = pieces.sparkSession
    n = partitions(spark)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, done, first = [], dict.fromkeys(counts, 0), 0
    for copies, used in plan(counts, window):
        at = 0
        for length, each in sorted(used.items(), reverse=True):
            slots.append((length, done[length], done[length] + copies * each, each, first, at))
            done[length] += copies * each
            at += length * each
        first += copies
    slots_df = F.broadcast(spark.createDataFrame(slots, "length bigint, lo bigint, hi bigint, each bigint, first bigint, at bigint"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "start", *[c for c in ("ids_crc32", "doc_tokens") if c in pieces.columns])
    ranked = dealt.join(bases, ["length", "_bucket"]).withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_base"))
    hit = ranked.join(slots_df, "length").filter("_rank >= lo and _rank < hi")
    nth = F.col("_rank") - F.col("lo")
    return hit.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("first") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )
