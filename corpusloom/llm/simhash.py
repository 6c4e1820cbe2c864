"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a word of the binary Golay code
(23 bits, 4096 codewords, every word within 3 bits of exactly one). A segment's keys are the indices of the codewords
that the words up to one bit away decode to: one to six. Two words up to two bits apart have a word halfway that is
up to one bit from each, so they share a key. If fingerprints differ in up to four bits, some two of the three
segments differ in up to two bits together; so they share a key pair there. Fingerprints with the same
pair are compared in full.

Defined cases: null or wordless text has fingerprint 0 and links like any other; a text shorter than a shingle is
one shingle; rows that share a doc_id get a row each; a null doc_id counts for no component's smallest id (a
component of such rows alone has null); an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import components, local_components, partitions, popcount64, stored

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
#: Rows of one key that are compared in one go; more are compared block by block, in tasks of two blocks each.
BLOCK = 2048
ROWS_AT_ONCE = 256
UPPER = bytes(range(65, 91))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash over the XXH64 values of all shingles of words: a bit is set if it is in over half of them."""
    import numpy as np
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    values = np.array(
        [digest(joined[a:b], SEED) for a, b in zip((ends - size).tolist(), ends[k - 1 :].tolist(), strict=False)], dtype="<u8"
    )
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view("<u8")[0])


LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprints(docs: DataFrame, shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed 64-bit integer. Columns to ``keep`` come along in
    the struct ``others``."""
    extra = ["others"] if keep else []

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                values = [fingerprint(t.as_py(), shingle) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(values, dtype="<u8").view("<i8")), *[part.column(c) for c in extra]], names=["doc_id", "fp", *extra]
                )

    others = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("others")] if keep else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), *others)
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]
    return rows.mapInArrow(run, T.StructType(kinds + [rows.schema[c] for c in extra]))


@lru_cache(maxsize=1)
def nearest_codeword():
    """For each 23-bit word the index of its codeword. The code: multiples of x^11+x^9+x^7+x^6+x^5+x+1 over GF(2);
    the words within 3 bits of the 4096 codewords are all words, each once."""
    from itertools import combinations

    import numpy as np

    words = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        words[(np.arange(4096) >> bit & 1) == 1] ^= 0b101011100011 << bit
    errors = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
    found = np.full(1 << 23, -1, dtype=np.int16)
    for error in errors:
        found[words ^ error] = np.arange(4096)
    return found


def segment_keys(fps, first: int, width: int):
    """Codeword indices of each fingerprint's segment: distinct ones first, then -1; six columns."""
    import numpy as np

    word = (fps >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    near = np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(width))], axis=1)
    keys = np.sort(nearest_codeword()[near].astype(np.int32), axis=1)
    new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    out = np.full((len(keys), 6), -1, dtype=np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, col]] = keys[row, col]
    return out


def key_rows(fps):
    """(key, position) of every key pair of every fingerprint."""
    import numpy as np

    keys = [segment_keys(fps, *s) for s in SEGMENTS]
    found = []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        pair = (number << 24 | keys[i][:, :, None] << 12 | keys[j][:, None, :]).reshape(len(fps), -1)
        fit = ((keys[i] >= 0)[:, :, None] & (keys[j] >= 0)[:, None, :]).reshape(len(fps), -1)
        row, col = np.nonzero(fit)
        found.append((pair[row, col], row))
    return np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])


def stars(fps, a, b):
    """Links as (fingerprint, smallest position's fingerprint of its component): one less than nodes at most."""
    import numpy as np

    label = local_components(len(fps), a, b)
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[far], fps[label[far]]


def near_links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) fingerprints that connect everything the links of up to ``bits`` differing bits connect.

    ``distinct`` has each fingerprint once, as ``fp``. Within a key only a spanning set of the links goes out, never
    all pairs. Keys with more than ``BLOCK`` rows are dealt out in pairs of blocks.
    """

    def keyed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = batch.column("fp").to_numpy().view("<u8")
            for k in range(0, len(values), 2048):
                some = values[k : k + 2048]
                key, row = key_rows(some)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(some[row].view("<i8"))], names=["key", "fp"])

    def out(key, block, a, b):
        import numpy as np
        import pyarrow as pa

        whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int64), len(a)))
        return pa.RecordBatch.from_arrays([whole(key), whole(block), whole(a.view("<i8")), whole(b.view("<i8"))], names=["key", "block", "a", "b"])

    def compare(batches):
        """Rows come sorted by key. Links have block -1; rows of keys that are too large go on with their block."""
        import numpy as np

        def links(key, fps):
            at, found, lag = np.arange(len(key)), [], 0
            while len(at):
                lag += 1
                at = at[at + lag < len(key)]
                at = at[key[at] == key[at + lag]]
                hit = at[popcount64(fps[at] ^ fps[at + lag]) <= bits]
                found.append((hit, hit + lag))
            a, b = (np.concatenate([f[k] for f in found]) if found else at for k in (0, 1))
            nodes, place = np.unique(fps[np.concatenate([a, b])], return_inverse=True)
            return stars(nodes, place[: len(a)], place[len(a) :])

        def finished(key, fps):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            large = np.repeat(size > BLOCK, size)
            yield out(-1, -1, *links(key[~large], fps[~large]))
            if large.any():
                inside = (np.arange(len(key)) - np.repeat(start, size)) // BLOCK
                yield out(key[large], inside[large], fps[large], fps[large])

        rest_key, rest_fp = [], []
        rows = 0
        for batch in batches:
            rest_key.append(batch.column("key").to_numpy())
            rest_fp.append(batch.column("fp").to_numpy().view("<u8"))
            rows += batch.num_rows
            if rows >= 200_000:
                key, fps = np.concatenate(rest_key), np.concatenate(rest_fp)
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from finished(key[:cut], fps[:cut])
                rest_key, rest_fp, rows = [key[cut:]], [fps[cut:]], 0
        if rest_key and sum(map(len, rest_key)):
            yield from finished(np.concatenate(rest_key), np.concatenate(rest_fp))

    def compare_blocks(part):
        import numpy as np
        import pandas as pd

        fps = np.unique(part["fp"].to_numpy().view("<u8"))
        found = []
        for k in range(0, len(fps), 256):
            i, j = np.nonzero(popcount64(fps[k : k + 256, None] ^ fps[None, k:]) <= bits)
            found.append((i + k, j + k))
        a, b = stars(fps, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

    n = partitions(distinct.sparkSession)
    rows = distinct.select("fp").mapInArrow(keyed, "key int, fp bigint").repartition(n, "key").sortWithinPartitions("key")
    found = stored(rows.mapInArrow(compare, "key bigint, block bigint, a bigint, b bigint"), "simhash-links")
    links = found.filter("block < 0").select("a", "b")
    large = found.filter("block >= 0").select("key", "block", F.col("a").alias("fp"))
    counts = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = large.join(counts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    more = dealt.groupBy("key", "i", "j").applyInPandas(lambda part: compare_blocks(part), "a bigint, b bigint")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row: the smallest doc_id reachable over links of up to ``bits`` bits,
    and the smallest fingerprint, which names components of rows without an id too.

    Copies collapse to their fingerprint before any comparison, and links join fingerprints, not documents.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the key pairs find fingerprints that differ in up to 4 bits")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    labels = components(near_links(distinct, bits)).withColumnsRenamed({"node": "fp", "label": "root"})
    rooted = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id", "root")
