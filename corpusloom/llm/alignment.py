"""Alignment of two tokenizers' tokens over the same bytes.

Every token points to the farthest-right token of the other kind that overlaps it, and the last token of a component
to itself. Doubling the successors, for all tokens of a batch at once, converges to each component's terminal token,
which labels the group. Links are the pairs of an A and a B token whose byte ranges overlap.

Neither tokenizer makes a token that reaches over the start of a plain word: A splits before a blank that a letter
follows, and B has no piece with a blank behind another character. So texts are cut there, each distinct cut of a
batch is encoded and aligned once, and frequent cuts are remembered; a text without such places is one cut.

How often two ids are linked corpus-wide is counted in two steps, per batch and then by pair of ids. Looking counts
up, the commonest ``COMMON`` pairs go to every task as sorted arrays; the others are joined by a shuffle. Both ways
always run, and every link has its count.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens;
repeated rows count each by itself; a null doc_id stays null; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require, stored
from corpusloom.llm.tokens import BYTE_CHARS, same_merges
from corpusloom.runtime import scratch_path

#: Cuts that each of a worker's two memos holds (about 350 bytes each), their longest length, and characters of text handled at once.
MEMO, MEMO_CHARS, CHARS_AT_ONCE = 250_000, 48, 400_000
#: Pairs of ids whose counts every task gets (13 bytes each).
COMMON = 1 << 20
#: A pair of ids is ``a << B_BITS | b``; 50,257 and 32,000 ids fit 31 bits.
B_BITS = 15

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CUTS = re.compile(rf"(?<=[0-9{LATIN}.,;:!?])(?=[ \n][{LATIN}])")
PLAIN = re.compile(rf"[ \n][0-9{LATIN}.,;:!?]+")


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str):
    """Both tokenizers and the bytes of each id, once for each Python worker."""
    import os

    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(a_path)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    if a.get_vocab_size() >= 1 << (31 - B_BITS) or b.get_piece_size() > 1 << B_BITS:
        raise ValueError("the ids of the two tokenizers don't fit one 31-bit number")
    byte_of = {chr(BYTE_CHARS.get(k, k)): k for k in range(256)}
    a_bytes = [bytes(byte_of.get(c, 0) for c in a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
    b_bytes = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))
    ]
    return a, b, a_bytes, b_bytes, same_merges(a_path)


@lru_cache(maxsize=1)
def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner, and so one bounded memo, for each Python worker."""
    return Aligner(a_path, b_path)


def terminals(a_ends, b_ends):
    """For A and B tokens over the same bytes, given by their ends: the B token in which each token's group ends.

    Ranges of both kinds start where the one before ends; the last ends of both are the same.
    """
    import numpy as np

    n = len(a_ends)
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    to_b = np.searchsorted(b_starts, a_ends, "left") - 1
    to_a = np.searchsorted(a_starts, b_ends, "left") - 1
    own = n + np.arange(len(b_ends))
    step = np.concatenate([n + to_b, np.where(a_ends[to_a] > b_ends, to_a, own)])
    while True:
        further = step[step]
        if (further == step).all():
            break
        step = further
    return step[:n] - n, step[n:] - n


def links(a_ends, b_ends):
    """(A token, B token) of all pairs whose ranges overlap."""
    import numpy as np

    first = np.searchsorted(b_ends, np.append(0, a_ends[:-1]), "right")
    last = np.searchsorted(np.append(0, b_ends[:-1]), a_ends, "left")
    n = last - first
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + first[a]


class Aligner:
    """Aligns cuts. A cut's entry is (n_a, n_b, n_groups, groups as text, linked pairs as bytes), or None without tokens."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        self.a, self.b, self.a_bytes, self.b_bytes, self.fast = tokenizers(a_path, b_path)
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        #: Each id with each sign that may follow it.
        self.shown = [f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]
        self.shown_size = np.array([len(x) for x in self.shown])
        self.a_size, self.b_size = (np.array([len(x) for x in each]) for each in (self.a_bytes, self.b_bytes))

    def encode(self, cuts: list[str]):
        if self.fast:
            a = [self.fast(c) if PLAIN.fullmatch(c) else self.a.encode(c, add_special_tokens=False).ids for c in cuts]
        else:
            a = [x.ids for x in self.a.encode_batch(cuts, add_special_tokens=False)]
        # B puts a blank in front by itself; before a line end, that blank is a piece of its own.
        b = self.b.encode([c[1:] if c[0] == " " else c for c in cuts], num_threads=1)
        return a, [ids if c[0] == " " else ids[1:] for c, ids in zip(cuts, b, strict=True)]

    def as_text(self, a_ids, a_group, b_ids, b_group, ends):
        """The groups of all cuts as ``a,a|b;a|b,b;``, and where in it the first ``ends[k]`` tokens end."""
        import numpy as np

        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        side = np.concatenate([a_group * 2, b_group * 2 + 1])[order]
        last = np.diff(side, append=-1) != 0
        shown = np.concatenate([a_ids, b_ids])[order] * 3 + np.where(last, 1 + side % 2, 0)
        size = np.cumsum(self.shown_size[shown])
        return "".join(map(self.shown.__getitem__, shown.tolist())), size[ends - 1].tolist()

    def align(self, cuts: list[str]) -> dict[str, tuple | None]:
        import numpy as np

        # None of a batch in which a cut doesn't come back byte by byte is trusted: halves are tried until it stands alone.
        a_ids, b_ids = self.encode(cuts)
        data = [c.encode() for c in cuts]
        a_all, b_all = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_size[a_all]), np.cumsum(self.b_size[b_all])
        ends = np.cumsum([len(x) for x in data])
        a_size, b_size = [len(x) for x in a_ids], [len(x) for x in b_ids]
        whole = b"".join(data)
        if not (
            b"".join(map(self.a_bytes.__getitem__, a_all.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, b_all.tolist())) == whole
            and min(a_size) and min(b_size) and (a_ends[np.cumsum(a_size) - 1] == ends).all() and (b_ends[np.cumsum(b_size) - 1] == ends).all()
        ):
            found = dict.fromkeys(cuts)
            if len(cuts) > 1:
                for k in (0, 1):
                    found |= self.align(cuts[k::2])
            return found
        a_group, b_group = terminals(a_ends, b_ends)
        a, b = links(a_ends, b_ends)
        data = (a_all[a] << B_BITS | b_all[b]).astype(np.int32).tobytes()
        b_to = np.cumsum(b_size)
        link_to = np.searchsorted(a, np.cumsum(a_size), "left")
        text, text_to = self.as_text(a_all, a_group, b_all, b_group, np.cumsum(a_size) + np.cumsum(b_size))
        groups = np.flatnonzero(np.diff(b_group, append=-1))
        group_to = np.searchsorted(groups, b_to, "left")
        found, at, at_text, at_group = {}, 0, 0, 0
        for k, cut in enumerate(cuts):
            found[cut] = (a_size[k], b_size[k], int(group_to[k] - at_group), text[at_text : text_to[k] - 1], data[4 * at : 4 * link_to[k]])
            at, at_text, at_group = link_to[k], text_to[k], group_to[k]
        return found

    def documents(self, texts: list[str]):
        """For each text (n_a, n_b, n_groups, n_links, sha256 of the groups, its distinct pairs, their numbers)."""
        import numpy as np

        parted = [CUTS.split(" " + t) if t else [] for t in texts]
        missing = {c for cuts in parted for c in cuts if c not in self.memo}
        # Two generations: what is met again moves on, the rest goes when the younger is full.
        again = [c for c in missing if c in self.older]
        self.memo |= {c: self.older[c] for c in again}
        missing = list(missing.difference(again))
        if missing:
            self.memo |= self.align(missing)
        look = self.memo.__getitem__
        for cuts in parted:
            each = list(map(look, cuts))
            if not each or None in each:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
                continue
            n_a, n_b, n_groups, text, pairs = zip(*each, strict=True)
            pairs = np.frombuffer(b"".join(pairs), dtype=np.int32)
            keys, counts = np.unique(pairs, return_counts=True)
            sha = hashlib.sha256(";".join(text).encode()).hexdigest()
            yield sum(n_a), sum(n_b), sum(n_groups), len(pairs), sha, keys, counts.astype(np.int32)
        for cut in missing:
            if len(cut) > MEMO_CHARS:
                del self.memo[cut]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    spark = docs.sparkSession
    counted = pairs_of_documents(docs, a_path, b_path)
    counts = pair_counts(counted.filter("is_total"))
    common = common_pairs(counts)
    shared = spark.sparkContext.broadcast(common)

    def look_up(batches):
        import numpy as np
        import pyarrow as pa

        keys, n, best, _ = shared.value
        for batch in batches:
            out = []
            for own, times in zip(batch.column("keys"), batch.column("counts"), strict=True):
                own, times = own.values.to_numpy(), times.values.to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                out.append((int((times * best[at])[hit].sum()) if len(keys) else 0, int((times * n[at])[hit].sum()) if len(keys) else 0, own[~hit], times[~hit]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in KEPT], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.list_(pa.int32())), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                names=[*KEPT, "n_best", "count_sum", "rest", "times"],
            )

    schema = "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    looked = counted.filter("NOT is_total").select(*KEPT, "keys", "counts")
    looked = stored(looked.mapInArrow(look_up, f"{schema}, n_best bigint, count_sum bigint, rest array<int>, times array<bigint>"), "aligned")
    rest = looked.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("rid", F.col("e.rest").alias("key"), "e.times")
    rare = rest.join(counts.filter(F.col("n") <= common[3]).select("key", "n", "best"), "key")
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return looked.join(rare, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256"
    )


KEPT = ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def pairs_of_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document with its distinct pairs, and rows (``is_total``) with the sums of many documents."""
    spark = docs.sparkSession

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = worker_aligner(a_path, b_path)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for some in slices(texts):
                each = list(aligner.documents([t or "" for t in texts[some]]))
                rows = [(False, rid + k, i, *e) for k, (i, e) in enumerate(zip(ids[some], each, strict=True))]
                rid += len(rows)
                keys, inverse = np.unique(np.concatenate([e[5] for e in each]), return_inverse=True)
                total = np.bincount(inverse, weights=np.concatenate([e[6] for e in each]), minlength=len(keys))
                rows.append((True, None, None, 0, 0, 0, 0, "", keys, total.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)

    import pyarrow as pa

    fields = pa.schema(
        [("is_total", pa.bool_()), ("rid", pa.int64()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("keys", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    )
    schema = (
        "is_total boolean, rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "keys array<int>, counts array<int>"
    )
    path = scratch_path(spark, "pairs")
    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    rows.mapInArrow(encode, schema).write.partitionBy("is_total").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(texts: list[str | None]):
    """Neighbouring texts of together about ``CHARS_AT_ONCE`` characters."""
    a = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARS_AT_ONCE or k == len(texts) - 1:
            yield slice(a, k + 1)
            a, size = k + 1, 0


def pair_counts(totals: DataFrame) -> DataFrame:
    """(key, n, best): links of each pair of ids, and whether no other pair of its B id has more. There are at most
    as many B ids as the vocabulary has, so their maxima go to every task."""
    each = totals.select(F.explode(F.arrays_zip("keys", "counts")).alias("e")).groupBy(F.col("e.keys").alias("key")).agg(F.sum("e.counts").alias("n"))
    each = stored(each, "pair-counts")
    b = F.col("key").bitwiseAND((1 << B_BITS) - 1)
    most = each.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stored(each.withColumn("b", b).join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def common_pairs(counts: DataFrame):
    """(keys ascending, their counts, best, bound) of the pairs linked more than ``bound`` times; about ``COMMON`` at most."""
    import numpy as np

    n = counts.count()
    bound = 0
    if n > COMMON:
        bound = counts.agg(F.percentile_approx("n", F.lit(1.0 - COMMON / n), F.lit(100_000))).first()[0]
    some = counts.filter(F.col("n") > bound).toPandas().sort_values("key")
    return some["key"].to_numpy(np.int32), some["n"].to_numpy(np.int64), some["best"].to_numpy(bool), bound
