"""Removal of word passages that an earlier document has, by prefix-partitioned suffix trees.

Suffixes are the words of a document from each position on, as deep as the window asks (deeper branches change nothing of
which words go). The tree over them is never built whole: prefixes of varying length, sized by a bounded sample, split
the suffixes into groups that fit in memory. A prefix that begins too many suffixes goes on to its next word; where it
can't, because all words of the window are the same, the group is split by document. Each group's suffixes are sorted,
which is the order of its subtree's leaves: an internal node of window depth is a run of leaves that share all words,
and its smallest document is the run's first. Nodes of a group that is split by document are joined by their words.

Most windows are unique, and sending them all would cost many times the input. So suffixes are sent only where a
repeat is possible: equal windows have the same minimizer (the run of some of their words with the least hash), so a window can only be repeated if its minimizer is one in more than one document too. That filter never loses a
repeat; what it lets through by chance, the trees reject, as they compare words.

Exact copies of a text need no tree: all their windows start in the document with the smallest id.

Defined cases: null text has no words; texts shorter than a window keep all words; rows that share a doc_id are
one document for each other (never smaller) but are cut each; rows with a null doc_id come after all others, in
the order of a hash of their texts; an empty table gives no rows; other columns of the input are ignored unless asked
for.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import partitions, stored

WINDOW = 13
#: A window has so many runs of words, the least of which is its minimizer: more are fewer to send, but unsurer.
RUNS = 6
#: Anchors that a task looks at together before it sends them.
ANCHORS_AT_ONCE = 500_000
ROWS_AT_ONCE = 256
#: Null doc_ids are numbered downwards from here.
LAST_ID = (1 << 63) - 1
POSITION_BITS = 40
#: Groups per partition, and what their prefixes are sized by: so many documents, and suffixes of them, at most about.
GROUPS, SAMPLE_DOCS, SAMPLE = 8, 1000, 65_536
POSITION = (1 << POSITION_BITS) - 1


class WordHash:
    """64-bit hashes of the words of a text, all at once: a polynomial over random values of the bytes."""

    def __init__(self):
        import numpy as np

        draw = np.random.default_rng(20_24)
        self.values = draw.integers(1, 1 << 64, 256, dtype=np.uint64)
        self.mixers = draw.integers(1, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
        self.base, self.size = 0x9E3779B97F4A7C15, 0
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.grow(1 << 16)

    def grow(self, size: int) -> None:
        import numpy as np

        if size > self.size:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
            self.size = size

    def words(self, data: bytes):
        """(starts, ends) of the words in bytes."""
        import numpy as np

        gap = np.concatenate([[True], self.space[np.frombuffer(data, dtype=np.uint8)], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        return edge[::2], edge[1::2]

    def hashes(self, data: bytes, starts, ends):
        import numpy as np

        self.grow(len(data) + 1)
        terms = self.values[np.frombuffer(data, dtype=np.uint8)] * self.up[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out = (sums[ends] - sums[starts]) * self.down[starts]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))

    def minimizers(self, words, window: int):
        """(hash of the run at each position, position of the minimizer of each window)."""
        import numpy as np

        length = max(1, window - RUNS + 1)
        n = len(words) - length + 1
        runs = np.zeros(n, np.uint64)
        for k in range(length):
            runs += (words[k : k + n] ^ (words[k : k + n] >> np.uint64(k % 61 + 1))) * self.mixers[k % 64]
        runs ^= runs >> np.uint64(31)
        runs *= np.uint64(0x9FB21C651E98DF25)
        runs ^= runs >> np.uint64(30)
        reach = window - length + 1
        return runs, np.arange(n - reach + 1) + np.lib.stride_tricks.sliding_window_view(runs, reach).argmin(axis=1)


def _hasher():
    global _HASHER
    if _HASHER is None:
        _HASHER = WordHash()
    return _HASHER


_HASHER: WordHash | None = None


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, doc, text) and the columns to keep as one; ``doc`` numbers null ids too."""
    last = F.lit(LAST_ID) - F.xxhash64("text").bitwiseAND(0xFFFFFFFF)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), last).alias("doc"),
        F.col("text").cast("binary").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("others")] if keep else []),
    )


def tag_of(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.coalesce(F.crc32(text), F.lit(0))


def repeated_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(doc, position) of minimizers whose run of words is a minimizer in more than one document; later copies of a
    whole text don't count.

    A task first looks among its own anchors: those found in two documents there are settled and travel under a key of
    their own, with one mark for the rest. So no run, however frequent, sends more rows to one key than there are tasks.
    """

    def send(batches):
        import numpy as np
        import pyarrow as pa

        hasher, held, count = _hasher(), [], 0

        def combined():
            h, doc, ref = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, h))
            h, doc, ref = h[order], doc[order], ref[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(start, len(h)))
            settled = np.repeat(doc[start] != doc[start + size - 1], size)
            marks = start[doc[start] != doc[start + size - 1]]
            key = np.where(settled, (doc.astype(np.uint64) + ref.astype(np.uint64)) * np.uint64(hasher.base), h)
            ref = ref | (settled.astype(np.int64) << POSITION_BITS + 1)
            for k, d, r in ((key, doc, ref), (h[marks], doc[marks], np.full(len(marks), POSITION + 1))):
                for a in range(0, len(k), 50_000):
                    s = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(k[s].view(np.int64)), pa.array(d[s]), pa.array(r[s])], names=["key", "doc", "ref"])

        for batch in batches:
            for doc, text, copies, tags in zip(batch.column("doc").to_pylist(), *(batch.column(c) for c in ("text", "copies", "tags")), strict=True):
                data = text.as_py() or b""
                starts, ends = hasher.words(data)
                if len(starts) < window or place(data, copies, tags)[0]:
                    continue
                runs, least = hasher.minimizers(hasher.hashes(data, starts, ends), window)
                at = least[np.concatenate([[True], least[1:] != least[:-1]])]
                held.append((runs[at], np.full(len(at), doc, np.int64), at.astype(np.int64)))
                count += len(at)
                if count >= ANCHORS_AT_ONCE:
                    yield from combined()
                    held, count = [], 0
        if held:
            yield from combined()

    def receive(batches):
        """Rows come sorted by key. A run of one key is repeated if it has two documents or a mark."""
        import numpy as np
        import pyarrow as pa

        def given(out, doc, ref):
            return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array((ref[out] & POSITION).astype(np.int32))], names=["doc", "position"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("key", "doc", "ref")]
            key, doc, ref = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            kind = ref >> POSITION_BITS  # 0: open, 1: a mark, 2: settled
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) | np.logical_or.reduceat(kind == 1, start)
            size = np.diff(np.append(start, len(key)))
            out = (np.repeat(several, size) & (kind == 0)) | (kind == 2)
            if several[-1]:  # the run may go on: a mark stands for it
                rest = key[-1:], doc[-1:], np.full(1, POSITION + 1)
            else:
                rest = [x[start[-1] :][kind[start[-1] :] == 0] for x in (key, doc, ref)]
                rest = rest if len(rest[0]) else None
            yield given(out, doc, ref)

    sent = rows.select("doc", "text", "copies", "tags").mapInArrow(send, "key bigint, doc bigint, ref bigint")
    dealt = sent.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(receive, "doc bigint, position int")


def later_copies(rows: DataFrame) -> DataFrame:
    """(doc, tag) of rows whose whole text a document with a smaller id has."""
    narrow = rows.filter("text is not null").select("doc", tag_of(F.col("text")).alias("tag"), F.sha2("text", 256).alias("sha"))
    first = narrow.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return narrow.join(first, "sha").filter("doc > first").select("doc", "tag")


def hints(rows: DataFrame, window: int) -> DataFrame:
    """What is known of a document before its words are compared: ``positions`` of repeated minimizers, ``copies``
    (tags of texts that are later copies), and ``tags`` in order, where rows share an id."""
    copies = later_copies(rows).groupBy("doc").agg(F.collect_set("tag").alias("copies"))
    tags = rows.select("doc", tag_of(F.col("text")).alias("tag")).groupBy("doc").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    known = stored(copies.join(tags.filter(F.size("tags") > 1), "doc", "full"), "text-copies")
    anchors = repeated_anchors(rows.drop("others").join(known, "doc", "left"), window)
    return anchors.groupBy("doc").agg(F.collect_set("position").alias("positions")).join(known, "doc", "full")


def place(text: bytes, copies, tags) -> tuple[bool, int]:
    """Whether a row's text is a later copy, and the number of its text among those under its id."""
    if not copies.is_valid and not tags.is_valid:
        return False, 0
    tag = zlib.crc32(text)
    return copies.is_valid and tag in copies.as_py(), tags.as_py().index(tag) if tags.is_valid else 0


class Prefixes:
    """Groups of suffixes by prefixes of varying length, so that each has about the same share of a sample."""

    def __init__(self, sample: list[bytes], groups: int, window: int):
        self.window = window
        #: prefix: (first group, groups, whether longer prefixes follow)
        self.nodes: dict[bytes, tuple[int, int, bool]] = {}
        #: Groups of suffixes that share all words, dealt out by document.
        self.split: set[int] = set()
        self.groups = 0
        self.limit = max(1, len(sample) // groups)
        self.add((), sorted(tuple(s.split(b" ")) for s in sample), max(1, groups // 4))

    def add(self, prefix: tuple[bytes, ...], suffixes: list[tuple[bytes, ...]], least: int = 1) -> None:
        depth = len(prefix)
        inner = depth < self.window and (len(suffixes) > self.limit or not depth)
        children: dict[bytes, list] = {}
        if inner:
            for s in suffixes:
                children.setdefault(s[depth], []).append(s)
            children = {w: some for w, some in children.items() if 4 * len(some) > self.limit}
        rest = len(suffixes) - sum(map(len, children.values()))
        # What follows no longer prefix is dealt out by its next word, a full window by its document; the latter only
        # from half a partition's share on, since each part leaves rows to be joined.
        n = max(least, -(-rest // self.limit)) if inner else -(-rest // (GROUPS // 2 * self.limit)) if depth == self.window else 1
        self.nodes[b" ".join(prefix)] = (self.groups, n, inner)
        if depth == self.window and n > 1:
            self.split.update(range(self.groups, self.groups + n))
        self.groups += n
        for word, some in children.items():
            self.add((*prefix, word), some)

    def group(self, joined: bytes, begin: list[int], at: int, doc: int) -> int:
        """The group of the suffix at a position; ``begin`` has the starts of words in ``joined``."""
        first, n, inner = self.nodes[b""]
        a, depth = begin[at], 0
        while inner:
            end = begin[at + depth + 1] - 1
            node = self.nodes.get(joined[a:end])
            if node is None:
                return first + zlib.crc32(joined[begin[at + depth] : end]) % n
            first, n, inner = node
            depth += 1
        return first + (doc * 0x9E3779B1 >> 7) % n if n > 1 else first


def suffixes(texts: DataFrame, window: int, prefixes: Prefixes | None = None) -> DataFrame:
    """(part, words, doc, ref) of the suffixes that may be repeated, with their group; ``ref`` is the position with the
    text's number above."""

    def send(batches):
        import numpy as np
        import pyarrow as pa

        hasher = _hasher()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                words, docs, refs, groups = [], [], [], []
                for doc, text, hits, copies, tags in zip(*(part.column(c) for c in ("doc", "text", "positions", "copies", "tags")), strict=True):
                    data, hits, own = text.as_py(), hits.values.to_numpy(), doc.as_py()
                    starts, ends = hasher.words(data)
                    is_copy, number = place(data, copies, tags)
                    if is_copy or len(starts) < window:
                        continue
                    _, least = hasher.minimizers(hasher.hashes(data, starts, ends), window)
                    shared = np.zeros(len(starts), bool)
                    shared[hits[hits < len(starts)]] = True
                    at = np.flatnonzero(shared[least])
                    if len(at):
                        joined = b" ".join(data.split())
                        begin = np.concatenate([[0], np.cumsum(ends - starts + 1)]).tolist()
                        places = at.tolist()
                        words += [joined[begin[i] : begin[i + window] - 1] for i in places]
                        groups += [prefixes.group(joined, begin, i, own) for i in places] if prefixes else [0] * len(places)
                        docs.append(np.full(len(at), own, np.int64))
                        refs.append((number << POSITION_BITS) | at)
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(groups, pa.int32()), pa.array(words, pa.binary()), pa.array(np.concatenate(docs)), pa.array(np.concatenate(refs))],
                        names=["part", "words", "doc", "ref"],
                    )

    picked = texts.filter("positions is not null and text is not null")
    return picked.select("doc", "text", "positions", "copies", "tags").mapInArrow(send, "part int, words binary, doc bigint, ref bigint")


def sized_prefixes(rows: DataFrame, known: DataFrame, window: int) -> Prefixes:
    """Prefixes sized by the suffixes of a bounded sample of documents. The groups they make differ in size from sample
    to sample; what is found in them doesn't."""
    every = max(1, rows.count() // SAMPLE_DOCS)
    some = rows.drop("others").filter(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).join(known, "doc")
    drawn = suffixes(some, window).filter(F.pmod(F.xxhash64("words", "doc", "ref"), F.lit(8)) == 0).select("words").limit(SAMPLE)
    return Prefixes([bytes(r["words"]) for r in drawn.collect()], GROUPS * partitions(rows.sparkSession), window)


def repeats(sent: DataFrame, split: set[int]) -> DataFrame:
    """(doc, ref) of the suffixes below an internal node of window depth that has a smaller document.

    The leaves of a group's subtree come in order, by words and document, so the first of a node's leaves has its
    smallest document. In groups that are split by document, that one may still be a later one of another part's:
    its leaves are joined with the other parts' by their words.
    """
    split_groups = sorted(split)

    def nodes(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last = None  # group, words and smallest document of the node that goes on

        def rows(words, doc, ref):
            return pa.RecordBatch.from_arrays([words, pa.array(doc), pa.array(ref)], names=["words", "doc", "ref"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, words, doc, ref = batch.column("part").to_numpy(), batch.column("words"), batch.column("doc").to_numpy(), batch.column("ref").to_numpy()
            new = np.ones(len(doc), bool)
            new[1:] = (part[1:] != part[:-1]) | pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or (int(part[0]), words[0].as_py()) != last[:2]
            low = np.concatenate([[last[2] if last else 0], doc[np.flatnonzero(new)]])[np.cumsum(new)]
            later = doc > low
            if later.any():
                yield rows(pa.nulls(int(later.sum()), pa.binary()), doc[later], ref[later])
            open_ = np.flatnonzero(~later & np.isin(part, split_groups)) if split_groups else []
            if len(open_):
                yield rows(words.take(pa.array(open_)), doc[open_], ref[open_])
            last = int(part[-1]), words[len(words) - 1].as_py(), low[-1]

    groups = sent.repartition(partitions(sent.sparkSession), "part").sortWithinPartitions("part", "words", "doc")
    found = stored(groups.mapInArrow(nodes, "words binary, doc bigint, ref bigint"), "suffix-nodes")
    parts = found.filter("words is not null")
    least = parts.groupBy("words").agg(F.min("doc").alias("least"))
    return found.filter("words is null").select("doc", "ref").unionByName(
        parts.join(least, "words").filter("doc > least").select("doc", "ref")
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, as_written: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``: ``kept`` has the words that no window covers whose
    word sequence also starts in a document with a smaller doc_id, joined by one blank. With ``as_written``, texts
    that lose no word stay as they are. Columns to ``keep`` come along in the struct ``others``."""
    keep = keep or []
    rows = keyed(docs, keep)
    texts = rows.repartition(partitions(rows.sparkSession), "doc")
    known = stored(hints(rows, window), "repeat-hints")
    prefixes = sized_prefixes(rows, known, window)
    later = repeats(suffixes(texts.drop("others").join(known, "doc"), window, prefixes), prefixes.split)
    covered = later.groupBy("doc").agg(F.collect_list("ref").alias("covered"))
    marked = texts.join(known.drop("positions"), "doc", "left").join(covered, "doc", "left")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                total, removed, kept = [], [], []
                for text, refs, copies, tags in zip(*(part.column(c) for c in ("text", "covered", "copies", "tags")), strict=True):
                    data = text.as_py()
                    words = (data or b"").split()
                    gone = np.zeros(len(words) + 1, np.int32)
                    is_copy, number = place(data or b"", copies, tags)
                    if is_copy and len(words) >= window:
                        gone[0] = 1
                    elif refs.is_valid:
                        at = np.unique(refs.values.to_numpy())
                        at = (at & POSITION)[at >> POSITION_BITS == number]
                        gone[at] += 1
                        np.subtract.at(gone, at + window, 1)
                    gone = np.cumsum(gone)[:-1] > 0
                    total.append(len(words))
                    removed.append(int(gone.sum()))
                    if removed[-1]:
                        kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                    else:
                        kept.append(data if as_written else b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *([part.column("others")] if keep else []), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", *(["others"] if keep else []), "n_words", "n_removed", "kept"],
                )

    others = [rows.schema["others"]] if keep else []
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    out = marked.select("doc_id", *[f.name for f in others], "text", "covered", "copies", "tags").mapInArrow(
        cut, T.StructType([T.StructField("doc_id", T.LongType()), *others, *kinds])
    )
    return out.withColumn("kept", F.col("kept").cast("string"))
