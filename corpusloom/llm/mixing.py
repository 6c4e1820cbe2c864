"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources weigh 5, 2, 1, repeating, in code point order; together they take a share of all words, and none
more than ``repeat`` times its own (the excess goes to the others by weight). Slot j of the schedule is the van der
Corput point of j, looked up in the cumulative targets; the k-th slot of a source takes its k-th block. A source's
documents are laid end to end in an order shuffled by a hash and cut into blocks of equal word count; after
its last block the source starts again. A source whose target is under ``LEAST_SLOTS`` blocks has finer blocks, a
schedule at their pace in the same stretch, and ends at its target to the word; so small sources meet their targets
beside sources of any size.

Defined cases: a null source is a source of its own and comes last; null text has size 0; documents without words
are taken 0 times; rows that share a doc_id are documents of their own; an empty table gives no rows; other
columns of the input are ignored, or kept with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: A schedule has at least about so many slots, and blocks have at most so many words.
SLOTS, BLOCK_WORDS = 65_536, 4096
#: A source with fewer slots than this is cut into finer blocks, about so many for its target.
LEAST_SLOTS = 512
#: Hits sought beyond a fine schedule's end: more than the points of an interval ever fall short (about log2 of 2^48).
SPARE_HITS = 64
#: Bits of a slot number that the bit reversal covers.
SLOT_BITS = 48
HASH_BITS = 60
#: Documents or slots that one ordered group holds on average.
GROUP = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, repeat: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    What a capped source can't take goes to the rest by weight until none is above its cap: with caps in the order
    of cap over weight, that is the largest level whose predecessors are all capped. The windows run over one row
    per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    capped = F.col("source_size") * F.lit(repeat)
    rows = sizes.withColumn("weight", weight).withColumn("cap", capped).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(every)["level"]
    target = F.when(fits.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * fits))
    return rows.select("source", "source_size", target.alias("target"))


def ranked(rows: DataFrame, key: str, chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, per ``key``, in the order (chunk, order).

    Chunks are small groups; only their sums cross from one to the next, so a key with a third of all rows is
    spread over as many tasks as it has chunks. ``key`` may be null.
    """
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = (
        rows.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
        .select(F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(bases, F.col(key).eqNullSafe(F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    return joined.withColumn(out, (F.col("_local") + F.col("_base")).cast("bigint")).drop("_local", "_base", "_key", "_chunk")


def van_der_corput(j: Column) -> Column:
    """The point of a slot number: its binary digits mirrored at the point. Exact in a double."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(j), SLOT_BITS, "0")), 2, 10).cast("double")
    return mirrored / F.lit(float(1 << SLOT_BITS))


def shuffled(seed: int, doc_id: Column) -> Column:
    """A hash of ``HASH_BITS`` bits that orders a source's documents."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def row_of_text() -> Column:
    return F.xxhash64("doc_id", "text").alias("_row")


def stretches(targets: DataFrame) -> DataFrame:
    """``targets`` with the stretch [lo, hi) of the cumulative targets that each source has; the last one is open."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    upto, every = F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0)), F.sum("target").over(W.partitionBy())
    cum = targets.withColumn("hi", F.try_divide(upto, every))
    return cum.withColumn("lo", F.lag("hi", 1, 0.0).over(order)).withColumn("last", F.lead("hi").over(order).isNull())


def schedule(targets: DataFrame, block: int, n_slots: int) -> DataFrame:
    """(slot, source, turn): the source whose stretch of the cumulative targets holds the slot's point, and the
    slot's number among that source's slots. Stretches are cut at a grid of cells, so the lookup is an equi-join."""
    spark = targets.sparkSession
    cum = stretches(targets)
    cells = 1024
    cut = cum.select(
        "source", "lo", F.when(F.col("last"), 2.0).otherwise(F.col("hi")).alias("hi"),
        F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells)))).alias("cell"),
    )
    points = spark.range(n_slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    hit = points.join(cut, "cell").filter("u >= lo and u < hi").select("slot", "source")
    chunked = hit.withColumn("chunk", F.floor(F.col("slot") / GROUP))
    return ranked(chunked, "source", "chunk", [F.col("slot")], F.lit(1), "turn").drop("chunk")


def fine_schedule(targets: DataFrame, total: float, block: int, n_slots: int) -> DataFrame:
    """(slot, source, turn) of the sources that have an exact number of ``words`` to give, in blocks of ``grain`` words.

    Their points are those of a schedule with blocks of that grain. Points with the same leading bits have numbers
    that agree in the mirrored last bits, so a source's points are listed from the few cells of at most half its
    stretch's width, without the points between. Points go on behind the end of the schedule until the target is
    reached, and count to the last slot there.
    """
    fine = stretches(targets).filter(F.col("words").isNotNull() & (F.col("hi") > F.col("lo")))
    bits = F.least(F.lit(SLOT_BITS - 1), F.ceil(-F.log2(F.col("hi") - F.col("lo"))) + 1).cast("int")
    fine = fine.withColumn("bits", bits).withColumn("width", F.pow(F.lit(2.0), "bits").cast("bigint"))
    fine = fine.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * F.col("width")), F.least(F.floor(F.col("hi") * F.col("width")), F.col("width") - 1)))
    )
    first = F.conv(F.reverse(F.expr("lpad(bin(cell), bits, '0')")), 2, 10).cast("bigint")
    rounds = F.ceil(F.lit(float(total)) / F.col("grain") / F.col("width")) + SPARE_HITS
    fine = fine.withColumn("first", first).withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds)))
    fine = fine.withColumn("point", F.col("first") + F.col("round") * F.col("width"))
    hit = fine.withColumn("u", van_der_corput(F.col("point"))).filter("u >= lo and (u < hi or last)")
    slot = F.least(F.lit(n_slots - 1), F.floor(F.col("point") * F.col("grain") / F.lit(block))).cast("bigint")
    turn = (F.row_number().over(W.partitionBy("source").orderBy("point")) - 1).cast("bigint")
    return hit.select(slot.alias("slot"), "source", turn.alias("turn"))


def mix(
    docs: DataFrame, share: float = 1.5, repeat: int = 2, weights: tuple[float, ...] = WEIGHTS, block_words: int | None = None, seed: int = 17
) -> DataFrame:
    """One row per document and block of the mix that holds some of it: ``row_id``, ``doc_id``, ``source``, ``_row``
    (a hash of doc_id and text), ``size``, ``source_size``, ``target``, and ``slot``, ``turn``, ``pass`` (0 for the source's first run), ``word_from`` and
    ``word_to`` in the document. A document that the mix doesn't take has one row with null there.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    rows = docs.select("doc_id", "source", row_of_text(), size).withColumn("_hash", shuffled(seed, F.col("doc_id")))
    rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-documents")
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), share, float(repeat), weights
    )
    targets = stored(targets, "mix-targets")
    total, n_docs = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0], rows.count()
    block = block_words or int(min(BLOCK_WORDS, max(1, total // SLOTS)))
    n_slots = int(-(-total // block))
    few = F.col("target") < LEAST_SLOTS * block
    targets = targets.withColumn("grain", F.when(few, F.greatest(F.lit(1), F.floor(F.col("target") / LEAST_SLOTS))).otherwise(block).cast("bigint"))
    targets = targets.withColumn("words", F.when(few, F.round("target").cast("bigint")))
    slots = schedule(targets, block, n_slots).withColumn("_fine", F.lit(False)).unionByName(
        fine_schedule(targets, total, block, n_slots).withColumn("_fine", F.lit(True))
    )
    bits = max(0, (n_docs // GROUP).bit_length())
    chunk = F.shiftright("_hash", HASH_BITS - bits) if bits else F.lit(0).cast("bigint")
    laid = ranked(rows.withColumn("_chunk_no", chunk), "source", "_chunk_no", [F.col("_hash"), F.col("doc_id")], F.col("size"), "_from").drop("_chunk_no")
    by_source = targets.select(F.col("source").alias("_source"), "source_size", "target", "grain", "words")
    laid = laid.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "words")
    blocks_of = F.when(
        F.col("size") > 0, F.sequence(F.floor(F.col("_from") / F.col("grain")), F.floor((F.col("_from") + F.col("size") - 1) / F.col("grain")))
    )
    parts = laid.withColumn("_block", F.explode_outer(blocks_of))
    taken = slots.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).filter(F.col("_fine") == F.col("words").isNotNull())
    taken = taken.select(
        "_source", "slot", "turn", "source_size", "words", "grain", F.ceil(F.col("source_size") / F.col("grain")).alias("_blocks")
    ).filter("_blocks > 0")
    taken = taken.select(
        "_source", "slot", "turn", "grain", F.floor(F.col("turn") / F.col("_blocks")).alias("pass"), (F.col("turn") % F.col("_blocks")).alias("_no"),
        (F.col("words") - F.floor(F.col("turn") / F.col("_blocks")) * F.col("source_size")).alias("_upto"),
    ).filter(F.col("pass") < repeat)
    taken = taken.filter(F.col("_upto").isNull() | (F.col("_no") * F.col("grain") < F.col("_upto"))).drop("grain")
    joined = parts.join(taken, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_no")), "left")
    start = F.greatest(F.lit(0), F.col("_block") * F.col("grain") - F.col("_from"))
    end = F.least(F.col("size"), (F.col("_block") + 1) * F.col("grain") - F.col("_from"), F.col("_upto") - F.col("_from"))
    used = F.col("slot").isNotNull() & (end > start)
    return joined.select(
        "row_id", "doc_id", "source", "_row", "size", "source_size", "target",
        *[F.when(used, F.col(c)).alias(c) for c in ("slot", "turn", "pass")],
        F.when(used, start).alias("word_from"), F.when(used, end).alias("word_to"),
    )


def mixed_sizes(parts: DataFrame) -> DataFrame:
    """Per document of :func:`mix`'s rows: the words taken, repeats counted, and the words of each pass."""
    words = F.coalesce(F.col("word_to") - F.col("word_from"), F.lit(0))
    keys = ["row_id", "doc_id", "source", "size", "source_size", "target"]
    return parts.groupBy(*keys).agg(F.sum(words).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, once for each pass over the source that takes the document.

    A document at the edge of what its source gives is cut to the words taken, joined by one blank; ``n_chars`` then
    follows the text. Rows that share doc_id and text count each, with the first one's other columns.
    """
    parts = mix(docs, **options)
    ranges = parts.filter(F.col("slot").isNotNull() & (F.col("word_to") > F.col("word_from"))).groupBy("row_id", "_row", "pass").agg(
        F.min("word_from").alias("_from"), F.max("word_to").alias("_to"), F.first("size").alias("_size")
    )
    texts = docs.withColumn("_row", row_of_text()).dropDuplicates(["_row"])
    joined = texts.join(ranges, "_row")
    whole = F.col("_to") - F.col("_from") == F.col("_size")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")), " ")
    text = F.when(whole, F.col("text")).otherwise(cut)
    out = {"text": text} | ({"n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(cut).cast(dict(docs.dtypes)["n_chars"]))} if "n_chars" in docs.columns else {})
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
