"""Which later event shares most members with each earlier one: a set-overlap join that hot members don't blow up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.runtime import cut_lineage, top_per_group

#: A member whose (left, right) pairs in a group are more than this makes none; it counts by sets of such members.
HOT_PAIRS = 1 << 20
SALT = 16


def most_shared(left: DataFrame, right: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """For each left row set the right set at or after it in time that shares most members with it.

    ``left``: (grp, id, at, member), ``right``: (grp, number, at, member); a row per member. Of equal overlaps the
    earliest right set wins, then the smallest number. Gives (grp, id, number, overlap); sets without any shared member
    give no row.

    Rare members are joined as they are; a member makes at most ``hot_pairs`` pairs. Sets that meet there get the
    hot members they share added, so their overlap is complete. A right set that shares only hot members is found by
    sets: equal sets of hot members on each side are one, the overlap is computed once per pair of different sets,
    and each left row looks up the next right row of the largest overlap that still follows it. Were a set that
    shares rare members too the best one there, its complete overlap would be larger still, so the better of both
    ways is the best of all.
    """
    right = cut_lineage(right.distinct())
    # Only members that both sides have can be shared; the others go before any other step sends or sorts them.
    left = cut_lineage(left.join(right.select("grp", "member").distinct(), ["grp", "member"], "left_semi").select(*left.columns).distinct())
    a, b = marked(left, right, hot_pairs)
    common_a = a.filter("hot").groupBy("grp", "id", "at").agg(F.sort_array(F.collect_list("member")).alias("common"))
    common_b = b.filter("hot").groupBy("grp", "number", "at").agg(F.sort_array(F.collect_list("member")).alias("common"))
    rare = a.filter("NOT hot").select("grp", "member", "id", F.col("at").alias("since")).join(b.filter("NOT hot").drop("hot"), ["grp", "member"])
    rare = rare.filter(F.col("at") >= F.col("since")).groupBy("grp", "id", "number", "at").agg(F.count("*").alias("n"))
    rare = rare.join(common_a.select("grp", "id", F.col("common").alias("own")), ["grp", "id"], "left").join(
        common_b.select("grp", "number", "common"), ["grp", "number"], "left"
    )
    both = F.coalesce(F.size(F.array_intersect("own", "common")), F.lit(0))
    met = rare.select("grp", "id", "number", "at", (F.col("n") + both).alias("overlap"))
    every = met.unionByName(shared_hot(common_a, common_b))
    return top_per_group(every, ["grp", "id"], [F.desc("overlap"), F.col("at"), F.col("number")], 1).drop("at")


def marked(left: DataFrame, right: DataFrame, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``hot``. A hot member has over ``2 * sqrt(hot_pairs)`` rows, so there is at most one for so many
    rows (2,048 by default), and the list of them goes to every task."""
    count = lambda df, name: df.groupBy("grp", "member").agg(F.count("*").alias(name))
    hot = count(left, "a").join(count(right, "b"), ["grp", "member"]).filter(F.col("a") * F.col("b") > hot_pairs)
    hot = F.broadcast(cut_lineage(hot.select("grp", "member")).withColumn("found", F.lit(True)))
    flag = lambda df: df.join(hot, ["grp", "member"], "left").withColumn("hot", F.col("found").isNotNull()).drop("found")
    return flag(left), flag(right)


def shared_hot(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, id, number, at, overlap): for each left set of hot members the best right set."""
    each = lambda df, name: df.select("grp", F.col("common").alias(name)).distinct().withColumn("member", F.explode(name))
    overlaps = each(left, "own").join(each(right, "common"), ["grp", "member"]).groupBy("grp", "own", "common").agg(F.count("*").alias("overlap"))
    offers = overlaps.join(right, ["grp", "common"]).select("grp", "own", "overlap", "number", "at")
    last = offers.groupBy("grp", "own", "overlap").agg(F.max("at").alias("last"))
    # A set has at most as many overlaps as members.
    levels = last.groupBy("grp", "own").agg(F.collect_list(F.struct("overlap", "last")).alias("levels"))
    levels = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    salted = left.select("grp", F.col("common").alias("own"), "id", "at").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    reach = F.array_max(F.transform(F.filter("levels", lambda x: x["last"] >= F.col("at")), lambda x: x["overlap"]))
    seeking = salted.join(levels, ["grp", "own", "salt"]).withColumn("overlap", reach).filter("overlap IS NOT NULL")
    found = next_in_time(seeking.select("grp", "own", "overlap", "id", "at"), offers, ["grp", "own", "overlap"])
    return found.select("grp", "id", F.col("next.number").alias("number"), F.col("next.at").alias("at"), "overlap")


def next_in_time(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` (keys, id, at) with ``next``: the first (at, number) of ``right`` (keys, at, number) at or after it.

    For groups of any size: rows are ordered within days, and only the first right row of each day crosses to others.
    """
    day = F.date_trunc("day", F.col("at")).alias("day")
    events = left.select(*keys, day, "at", F.lit(0).alias("kind"), "id", F.lit(None).cast("bigint").alias("number")).unionByName(
        right.select(*keys, day, "at", F.lit(1).alias("kind"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.col("number").cast("bigint"))
    )
    offer = F.when(F.col("kind") == 1, F.struct("at", "number"))
    # Backwards in time, so that the frame grows row by row.
    days = events.groupBy(*keys, "day").agg(F.min(offer).alias("first"))
    later = F.last("first", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1))
    carried = days.select(*keys, "day", later.alias("later"))
    back = W.partitionBy(*keys, "day").orderBy(F.desc("at"), F.desc("kind"), F.desc("number")).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = events.withColumn("same_day", F.last(offer, ignorenulls=True).over(back)).filter("kind = 0")
    return within.join(carried, [*keys, "day"]).select(*keys, "id", "at", F.coalesce("same_day", "later").alias("next"))
