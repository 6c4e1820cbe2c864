"""Commit history: decisions, their groups, contributors, hotspots, pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import claims as CL
from corpusloom.functions import text as T
from corpusloom.operators.filters import non_merge
from corpusloom.operators.overlap import HOT_PAIRS, most_shared
from corpusloom.runtime import cut_lineage, ordered_sum, top_per_group


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.col("hash")]


def decisions(commits: DataFrame) -> DataFrame:
    """Commits worth a decision record, with the first rule that applies. Map-only."""
    reason = CL.decision_reason(F.col("subject"), F.col("files"), F.col("insertions"), F.col("deletions"))
    return commits.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupingSets([[F.col("repo"), F.col("reason")], [F.col("repo")]], "repo", "reason").agg(
        F.count("*").alias("decisions")
    ).select("repo", F.coalesce("reason", F.lit("TOTAL")).alias("reason"), "decisions")


def last_commits(commits: DataFrame, n: int = 50) -> DataFrame:
    return top_per_group(commits, ["repo"], newest_first(), n)


def repo_history_summary(commits: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = F.col("ts") >= now - F.make_interval(days=F.lit(days))
    return commits.groupBy("repo").agg(
        F.count("*").alias("total_commits"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"),
        F.countDistinct("author").alias("authors"), F.count_if(recent).alias("recent_commits"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    return non_merge(commits).groupBy("repo", "author").agg(F.count("*").alias("commits"))


def top_contributors(commits: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(contributors(commits), ["repo"], [F.desc("commits"), F.col("author")], k, "rank")


def hotspots(commits: DataFrame, commit_files: DataFrame, n: int = 100) -> DataFrame:
    """Changes per path over the last n commits of each repo."""
    recent = last_commits(commits.select("repo", "hash", "ts"), n).select("repo", "hash")
    return commit_files.join(recent, ["repo", "hash"], "left_semi").groupBy("repo", "path").agg(F.count("*").alias("changes"))


def top_hotspots(commits: DataFrame, commit_files: DataFrame, n: int = 100, k: int = 10) -> DataFrame:
    return top_per_group(hotspots(commits, commit_files, n), ["repo"], [F.desc("changes"), F.col("path")], k, "rank")


def commit_paths(commits: DataFrame, commit_files: DataFrame, k: int = 20) -> DataFrame:
    """The first k paths of each given commit."""
    joined = commit_files.join(commits.select("repo", "hash"), ["repo", "hash"], "left_semi")
    return top_per_group(joined.select("repo", "hash", "path").distinct(), ["repo", "hash"], [F.col("path")], k, "rank")


def recent_tags(tags: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(tags, ["repo"], [F.desc("ts"), F.desc("tag")], k, "rank")


def version_key(tag: Column) -> Column:
    """Numeric parts of a version, for ordering."""
    return F.transform(F.regexp_extract_all(tag, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.try_cast("bigint"))


def tags_by_version(tags: DataFrame) -> DataFrame:
    """All tags with their position from the newest version down."""
    keyed = tags.withColumn("_k", version_key(F.col("tag")))
    return ordered_sum(keyed, ["repo"], [F.desc("_k"), F.desc("tag")], F.lit(1), "position", F.slice("_k", 1, 2), descending=True).drop("_k")


def recent_prs(prs: DataFrame, k: int = 20) -> DataFrame:
    return top_per_group(prs, ["repo"], [F.desc("merged_at"), F.desc("number")], k, "rank")


def recent_issues(issues: DataFrame, k: int = 20) -> DataFrame:
    return top_per_group(issues, ["repo"], [F.desc("closed_at"), F.desc("number")], k, "rank")


def pr_labels(prs: DataFrame) -> DataFrame:
    return prs.select(
        "repo", "number", F.array_join("labels", ",").alias("labels"), F.size("files").cast("bigint").alias("files_changed"))


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("repo", "number").agg(
        F.count_if(F.col("kind") == "review").alias("reviews"), F.count_if(F.col("body").isNotNull()).alias("comments"))


def decision_sessions(decided: DataFrame, gap_days: int = 3) -> DataFrame:
    """Number the runs of decisions of a repo that follow each other within the gap of whole days.

    Within a day no gap can open, so sessions are numbered over days (one row per repo and day, combined map-side), and
    the decisions look their number up.
    """
    if gap_days < 1:
        raise ValueError("a gap has at least one day")
    base = decided.select("repo", "hash", "ts", "subject", "reason", F.to_date("ts").alias("_day"))
    days = base.groupBy("repo", "_day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = W.partitionBy("repo").orderBy("_day")
    before = F.lag("last").over(order)
    opens = before.isNull() | (F.col("first") > before + F.make_interval(days=F.lit(gap_days)))
    numbered = days.withColumn("_new", opens.cast("bigint")).select("repo", "_day", F.sum("_new").over(order).alias("session"))
    return base.join(numbered, ["_day", "repo"]).select("repo", "hash", "ts", "subject", "reason", "session")


def stored_sessions(decided: DataFrame, gap_days: int) -> DataFrame:
    """The sessions, stored. They read the decisions twice, so these are stored first and found once."""
    return cut_lineage(decision_sessions(cut_lineage(decided.select("repo", "hash", "ts", "subject", "reason")), gap_days))


def touched_paths(sessions: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repo, path, session), each once. The hash leads the join's keys: a sort that begins with it seldom compares the rest."""
    return commit_files.join(sessions.select("hash", "repo", "session"), ["hash", "repo"]).select("repo", "path", "session").distinct()


def connected_labels(edges: DataFrame) -> DataFrame:
    """Smallest member of the component of every node, from undirected edges (repo, u, v).

    Alternates the large-star and small-star steps: every step is a map-side minimum per node and a join of one
    row per node, so no neighbourhood is ever gathered. The edge set is checkpointed each round and the loop
    ends when a round changes nothing; the number of rounds grows with the logarithm of the component size.
    """
    key = ["repo", "u"]
    clean = edges.filter("u <> v").select("repo", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = cut_lineage(clean)
    mark = None
    while True:
        both = current.unionByName(current.select("repo", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key).agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, key).filter("v > u").select("repo", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*key).agg(F.min("v").alias("m"))
        linked = large.join(least, key)
        small = linked.filter("v <> m").select("repo", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("repo", "u", F.col("m").alias("v"))).distinct()
        current = cut_lineage(small)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("repo", "u", "v"))).first()
        if seen == mark:
            return current.groupBy("repo", F.col("u").alias("node")).agg(F.min("v").alias("label"))
        mark = seen


def group_decisions(decided: DataFrame, commit_files: DataFrame, gap_days: int = 3) -> DataFrame:
    """Decisions grouped by closeness in time, with groups that touch the same file merged.

    Sessions sharing a path are linked through the smallest of them, which keeps the link table linear.
    """
    sessions = stored_sessions(decided, gap_days)
    touched = touched_paths(sessions, commit_files)
    hub = touched.groupBy("repo", "path").agg(F.min("session").alias("v"))
    links = touched.join(hub, ["repo", "path"]).select("repo", F.col("session").alias("u"), "v").filter("u <> v").distinct()
    labels = connected_labels(links).withColumnRenamed("node", "session")
    return sessions.join(labels, ["session", "repo"], "left").select(
        "repo", "hash", "ts", "subject", "reason", "session", F.coalesce("label", "session").alias("decision_group"))


SIGNS = 16


def subject_signs(sessions: DataFrame) -> DataFrame:
    """(repo, session, signs): MinHash values of the words in the subjects of each session. Each different word is hashed once,
    in a step of its own: of a ``distinct`` right below the minimum the optimizer makes one aggregate that hashes every row's words."""
    words = sessions.select("repo", "session", F.explode(F.array_distinct(F.split(F.lower("subject"), " "))).alias("word")).distinct()
    sign = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), "word").cast("binary")), 1, 15), 16, 10).cast("bigint").alias(f"s{k}") for k in range(SIGNS)]
    signed = words.select("word").distinct().select("word", *sign)
    least = [F.min(f"s{k}").alias(f"s{k}") for k in range(SIGNS)]
    return words.join(signed, "word").groupBy("repo", "session").agg(*least).select(
        "repo", "session", F.array(*[f"s{k}" for k in range(SIGNS)]).alias("signs"))


def session_links(sessions: DataFrame, commit_files: DataFrame, band_days: int = 30, subject_weight: int = 500) -> DataFrame:
    """(repo, u, v, weight) of sessions that follow one another at a file and start within ``band_days``.

    A file weighs 1000 / (sessions that touch it - 1): one that only these two touch weighs 1000, one that all touch next to
    nothing. Subjects add ``subject_weight`` times their estimated similarity. A file links each session to the next one
    at it only, so links grow with the rows. One window per file counts its sessions and finds the next one: sessions of a repo
    are days apart, so a window has at most a row for every few days of its history, however many commits there are. Its
    key begins with a number, by which rows sort faster than by paths that begin alike.
    """
    touched = touched_paths(sessions, commit_files).filter(F.col("path").isNotNull())
    order = W.partitionBy(F.xxhash64("path", "repo"), "path", "repo").orderBy("session")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = touched.select("repo", F.col("session").alias("u"), F.lag("session").over(order).alias("v"), F.count("*").over(whole).alias("n"))
    weights = pairs.filter("v IS NOT NULL").groupBy("repo", "u", "v").agg(F.sum(F.expr("1000 DIV (n - 1)")).alias("files"))
    starts = cut_lineage(
        sessions.groupBy("repo", "session").agg(F.min("ts").alias("since")).join(subject_signs(sessions), ["session", "repo"], "left"))
    side = lambda name: starts.select("repo", F.col("session").alias(name), F.struct("since", "signs").alias(f"_{name}"))
    near = weights.join(side("u"), ["repo", "u"]).join(side("v"), ["repo", "v"]).filter(
        F.col("_u.since") <= F.col("_v.since") + F.make_interval(days=F.lit(band_days)))
    equal = F.coalesce(F.size(F.filter(F.zip_with("_u.signs", "_v.signs", lambda x, y: x == y), lambda e: e)), F.lit(0))
    return near.select("repo", "u", "v", (F.col("files") + F.floor(equal * subject_weight / SIGNS)).alias("weight"))


def related_decisions(decided: DataFrame, commit_files: DataFrame, gap_days: int = 3, band_days: int = 30, bound: int = 1000) -> DataFrame:
    """Decisions grouped by closeness in time, rare shared files and like subjects: sessions linked by ``bound`` or more,
    directly or through others, are one group, named by its smallest session."""
    sessions = stored_sessions(decided, gap_days)
    links = session_links(sessions, commit_files, band_days).filter(F.col("weight") >= bound).select("repo", "u", "v")
    labels = connected_labels(links).withColumnRenamed("node", "session")
    return sessions.join(labels, ["session", "repo"], "left").select(
        "repo", "hash", "ts", "subject", "reason", "session", F.coalesce("label", "session").alias("decision_group"))


def number_decisions(groups: DataFrame) -> DataFrame:
    """One numbered record per decision group, by date: ADR-0001 and its file name. The records are stored, as numbering reads
    them twice."""
    firsts = cut_lineage(groups.groupBy("decision_group", "repo").agg(
        F.min("ts").alias("first_ts"), F.min_by(F.struct("subject", "reason"), F.struct("ts", "hash")).alias("f"),
        F.count("*").alias("commits"),
    ))
    numbered = ordered_sum(
        firsts, ["repo"], [F.col("first_ts"), F.col("decision_group")], F.lit(1), "n",
        F.date_trunc("day", F.col("first_ts")))
    return numbered.select(
        "repo", "decision_group", F.concat(F.lit("ADR-"), T.four_digits(F.col("n"))).alias("adr"),
        F.col("f.subject").alias("title"), F.col("f.reason").alias("reason"), "first_ts", "commits",
        T.adr_path(F.col("n"), F.col("f.subject")).alias("path"),
    )


def decision_requests(decided: DataFrame, commit_files: DataFrame, prs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(repo, hash, next_pr, overlap): of the requests merged at or after a commit, the one that shares most files with it;
    of equals the one merged first, then the smallest number. No span of time bounds the search."""
    touched = commit_files.join(decided.select("repo", "hash", "ts"), ["repo", "hash"]).select(
        F.col("repo").alias("grp"), F.col("hash").alias("id"), F.col("ts").alias("at"), F.col("path").alias("member"))
    offered = prs.filter(F.col("merged_at").isNotNull()).select(
        F.col("repo").alias("grp"), "number", F.col("merged_at").alias("at"), F.explode("files").alias("member"))
    best = most_shared(touched, offered, hot_pairs)
    return best.select(F.col("grp").alias("repo"), F.col("id").alias("hash"), F.col("number").alias("next_pr"), "overlap")


def decision_context(
    decided: DataFrame, commit_files: DataFrame, prs: DataFrame, issues: DataFrame | None = None, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """The pull request behind each decision, with its labels and the issue it names."""
    best = decision_requests(decided, commit_files, prs, hot_pairs)
    context = prs.select(
        "repo", F.col("number").alias("next_pr"), "title", F.array_join("labels", ",").alias("labels"),
        F.regexp_extract(F.col("body"), r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?) #([0-9]+)", 1).try_cast("bigint").alias("issue"))
    joined = decided.join(best, ["repo", "hash"], "left").join(context, ["repo", "next_pr"], "left")
    if issues is None:
        joined = joined.withColumn("issue_title", F.lit(None).cast("string"))
    else:
        joined = joined.join(issues.select("repo", F.col("number").alias("issue"), F.col("title").alias("issue_title")), ["repo", "issue"], "left")
    return joined.select(
        "repo", "hash", "ts", "subject", "reason", F.col("next_pr").alias("pr"), "overlap", F.col("title").alias("pr_title"),
        "labels", "issue", "issue_title")
