from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import plugins as PL
from corpusloom.functions import claims as CL
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import history as H
from corpusloom.operators import progress as PR
from corpusloom.operators import surface as SU
from corpusloom.operators import usage as U
from corpusloom.plans import verbs
from corpusloom.runtime import ordered_lag, ordered_sum
from corpusloom.sources import history as SH
from corpusloom.sources import tables as ST
from corpusloom.streaming import jobs as J
from fixtures import files_frame

DAY = dt.datetime(2024, 1, 1)
COMMITS = "repo string, hash string, ts timestamp, author string, subject string, is_merge boolean, files bigint, insertions bigint, deletions bigint"


def commits_frame(spark, rows):
    return spark.createDataFrame([("r", h, DAY + dt.timedelta(days=d), "dev", s, False, f, i, x) for h, d, s, f, i, x in rows], COMMITS)


@pytest.mark.parametrize("subject, files, changes, reason", [
    ("provision servers with terraform", 1, 1, "infrastructure-change"), ("Refactor: split module", 1, 1, "architecture-change"),
    ("upgrade the auth library", 1, 1, "dependency-change"), ("deprecate v1", 1, 1, "breaking-change"), ("batch", 12, 1, "large-refactor"),
    ("batch", 9, 200, "large-change"), ("batch", 9, 199, None), ("migrate to new package", 1, 1, "dependency-change"), ("deploy: remove package", 1, 1, "infrastructure-change"),
    ("docker refactor", 12, 500, "large-refactor"), ("fix typo", 1, 1, None)])
def test_decision_reason(spark, subject, files, changes, reason):
    got = spark.range(1).select(CL.decision_reason(F.lit(subject), F.lit(files), F.lit(changes), F.lit(0)).alias("r")).first()["r"]
    assert got == reason


def test_commit_log_with_pipes_merges_and_missing_statistics(spark, tmp_path):
    (tmp_path / "shop.log").write_text(
        "aaaaaaa1|2024-01-04T10:00:00+02:00|Ann|feat: a | b | c\n 3 files changed, 10 insertions(+), 2 deletions(-)\n\n"
        "bbbbbbb2|2024-01-03T10:00:00Z|Bob|Merge pull request #7 from x\nccccccc3|2024-01-02T10:00:00Z|Ann|fix\n 1 file changed, 1 deletion(-)\n\n"
        "ddddddd4|2024-01-01T10:00:00Z|Ann|init\n 1 file changed, 5 insertions(+)\n")
    rows = {r["hash"]: r for r in SH.read_commit_log(spark, str(tmp_path / "shop.log")).collect()}
    assert len(rows) == 4 and {r["repo"] for r in rows.values()} == {"shop"}
    a, b, c, d = (rows[k] for k in sorted(rows))
    assert a["subject"] == "feat: a | b | c" and (a["files"], a["insertions"], a["deletions"]) == (3, 10, 2)
    assert b["is_merge"] and (b["files"], b["insertions"]) == (0, 0) and (c["files"], c["deletions"]) == (1, 1) and d["insertions"] == 5


def test_decision_groups_merge_over_shared_files(spark):
    rows = [("h1", 0, "refactor a", 1, 1, 0), ("h2", 2, "refactor b", 1, 1, 0), ("h3", 30, "use terraform", 1, 1, 0), ("h4", 60, "split core", 1, 1, 0),
            ("h5", 90, "merge core", 1, 1, 0), ("h6", 120, "infra", 1, 1, 0), ("h7", 1, "typo", 1, 1, 0)]
    paths = [("r", "h1", "a"), ("r", "h2", "b"), ("r", "h3", "x"), ("r", "h4", "b"), ("r", "h4", "c"), ("r", "h5", "c"), ("r", "h6", "y")]
    files = spark.createDataFrame(paths, "repo string, hash string, path string")
    decided = H.decisions(commits_frame(spark, rows))
    groups = H.group_decisions(decided, files)
    assert {r["hash"]: r["decision_group"] for r in groups.collect()} == {"h1": 1, "h2": 1, "h3": 2, "h4": 1, "h5": 1, "h6": 5}
    records = [(r["adr"], r["title"], r["commits"], r["path"]) for r in H.number_decisions(groups).orderBy("adr").collect()]
    assert records == [("ADR-0001", "refactor a", 4, "0001-refactor-a.md"), ("ADR-0002", "use terraform", 1, "0002-use-terraform.md"), ("ADR-0003", "infra", 1, "0003-infra.md")]


def test_changed_paths_and_tags_are_read(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "tide.log").write_bytes(b"\0abc1234\n\nsrc/a.py\nsrc/b c.py\n\0def5678\n\0fed9876\n\nREADME.md\n")
    (tmp_path / "tags").mkdir()
    (tmp_path / "tags" / "tide.txt").write_text("v1.0|2024-01-02T03:04:05+00:00\nodd|name|2024-02-01T00:00:00+00:00\nbroken\n")
    files = SH.read_commit_files(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in files.collect()) == [("tide", "abc1234", "src/a.py"), ("tide", "abc1234", "src/b c.py"), ("tide", "fed9876", "README.md")]
    tags = {r["tag"]: (r["repo"], r["ts"].isoformat()) for r in SH.read_tags(spark, str(tmp_path / "tags")).selectExpr("repo", "tag", "cast(ts as timestamp_ntz) ts").collect()}
    assert tags == {"v1.0": ("tide", "2024-01-02T03:04:05"), "odd|name": ("tide", "2024-02-01T00:00:00")}


def test_failures_of_analyzers_stay_rows(spark):
    files = files_frame(spark, [("a", "x.py", "1\n"), ("b", "y.py", "2\n")])
    registry = PL.Registry()
    assert registry.run_all(files).count() == 0
    registry.register_analyzer("texts", lambda group: [("k", "no number")] if group["repo"].iloc[0] == "a" else [("k", 3)])
    registry.register_analyzer("shape", lambda group: [1])
    registry.register_analyzer("frame", lambda df: df.select("missing_column"), kind="frame")
    registry.register_analyzer("fine", lambda group: [("files", len(group)), ("note", None, "seen")])
    rows = {(r["repo"], r["analyzer"]): r for r in registry.run_all(files).collect()}
    status = {k: r["status"] for k, r in rows.items()}
    assert status == {("a", "texts"): "error", ("b", "texts"): "success", **{(x, n): "error" for x in "ab" for n in ("shape", "frame")}, **{(x, "fine"): "success" for x in "ab"}}
    assert rows["a", "fine"]["data"] == {"files": "1", "note": "seen"} and rows["b", "texts"]["data"] == {"k": "3"}


def test_connected_labels_on_a_long_chain(spark):
    chain = spark.range(1, 60).selectExpr("'r' AS repo", "id AS u", "id + 1 AS v")
    other = spark.range(100, 110).selectExpr("'r' AS repo", "id AS u", "100L AS v")
    labels = {r["node"]: r["label"] for r in H.connected_labels(chain.union(other)).collect()}
    assert labels == {**{n: 1 for n in range(2, 61)}, **{n: 100 for n in range(101, 110)}}


def test_ordered_helpers_agree_with_plain_windows(spark):
    df = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 7 END AS k", "timestamp '2024-01-01' + id * interval '7' hour AS ts", "id", "id % 11 AS v")
    plain = W.partitionBy("k").orderBy("ts", "id")
    day = F.date_trunc("day", F.col("ts"))
    want = {r["id"]: (r["s"], r["p"], r["d"]) for r in df.select(
        "id", F.sum("v").over(plain).alias("s"), F.lag("v").over(plain).alias("p"), F.row_number().over(W.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))).alias("d")).collect()}
    sums = {r["id"]: r["out"] for r in ordered_sum(df, ["k"], [F.col("ts"), F.col("id")], F.col("v"), "out", day).collect()}
    lags = {r["id"]: r["prev_v"] for r in ordered_lag(df, ["k"], ["ts", "id"], ["v"], day).collect()}
    down = {r["id"]: r["out"] for r in ordered_sum(df, ["k"], [F.desc("ts"), F.desc("id")], F.lit(1), "out", day, descending=True).collect()}
    assert {k: (sums[k], lags[k], down[k]) for k in sums} == want and len(want) == 500


def test_record_numbers_keep_all_digits(spark):
    got = spark.createDataFrame([(7,), (9999,), (10000,), (123456,)], "n bigint").select(T.adr_path(F.col("n"), F.lit("A b")).alias("p")).collect()
    assert [r["p"] for r in got] == ["0007-a-b.md", "9999-a-b.md", "10000-a-b.md", "123456-a-b.md"]


def test_decision_context_prefers_the_larger_overlap(spark):
    decided = H.decisions(commits_frame(spark, [("h1", 5, "refactor a", 1, 1, 0)]))
    files = spark.createDataFrame([("r", "h1", "a"), ("r", "h1", "b")], "repo string, hash string, path string")
    prs = spark.createDataFrame(
        [("r", 5, "part", "x", DAY + dt.timedelta(days=6), [], ["a"]), ("r", 6, "whole", "x", DAY + dt.timedelta(days=8), [], ["a", "b"]),
         ("r", 7, "much later", "x", DAY + dt.timedelta(days=300), [], ["a", "b"])],
        "repo string, number bigint, title string, body string, merged_at timestamp, labels array<string>, files array<string>")
    assert [(r["pr"], r["overlap"]) for r in H.decision_context(decided, files, prs).collect()] == [(6, 2)]


def test_decision_context_takes_the_next_merged_request(spark):
    decided = H.decisions(commits_frame(spark, [("h1", 5, "refactor a", 1, 1, 0), ("h2", 50, "refactor b", 1, 1, 0)]))
    files = spark.createDataFrame([("r", "h1", "a"), ("r", "h1", "b"), ("r", "h2", "a")], "repo string, hash string, path string")
    day = lambda n: DAY + dt.timedelta(days=n)
    prs = spark.createDataFrame(
        [("r", 1, "early", "x", day(1), ["l"], ["a"]), ("r", 2, "right", "Fixes #9", day(6), ["bug", "core"], ["a", "b"]), ("r", 3, "late", "x", day(9), [], ["b"]), ("r", 4, "open", "x", None, [], ["a"])],
        "repo string, number bigint, title string, body string, merged_at timestamp, labels array<string>, files array<string>")
    issues = spark.createDataFrame([("r", 9, "slow")], "repo string, number bigint, title string")
    rows = {r["hash"]: (r["pr"], r["overlap"], r["labels"], r["issue_title"]) for r in H.decision_context(decided, files, prs, issues).collect()}
    assert rows == {"h1": (2, 2, "bug,core", "slow"), "h2": (None, None, None, None)}


@pytest.mark.parametrize("hot_pairs", [1 << 20, 40, 0])
def test_requests_by_overlap_agree_with_a_plain_count(spark, hot_pairs):
    rng = random.Random(hot_pairs)
    day = lambda n: DAY + dt.timedelta(days=n, hours=rng.randrange(3))
    # Every commit and request touches "all"; three in four touch one of few common files.
    paths = lambda: {"all"} | {f"c{rng.randrange(4)}" for _ in range(rng.randrange(3))} | {f"p{rng.randrange(30)}" for _ in range(rng.randrange(3))}
    commits = [("r" + str(k % 2), f"h{k}", day(rng.randrange(400)), paths()) for k in range(120)]
    prs = [("r" + str(k % 2), k, None if k % 9 == 0 else day(rng.randrange(400)), paths()) for k in range(60)]
    decided = spark.createDataFrame([c[:3] for c in commits], "repo string, hash string, ts timestamp")
    files = spark.createDataFrame([(r, h, p) for r, h, _, some in commits for p in some], "repo string, hash string, path string")
    offered = spark.createDataFrame([(r, n, at, sorted(some) * 2) for r, n, at, some in prs], "repo string, number bigint, merged_at timestamp, files array<string>")
    want = {}
    for r, h, ts, some in commits:
        votes = [(-len(some & own), at, n) for repo, n, at, own in prs if repo == r and at is not None and at >= ts]
        if votes:
            want[h] = (min(votes)[2], -min(votes)[0])
    got = H.decision_requests(decided, files, offered, hot_pairs).collect()
    assert len(got) == len(want) > 90
    assert {x["hash"]: (x["next_pr"], x["overlap"]) for x in got} == want
    assert max((x["overlap"] for x in got)) >= 3


def test_a_file_in_every_commit_makes_no_pairs(spark):
    n = 20_000  # 2 * 10^8 pairs, were they made
    when = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id)"
    decided = spark.range(n).selectExpr("'r' AS repo", "'h' || id AS hash", f"{when} AS ts")
    prs = spark.range(n).selectExpr("'r' AS repo", "id AS number", f"{when} AS merged_at", "array('all') AS files")
    found = H.decision_requests(decided, decided.select("repo", "hash", F.lit("all").alias("path")), prs, 1000)
    assert tuple(found.agg(F.count("*"), F.count_if(F.expr("next_pr = CAST(substring(hash, 2) AS bigint) AND overlap = 1"))).first()) == (n, n)


def test_related_decisions_weigh_rare_files(spark):
    # Sessions five days apart, all at "all"; some share a rare file, near in time or not.
    commits = [("r", f"h{k:02}", DAY + dt.timedelta(days=5 * k), f"refactor part{k}", "x") for k in range(40)]
    decided = spark.createDataFrame(commits, "repo string, hash string, ts timestamp, subject string, reason string")
    own = {3: ["two"], 5: ["two"], 7: ["far"], 20: ["far"], 10: ["three"], 12: ["three"], 14: ["three"]}
    files = spark.createDataFrame([("r", f"h{k:02}", p) for k in range(40) for p in ["all", *own.get(k, [])]], "repo string, hash string, path string")
    groups = {r["hash"]: r["decision_group"] for r in H.related_decisions(decided, files).collect()}
    same = {k: v for k, v in groups.items() if list(groups.values()).count(v) > 1}
    assert same == {"h03": 4, "h05": 4}
    # Three sessions at a file weigh 500 each time; like subjects make up for the rest.
    alike = decided.withColumn("subject", F.when(F.col("hash").isin("h10", "h12", "h14"), "replace the parser").otherwise(F.col("subject")))
    groups = {r["hash"]: r["decision_group"] for r in H.related_decisions(alike, files).collect()}
    assert {k for k, v in groups.items() if v == 11} == {"h10", "h12", "h14"}
    assert H.related_decisions(decided.unionByName(decided.withColumn("repo", F.lit("s"))), files).count() == 80


def test_sessions_of_whole_days(spark):
    hours = [0, 5, 23, 24 * 3 + 22, 24 * 3 + 23, 24 * 7, 24 * 10, 24 * 13 + 1]
    decided = spark.createDataFrame([("r", f"h{k}", DAY + dt.timedelta(hours=h), "x", "y") for k, h in enumerate(hours)], "repo string, hash string, ts timestamp, subject string, reason string")
    assert [r["session"] for r in H.decision_sessions(decided).orderBy("ts").collect()] == [1, 1, 1, 1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        H.decision_sessions(decided, 0)


def test_versions_sort_by_number(spark):
    tags = spark.createDataFrame([("r", t, DAY) for t in ("v1.9.0", "v1.10.0", "v2.0.0", "v1.10.0-rc1")], "repo string, tag string, ts timestamp")
    assert [r["tag"] for r in H.tags_by_version(tags).orderBy("position").collect()] == ["v2.0.0", "v1.10.0-rc1", "v1.10.0", "v1.9.0"]


STATE = """{"version": 1, "updated_at": "2024-01-01T00:00:00.000Z", "milestones": [{"name": "Setup", "items": [
  {"name": "Open the desk", "status": "pending", "detect": {"file_exists": "src/index.js"}}, {"name": "Keep a log book", "status": "pending", "detect": {"file_exists": "tests/index.test.js"}},
  {"name": "Log", "status": "pending", "detect": {"grep": "log(ger)?[(]", "grep_path": "src"}}, {"name": "Elsewhere", "status": "pending", "detect": {"grep": "logger", "grep_path": "lib"}},
  {"name": "Api", "status": "pending", "detect": {"export_exists": "start"}}, {"name": "Old", "status": "done", "detect": {"file_exists": "nope"}}]}]}"""


def test_progress(spark):
    items = ST.read_milestones(spark.createDataFrame([("r", STATE)], "repo string, content string"))
    files = files_frame(spark, [("r", "src/index.js", "logger();\nexport function start() {}\n"), ("other", "tests/index.test.js", "x\n")])
    detected, report = verbs.progress(items, files)
    assert {r["item"]: r["state"] for r in detected.collect()} == {
        "Open the desk": "detected", "Keep a log book": "pending", "Log": "detected", "Elsewhere": "pending", "Api": "detected", "Old": "done"}
    total = report.filter("milestone = 'TOTAL'").first()
    assert (total["total"], total["done"], total["pending"], total["newly_detected"], total["percent"]) == (6, 4, 2, 3, 66)


def test_search_rules_that_fail_are_states_of_their_items(spark):
    rules = [("(", None), ("a[", "src"), ("start\\(", "src"), ("^needle$", None), ("x{2,}y", None), ("(foo|bar)_1?z", "lib"), ("nowhere", None), ("[[:digit:]]{3}", None)]
    items = spark.createDataFrame(
        [("r", "m", f"i{k}", "pending", "grep", v.replace("\\", "\\"), p) for k, (v, p) in enumerate(rules)] + [("r", "m", "old", "done", "grep", "(", None), ("r", "m", "none", "pending", None, None, None)],
        "repo string, milestone string, item string, status string, detect_type string, detect_value string, detect_path string")
    files = files_frame(spark, [("r", "src/a.js", "start(1)\nneedle\n"), ("r", "lib/b.js", "xxxy bar_z 123\n"), ("s", "c.js", "nowhere\n")])
    detected, report = verbs.progress(items, files)
    assert {r["item"]: (r["state"], r["status"]) for r in detected.collect()} == {
        "i0": ("error", "pending"), "i1": ("error", "pending"), "i2": ("detected", "done"), "i3": ("detected", "done"), "i4": ("detected", "done"), "i5": ("detected", "done"),
        "i6": ("pending", "pending"), "i7": ("detected", "done"), "old": ("done", "done"), "none": ("pending", "pending")}
    assert tuple(report.filter("milestone = 'TOTAL'").select("total", "done", "pending", "newly_detected").first()) == (10, 6, 4, 5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ".", "x?", "y*", "z+", "\\.", "\\d", "[ab]", "[^]]", "(ab|c)", "(d)", "e{2}", "f{0,1}", "|", "^", "$", "_"]), min_size=1, max_size=8), st.text("abcdefxyz_.1]", max_size=12))
def test_required_text_is_in_every_match(parts, text):
    rule = "".join(parts).replace("\\", "\\")
    if PR.compiled(rule).search(text):
        assert PR.required_text(rule) in text


def test_progress_is_written_back(spark, tmp_path):
    items = ST.read_milestones(spark.createDataFrame([("r", STATE)], "repo string, content string"))
    files = files_frame(spark, [("r", "src/index.js", "logger();\nexport function start() {}\n")])
    path = str(tmp_path / "milestones")
    first = verbs.save_progress(items, files, path, F.lit(DAY))
    assert tuple(first.filter("milestone = 'TOTAL'").select("total", "done", "newly_detected").first()) == (6, 4, 3)
    columns = [c for c in items.columns]
    kept = spark.read.schema(items.schema).json(path).select(*columns)
    assert {r["item"] for r in kept.filter("status = 'done'").collect()} == {"Open the desk", "Log", "Api", "Old"}
    again = verbs.save_progress(kept, files, path, F.lit(DAY + dt.timedelta(days=1)))
    assert tuple(again.filter("milestone = 'TOTAL'").select("total", "done", "newly_detected").first()) == (6, 4, 0)


def test_consent_truth_table(spark):
    flags = [(e, d) for e in (True, False, None) for d in (True, False, None)]
    events = spark.createDataFrame(flags, "enabled boolean, do_not_track boolean")
    assert sorted(map(tuple, P.consented(events).collect()), key=str) == [(True, False), (True, None)]


def test_late_events_are_dropped_by_the_stream(spark, tmp_path):
    schema = "ts timestamp, command string, enabled boolean, do_not_track boolean"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(*hours):
        rows = [(DAY + dt.timedelta(hours=h), "check", True, False) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.start_append(J.telemetry_counts_stream(stream), out, mark).awaitTermination()

    arrive(1, 2, 30)
    arrive(3, 50)
    arrive(100)
    rows = {r["window_start"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert rows == {DAY: 2, DAY + dt.timedelta(days=1): 1, DAY + dt.timedelta(days=2): 1}


def test_daily_counts_leave_the_state_and_add_up(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for days in ([0, 0, 1], [1, 30], [31, 5], [90]):  # the second day 5 comes too late
        spark.createDataFrame([(DAY + dt.timedelta(days=d, hours=1), "r") for d in days], "ts timestamp, repo string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, repo string").parquet(source)
        J.start_append(J.activity_days_stream(stream), out, mark).awaitTermination()
    days = spark.read.schema("day timestamp, repo string, n bigint").parquet(out)
    assert {(r["day"] - DAY).days: r["n"] for r in days.collect()} == {0: 2, 1: 2, 30: 1, 31: 1}
    assert {(r["day"] - DAY).days: r["n"] for r in J.trailing_activity(days).collect()} == {0: 2, 1: 4, 30: 3, 31: 2}


def test_response_cache_expires(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, repo string, key string"
    for minutes in ([0, 10, 61], [50, 121], [200], [10, 420]):
        spark.createDataFrame([(DAY + dt.timedelta(minutes=m), "r", "prs") for m in minutes], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.start_append(J.response_cache_stream(stream), out, mark).awaitTermination()
    times = sorted(r["ts"] for r in spark.read.schema("repo string, key string, ts timestamp").parquet(out).collect())
    assert [(x - DAY).total_seconds() / 60 for x in times] == [0, 61, 200, 420]


def test_analyzers_are_isolated(spark):
    files = files_frame(spark, [("a", "src/x.rpc.ts", "one\n"), ("b", "src/y.rpc.ts", "two\n"), ("b", "src/z.ts", "three\n")])

    def count(group):
        return [("FILES", len(group))]

    def picky(group):
        if group["repo"].iloc[0] == "b":
            raise RuntimeError("no")
        return [("PATTERN", 1, "EventLog")]

    registry = PL.Registry()
    registry.register_analyzer("count", count, file_filter="*.rpc.ts", confidence=0.9)
    registry.register_analyzer("picky", picky)
    rows = {(r["repo"], r["analyzer"]): (r["status"], r["data"], r["error"]) for r in registry.run_all(files).collect()}
    assert rows == {
        ("a", "count"): ("success", {"FILES": "1"}, None), ("b", "count"): ("success", {"FILES": "1"}, None),
        ("a", "picky"): ("success", {"PATTERN": "EventLog"}, None), ("b", "picky"): ("error", None, "RuntimeError: no")}
    assert {r["status"] for r in registry.run_analyzer("unknown", files).collect()} == {"not_found"}
    with pytest.raises(ValueError):
        registry.register_analyzer("x", count, kind="other")


def test_every_text_of_a_key_stays(spark):
    files = files_frame(spark, [("r", f"src/f{k}.py", f"one {k}\ntwo {k}\n") for k in range(5)] + [("s", "x.py", "none\n")])

    def listed(group):
        return [("A", 1, "third"), ("A", 1, "first"), ("A", 2, "first")] if group["repo"].iloc[0] == "s" else [
            ("L", None, line, path, k) for path, text in zip(group["path"], group["content"], strict=True) for k, line in enumerate(text.split("\n")) if line]

    registry = PL.Registry()
    registry.register_analyzer("listed", listed)
    registry.register_analyzer("native", lambda f: f.select("repo", F.lit("P").alias("key"), F.lit(1).alias("value"), F.col("path").alias("text"), "path"), kind="frame")
    found = registry.text_findings(files)
    lists = {(r["repo"], r["analyzer"], r["key"]): (r["n_texts"], r["texts"]) for r in PL.first_texts(found, 6).collect()}
    assert lists[("s", "listed", "A")] == (3, ["third", "first", "first"])
    assert lists[("r", "listed", "L")] == (10, ["one 0", "two 0", "one 1", "two 1", "one 2", "two 2"])
    assert lists[("r", "native", "P")] == (5, [f"src/f{k}.py" for k in range(5)])
    data = {(r["repo"], r["analyzer"]): r["data"] for r in registry.run_all(files).collect()}
    assert data[("s", "listed")] == {"A": "third"} and data[("r", "listed")] == {"L": "one 0"}
    assert PL.Registry().text_findings(files).count() == 0


def test_current_version(spark):
    versions = spark.createDataFrame([("r", "v2", DAY), ("r", "v1", DAY - dt.timedelta(days=1)), ("s", "v9", DAY)], "repo string, tag string, created timestamp")
    switches = spark.createDataFrame([("s", "v8", DAY), ("s", "v7", DAY - dt.timedelta(days=1))], "repo string, tag string, switched_at timestamp")
    assert {r["repo"]: r["current"] for r in U.current_version(versions, switches).collect()} == {"r": "v1", "s": "v8"}
    assert U.current_version(versions).count() == 2


def test_secret_and_surface_plans_do_not_shuffle_texts(spark):
    from corpusloom.operators import secrets as S

    files = files_frame(spark, [("r", "src/a.js", "x\n")])
    for df in (S.scan_secrets(files), SU.endpoints(files), SU.exports(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
