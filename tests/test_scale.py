"""Tables kept as folders, and steps that were rewritten so that they grow with their input."""

from __future__ import annotations

import datetime as dt

import __spark_entry__ as entry
from corpusloom.streaming import jobs as J

DAY = dt.datetime(2024, 1, 1)


def documents(spark, n=60):
    rows = [(k, "one" if k % 2 else "two", ("en", "fr", "de", "es")[k % 4], f"text {k}\nline", 10) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, n_chars bigint")


def test_staleness_stream_reads_a_folder_of_files(spark, tmp_path):
    """The documents as a folder ``documents.parquet``: every section that cites an existing file gets its status."""
    documents(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["st3_staleness_stream"](spark, str(tmp_path)).collect()
    assert {(r["repo"], r["section"]) for r in rows} >= {("one", "s0"), ("two", "s2")}


def test_event_stream_reads_a_folder_of_files(spark, tmp_path):
    rows = [(k, DAY + dt.timedelta(minutes=k), k % 3, "view", 1.0, "{}") for k in range(90)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["st4_response_cache_stream"](spark, str(tmp_path)).collect()
    assert sorted((r["key"], (r["ts"] - DAY).total_seconds() / 60) for r in found) == sorted((f"view-{u}", u + m) for u in range(3) for m in (0, 63))


def test_response_cache_calls_python_once_per_bucket(spark, tmp_path):
    """Keys of one bucket, null ones too, keep stored responses of their own over batches; a state that ran out is fetched again."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, repo string, key string"
    keys = [("r", "a"), ("r", "b"), ("q", "a"), (None, "a"), ("r", None)]
    for minutes in ([0, 10, 61], [50, 121], [200], [10, 420]):
        rows = [(DAY + dt.timedelta(minutes=m + k), *key) for m in minutes for k, key in enumerate(keys)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.start_append(J.response_cache_stream(stream, buckets=2), out, mark).awaitTermination()
    found = {(r["repo"], r["key"], (r["ts"] - DAY).total_seconds() / 60) for r in spark.read.schema("repo string, key string, ts timestamp").parquet(out).collect()}
    assert found == {(*key, m + k) for k, key in enumerate(keys) for m in (0, 61, 200, 420)}


def test_words_behind_another_identifier_are_in_reach(spark):
    """The word stands within 200 characters of the email, with an address of another kind in between."""
    from corpusloom.llm import sanitising as S

    texts = [f"{x} zebra {x * 2} 1.2.3.{k} a@b.cc" for k, x in enumerate(("aa", "bb", "cc", "dd"))] + [f"{x} mail {x}@y.zz" for x in ("ee", "ff", "gg", "hh")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]] for r in S.personal_data(docs).collect()}
    assert all(("zebra" in found[k]) == (k < 4) for k in range(8))


def test_corpus_is_listed_in_few_tasks(spark, tmp_path):
    """More folders than are listed in one go: the number of listing tasks is held down, and the setting is as before."""
    from corpusloom.sources import files as SF

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with SF.short_listings(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    for k in range(40):
        (tmp_path / "r" / f"d{k}").mkdir(parents=True)
        (tmp_path / "r" / f"d{k}" / "a.txt").write_text("x\n")
    assert SF.read_corpus(spark, str(tmp_path), "*.txt").count() == 40 and spark.conf.get(name) == before


ODD_FILES = [
    (1, "a:b/c", "x"), (1, "a:b/c", "more"), (2, "a b", "two\n"), (3, "", ""), (4, None, None), (None, "a b", "no id"), (-5, "..", "up"),
    (6, ".{été}[日]^?*'\"#\\%=", "é\r\n\nz"), (7, "_\x01\x7f~", "t"), (8, "same", "first"), (9, "same", "second")]


def read_as_corpus(spark, folder):
    rows = [(doc, repo, "en", text, 1) for doc, repo, text in ODD_FILES]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return sorted(tuple(r) for r in entry.queries()["s1_read_corpus_files"](spark, str(folder)).collect())


def corpus_rows():
    """What the files hold: names as Spark's writer escapes them, nothing for an id that isn't a number."""
    import hashlib
    import re

    files = {}
    for doc, repo, text in ODD_FILES:
        files.setdefault((doc, repo), []).append((text or "") + "\n")
    escaped = lambda name: re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", name or "__HIVE_DEFAULT_PARTITION__")
    plain = lambda doc: str(doc) if doc is not None and doc >= 0 else ""
    found = [(escaped(repo), plain(doc), "".join(texts)) for (doc, repo), texts in files.items()]
    return sorted((repo, doc, len(b := text.encode()), text.count("\n"), hashlib.sha256(b).hexdigest(), "txt") for repo, doc, text in found)


def test_corpus_files_are_written_without_a_folder_or_checksum_each(spark, tmp_path, monkeypatch):
    """On a local disk a document is one file and nothing else: odd names, repeated ids, nulls and empty texts too."""
    import catalog.whole

    root = tmp_path / "made" / "corpus"
    monkeypatch.setattr(catalog.whole, "scratch_path", lambda session, name: f"file://{root}")
    assert read_as_corpus(spark, tmp_path) == corpus_rows()
    made = [p for p in root.rglob("*") if p.is_file()]
    assert len(made) == len({x[:2] for x in ODD_FILES}) and all(p.parent.parent == root and p.suffix == ".txt" for p in made)


def test_corpus_files_in_another_store_are_the_same_rows(spark, tmp_path, monkeypatch):
    """A store that isn't a mounted disk is written by Spark's writer."""
    import catalog.whole
    from corpusloom.sources import files as SF

    (tmp_path / "made").mkdir()
    conf, name = spark.sparkContext._jsc.hadoopConfiguration(), "fs.viewfs.mounttable.corpus.link./made"
    conf.set(name, f"file://{tmp_path}/made")
    try:
        monkeypatch.setattr(catalog.whole, "scratch_path", lambda session, name: "viewfs://corpus/made/one")
        assert SF.mounted(spark, "viewfs://corpus/made/one") is None and SF.mounted(spark, f"{tmp_path}/a b%20") == f"{tmp_path}/a b%20"
        assert read_as_corpus(spark, tmp_path) == corpus_rows()
    finally:
        conf.unset(name)


def test_an_empty_table_is_an_empty_corpus(spark, tmp_path):
    documents(spark, 0).write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["s1_read_corpus_files"](spark, str(tmp_path)).count() == 0


def test_corpus_is_read_in_few_tasks(spark, tmp_path):
    """Many files: few tasks read them, all of them."""
    from corpusloom.sources import files as SF

    (tmp_path / "r").mkdir()
    most = SF.FILE_TASKS * spark.sparkContext.defaultParallelism
    for k in range(most + 10):
        (tmp_path / "r" / f"{k}.txt").write_text("x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = SF.read_corpus(spark, str(tmp_path), "*.txt")
        assert found.rdd.getNumPartitions() == most and found.count() == most + 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_members_of_one_side_go_before_anything_else(spark, monkeypatch):
    """The rows that are cut and sent on are those of members that both sides have."""
    from corpusloom.operators import overlap as O

    cut = []
    monkeypatch.setattr(O, "cut_lineage", lambda df: cut.append(df.count()) or df)
    left = spark.createDataFrame([("g", f"c{k}", k, m) for k in range(20) for m in (f"own{k}", "both", "hot")], "grp string, id string, at int, member string")
    right = spark.createDataFrame([("g", n, 30 - n, m) for n in range(1, 4) for m in ("both", "hot", f"other{n}")], "grp string, number bigint, at int, member string")
    left, right = (df.withColumn("at", df["at"].cast("timestamp")) for df in (left, right))
    found = {r["id"]: (r["number"], r["overlap"]) for r in O.most_shared(left, right, hot_pairs=59).collect()}
    assert found == {f"c{k}": (3, 2) for k in range(20)}
    assert max(cut) == 40


def history_frames(spark, path):
    """300 decisions a day apart or five, of three repositories, some of them twice; a third touches a file of no name."""
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, id + CASE WHEN id % 7 < 3 THEN 0 ELSE 5 * (id DIV 7) END)"
    decided = spark.range(300).selectExpr(
        "'r' || id % 3 AS repo", "'h' || id AS hash", f"CASE WHEN id % 50 = 49 THEN NULL ELSE {at} END AS ts", "'change part ' || id % 11 || ' Part' AS subject", "'x' AS reason")
    decided = decided.unionByName(decided.filter("hash LIKE '%1'"))
    files = spark.range(1200).selectExpr(
        "CASE WHEN id % 90 = 7 THEN NULL ELSE 'r' || (id % 300) % 3 END AS repo", "'h' || id % 300 AS hash",
        "CASE WHEN id % 3 = 0 AND id % 4 = 1 THEN NULL WHEN id % 10 = 0 THEN 'hot' ELSE 'f' || (id * 7) % 60 END AS path")
    files.write.parquet(path)
    return decided, spark.read.parquet(path)


def analysed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_session_links_agree_with_a_plain_search(spark, tmp_path):
    """Files that many sessions touch, files without a name and rows that come twice."""
    from collections import defaultdict

    from corpusloom.operators import history as H

    decided, files = history_frames(spark, str(tmp_path / "files"))
    sessions = H.decision_sessions(decided)
    rows = sessions.collect()
    of, since = defaultdict(set), {}
    for r in rows:
        of[r["repo"], r["hash"]].add(r["session"])
        key = r["repo"], r["session"]
        since[key] = min(since.get(key, r["ts"]), r["ts"])
    at = defaultdict(set)
    for r in files.collect():
        if r["path"] is not None:
            at[r["repo"], r["path"]] |= of.get((r["repo"], r["hash"]), set())
    want = defaultdict(int)
    for (repo, _), found in at.items():
        order = sorted(found)
        for v, u in zip(order, order[1:]):
            if since[repo, u] <= since[repo, v] + dt.timedelta(days=30):
                want[repo, u, v] += 1000 // (len(order) - 1)
    links = H.session_links(sessions, files, subject_weight=0)
    assert {(r["repo"], r["u"], r["v"]): r["weight"] for r in links.collect()} == want and len(want) > 20


def test_signs_of_subjects_are_least_values_of_their_words(spark, tmp_path):
    import hashlib

    from corpusloom.operators import history as H

    sessions = H.decision_sessions(history_frames(spark, str(tmp_path / "files"))[0])
    words = {}
    for r in sessions.collect():
        words.setdefault((r["repo"], r["session"]), set()).update(r["subject"].lower().split(" "))
    sign = lambda k, w: int(hashlib.md5(f"{k}:{w}".encode()).hexdigest()[:15], 16)
    signs = H.subject_signs(sessions)
    assert {(r["repo"], r["session"]): r["signs"] for r in signs.collect()} == {s: [min(sign(k, w) for w in ws) for k in range(H.SIGNS)] for s, ws in words.items()}
    # Words are hashed where each different one is a single row.
    hashed = [line for line in analysed(signs).splitlines() if "md5(" in line]
    assert hashed and all("Aggregate [word#" in line for line in hashed)


def test_files_of_commits_are_read_once_for_links(spark, tmp_path):
    from corpusloom.operators import history as H

    decided, files = history_frames(spark, str(tmp_path / "files"))
    assert analysed(H.session_links(H.decision_sessions(decided), files)).count("Relation [") == 1


def test_decisions_and_groups_are_found_once(spark, tmp_path, monkeypatch):
    """Sessions are made from stored decisions, and records are numbered from stored ones."""
    from pyspark.sql import functions as F

    from corpusloom.operators import history as H

    decided, files = history_frames(spark, str(tmp_path / "files"))
    decided.write.parquet(str(tmp_path / "decided"))
    decided = spark.read.parquet(str(tmp_path / "decided"))
    cut, plain = [], H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: cut.append(analysed(df).count("Relation [")) or plain(df))
    groups = H.related_decisions(decided, files)
    assert sum(cut) == 2 and max(cut) == 1  # the decisions, and the files for the links
    assert analysed(H.number_decisions(decided.withColumn("decision_group", F.lit(1)))).count("Relation [") == 0
    assert H.number_decisions(groups).agg(F.sum("commits")).first()[0] == groups.count() == decided.filter("ts IS NOT NULL").count()
