from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import budget as B
from corpusloom.operators import chunks as CH
from corpusloom.operators import filters as P
from corpusloom.operators import sections as SE
from corpusloom.operators import snapshots as SN
from corpusloom.operators import surface as SU
from corpusloom.operators import verification as V
from corpusloom.plans import verbs
from corpusloom.sources import tables as ST
from corpusloom.sources.files import dependency_rows, read_manifests
from fixtures import FLEET, HARBOUR, files_frame, section

README = section("header", ["package.json:1-5"]) + section("features", ["src/berths/handlers.js:1-10"]) + section("arch", ["src/server.js:1-20"])
CODE = [("r", "package.json", '{"name":"t"}'), ("r", "src/berths/handlers.js", "desk.get('/berths', list);\n"), ("r", "src/server.js", "x\n"), ("r", "README.md", README)]


def baseline_of(spark, files):
    docs = P.select_docs(files)
    return verbs.save_after_update(docs, files, F.lit("2024-01-01").cast("timestamp"))


def overall(docs, files, baseline, repos=None):
    return {r["repo"]: (r["overall"], r["current"], r["possibly_stale"], r["stale"]) for r in verbs.check(docs, files, baseline, repos).collect()}


def test_staleness_states(spark):
    files = files_frame(spark, CODE)
    docs = P.select_docs(files)
    none = spark.createDataFrame([], "repo string, ref_path string, sha256 string, saved_at timestamp")
    assert overall(docs, files, none) == {"r": ("slightly-stale", 0, 3, 0)}
    base = baseline_of(spark, files)
    assert base.count() == 3 and overall(docs, files, base) == {"r": ("current", 3, 0, 0)}
    edited = lambda *names: files_frame(spark, [(r, p, c + "// modified\n" if p in names else c) for r, p, c in CODE])
    assert overall(docs, edited("src/berths/handlers.js"), base) == {"r": ("stale", 2, 0, 1)}
    assert overall(docs, edited("src/berths/handlers.js", "src/server.js"), base) == {"r": ("very-stale", 1, 0, 2)}
    plan = verbs.update_plan(docs, edited("src/berths/handlers.js"), base).collect()
    assert [(r["section"], r["writer"], r["changed_refs"]) for r in plan] == [("features", "writer", ["src/berths/handlers.js"])]
    gone = files.filter("path <> 'src/server.js'")
    assert overall(docs, gone, base) == {"r": ("stale", 2, 0, 1)}
    other = files_frame(spark, [("empty", "app.js", "hello\n")])
    assert overall(docs, files, base, files.select("repo").union(other.select("repo")))["empty"] == ("no_docs", 0, 0, 0)


def test_baseline_states_and_gate(spark):
    files = files_frame(spark, CODE)
    refs = SE.section_refs(SE.parse_sections(P.select_docs(files)))
    base = baseline_of(spark, files)
    now = files_frame(spark, [("r", "package.json", '{"name":"t"}'), ("r", "src/server.js", "y\n")])
    partial = base.filter("ref_path <> 'package.json'")
    states = {r["ref_path"]: r["state"] for r in SN.compare_baseline(refs, SN.path_hashes(now), partial).collect()}
    assert states == {"package.json": "new", "src/server.js": "changed", "src/berths/handlers.js": "missing"}
    report = spark.createDataFrame([("a", "stale", 1), ("b", "slightly-stale", 0), ("c", "current", 0), ("d", "very-stale", 3)], "repo string, overall string, stale bigint")
    fails = lambda on: "".join(sorted(r["repo"] for r in P.ci_gate(report, on).filter("fail").collect()))
    assert (fails("stale"), fails("possibly-stale"), fails("never")) == ("ad", "abd", "")


def test_section_parsing_edges(spark):
    text = (
        "<!-- docs:refs:outside.js -->\n<!-- docs:start:a -->\n<!-- docs:refs:lost.js -->\n<!-- docs:start:b -->\n<!-- docs:refs:one.js:1-2, two.js -->\n"
        "<!-- docs:end:a -->\n<!-- docs:refs:src/ -->\n<!-- docs:end:b -->\n<!-- docs:refs:after.js -->\n<!-- docs:start:ab -->\n<!-- docs:end:a -->\n"
        "<!-- docs:start:c -->\n<!-- docs:end:c -->\n<!-- docs:start:open -->\n<!-- docs:refs:x.js -->\n")
    docs = spark.createDataFrame([("r", "README.md", text)], "repo string, doc string, content string")
    found = SE.parse_sections(docs)
    assert {r["section"]: [x["path"] for x in r["refs"]] for r in found.collect()} == {"b": ["one.js", "two.js", "src/"], "c": []}
    assert sorted(r["path"] for r in SE.section_refs(found).collect()) == ["one.js", "src", "two.js"]
    other = docs.withColumn("content", F.lit(section("x", ["a.js"]).replace("docs:", "notes:")))
    assert SE.parse_sections(other).count() == 0 and SE.parse_sections(other, "notes").count() == 1


def test_directory_reference(spark):
    rows = [("r", "README.md", section("s", ["src/routes/"])), ("r", "src/routes/a.js", "1"), ("r", "src/routes/deep/b.js", "2"), ("r", "src/other.js", "3")]
    files = files_frame(spark, rows)
    docs, base = P.select_docs(files), baseline_of(spark, files)
    assert [r["ref_path"] for r in base.collect()] == ["src/routes"]
    assert overall(docs, files, base)["r"][0] == "current"
    changed = files_frame(spark, [(r, p, c + "!" if p.endswith("b.js") else c) for r, p, c in rows])
    outside = files_frame(spark, [(r, p, c + "!" if p.endswith("other.js") else c) for r, p, c in rows])
    swapped = files_frame(spark, [(r, p, {"1": "2", "2": "1"}.get(c, c)) for r, p, c in rows])
    assert overall(docs, changed, base)["r"][0] == "very-stale" and overall(docs, outside, base)["r"][0] == "current"
    assert overall(docs, swapped, base)["r"][0] == "very-stale"


def test_saved_baseline_keeps_the_newest(spark, tmp_path):
    files = files_frame(spark, CODE)
    refs = SE.section_refs(SE.parse_sections(P.select_docs(files)))
    path = str(tmp_path / "baseline")
    ST.save_baseline(refs, files, path, F.lit("2024-01-01").cast("timestamp"))
    changed = files_frame(spark, [(r, p, c + "!") for r, p, c in CODE])
    ST.save_baseline(refs, changed, path, F.lit("2024-02-01").cast("timestamp"))
    assert overall(P.select_docs(files), changed, ST.read_baseline(spark, path))["r"][0] == "current"
    assert overall(P.select_docs(files), files, ST.read_baseline(spark, path, F.lit("2024-01-15").cast("timestamp")))["r"][0] == "current"


@pytest.mark.parametrize("n, pieces", [(1, [1]), (50, [50]), (51, [50, 1]), (101, [50, 50, 1])])
def test_chunk_sizes(spark, n, pieces):
    files = files_frame(spark, [("r", f"src/f{i:03}.js", "x\n" * 7) for i in range(n)] + [("r", "src/lib/index.js", "x\n"), ("r", "index.js", "x\n")])
    entries = spark.createDataFrame([("r", "src/lib/index.js")], "repo string, path string")
    chunks = CH.chunk_totals(CH.index_chunks(CH.assign_chunks(files, entries))).orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert chunks[0]["name"] == "entry-points" and chunks[0]["files"] == ["src/lib/index.js"]
    assert chunks[1]["name"] == "." and chunks[1]["files"] == ["index.js"]
    assert [c["n_files"] for c in chunks[2:]] == pieces and [c["name"] for c in chunks[2:]] == ["src"] + [f"src-{i + 3}" for i in range(len(pieces) - 1)]
    assert sorted(f for c in chunks for f in c["files"]) == sorted(r["path"] for r in files.collect())
    assert chunks[2]["est_tokens"] == pieces[0] * 7 * 400 // 35


def test_budget(spark):
    files = spark.createDataFrame([("r", f"f{i}", 100) for i in range(60)] + [("r", "big", 501)], "repo string, path string, n_lines int")
    langs = spark.createDataFrame([("r", ["python", "javascript"])], "repo string, languages array<string>")
    row = CH.estimate_budget(files, langs, "frugal").first()
    base = 6501 * 400 // 35
    assert row["passes"]["analysis"] == base * 40 // 100 + 3000 and row["passes"]["review"] == 0 and row["chunks"] == 2 and row["oversized"] == 1
    assert row["total"] == base * 40 // 100 + 12000 and row["decision"] == "SILENT"
    decide = lambda total, *a, **k: spark.range(1).select(B.budget_decision(F.lit(total), *a, **k).alias("d")).first()["d"]
    assert [decide(t, "frugal") for t in (50000, 50001, 100000, 100001)] == ["SILENT", "WARN", "WARN", "ABORT"]
    assert [decide(t) for t in (150000, 150001, 10**9)] == ["SILENT", "WARN", "WARN"]
    assert decide(60000, "frugal", warn=70000) == "SILENT" and decide(60001, budget=60000) == "ABORT" and decide(200000, budget=200000) == "SILENT"


def test_code_surface_of_the_harbour(spark):
    files = files_frame(spark, HARBOUR)
    found = SU.endpoints(files)
    assert SU.family_total(SU.endpoint_counts(files), "endpoints").first()["endpoints"] == 6
    assert {r["method"]: r["endpoints"] for r in SU.route_methods(found).collect()} == {"GET": 3, "PATCH": 1, "POST": 1, "DELETE": 1, "TOTAL": 6}
    auth = {(r["path"], r["route"]): r["auth"] for r in found.collect()}
    assert auth["src/berths/handlers.js", "/berths/:pier"] is True and auth["src/tides.js", "/readings"] is None
    assert {r["resource"] for r in found.collect()} == {"ping", "berths", "readings"}
    loose = SU.family_total(SU.endpoint_counts(files, "reference"), "endpoints").first()["endpoints"]
    assert loose == 7
    assert SU.family_total(SU.export_counts(files), "exports").first()["exports"] == 4
    assert {r["name"] for r in SU.exports(files).collect()} == {"port", "berths", "tides", "requireAuth"}
    refs = spark.createDataFrame([("harbour", "src/berths")], "repo string, path string")
    assert sorted(r["path"] for r in SU.doc_gaps(files, refs).collect()) == ["src/guards/badge.js", "src/server.js", "src/tides.js"]
    engine = files_frame(spark, [(r, p.removeprefix("modules/engine/"), c) for r, p, c in FLEET if "modules/engine" in p])
    assert SU.family_total(SU.endpoint_counts(engine), "endpoints").first()["endpoints"] == 2


def test_coverage_of_documented_and_empty_projects(spark):
    files = files_frame(spark, [("d", "src/moon.js", "sky.get('/moon', phase); module.exports = sky;\n"), ("e", "notes.txt", "x\n")])
    docs = spark.createDataFrame([("d", "README.md", section("sky", ["src/moon.js:1-10"], "GET /moon - Phase of the moon"))], "repo string, doc string, content string")
    rows = {r["repo"]: r for r in SU.coverage_report(SU.entity_inventory(files, docs, SE.document_refs(docs))).collect()}
    d, e = rows["d"], rows["e"]
    assert (d["documented_files"], d["documented_endpoints"], d["entities"], d["file_coverage"], d["endpoint_coverage"], d["entity_coverage"]) == (1, 1, 2, "100.0", "100.0", "100.0")
    assert (e["files"], e["entities"], e["file_coverage"], e["endpoint_coverage"], e["entity_coverage"]) == (0, 0, "0.0", "N/A", "0.0")


def test_verification(spark):
    files = files_frame(spark, HARBOUR)
    text = (
        "# Harbour\n" + section("features", ["src/berths/handlers.js:1-9,src/tides.js:1-4"], "Bookings with 5 API endpoints and 9 routes")
        + section("installation", ["package.json:1-5"], "npm ci") + "Entry `src/server.js` uses Fastify 4, Vue 3 and not src/none.js. Fastify 5\n")
    docs = spark.createDataFrame([("harbour", "README.md", text)], "repo string, doc string, content string")
    checks, quality = verbs.verify_docs(docs, files, dependency_rows(read_manifests(files)))
    failed = sorted((r["type"], r["claim"]) for r in checks.filter("not passed").collect())
    assert failed == [("dep_version", "fastify 5"), ("endpoint_count", "9 endpoints"), ("file_exists", "src/none.js")]
    row = quality.first()
    # 4 mentioned paths, 3 anchors, 2 counts, 3 versions; two of the five sections that such a project is expected to have.
    assert (row["checks"], row["passed"], row["refs"]) == (12, 9, 2)
    assert str(row["accuracy"]) == "0.75" and str(row["coverage"]) == "0.40" and row["overall"] == (75 * 50 + 40 * 35 + 1500) // 100 and row["needs_fix"]


def test_endpoint_claim_tolerance(spark):
    docs = spark.createDataFrame([("a", "d", "10 endpoints, 8 apis, 7 routes"), ("b", "d", "99 endpoints")], "repo string, doc string, content string")
    counts = spark.createDataFrame([("a", 10), ("b", 0)], "repo string, endpoints bigint")
    assert sorted((r["repo"], r["claim"], r["passed"]) for r in V.check_endpoint_counts(docs, counts).collect()) == [
        ("a", "10 endpoints", True), ("a", "7 endpoints", False), ("a", "8 endpoints", True), ("b", "99 endpoints", True)]


def test_hashes_of_wanted_paths_and_of_a_manifest(spark):
    files = files_frame(spark, [("r", f"src/{d}/f{k}.js", f"{d}{k}\n") for d in ("a", "b") for k in range(3)])
    wanted = spark.createDataFrame([("r", "src/a"), ("r", "src/b/f1.js")], "repo string, path string")
    hashes = lambda df, w=None: {r["path"]: r["sha256"] for r in SN.path_hashes(df, w).collect()}
    every = hashes(files)
    assert hashes(files, wanted) == {p: every[p] for p in ("src/a", "src/b/f1.js")}
    manifest = SN.file_hashes(files)
    assert "content" not in manifest.columns and hashes(manifest) == every


def test_a_hash_state_follows_changes(spark):
    rows = {f"src/{d}/f{k}.js": f"{d}{k}\n" for d in ("a", "b", "c/d") for k in range(4)} | {"top.md": "x\n"}
    now = rows | {"src/a/f1.js": "new\n", "src/e/n.js": "added\n", "src/b/f0.js": "b0\n"}
    gone = ["src/c/d/f0.js", "src/c/d/f1.js", "src/c/d/f2.js", "src/c/d/f3.js", "never.js"]
    for p in gone[:4]:
        del now[p]
    some = [("src/a/f1.js", "new\n"), ("src/e/n.js", "added\n"), ("src/b/f0.js", "b0\n"), *[(p, None) for p in gone]]
    changes = spark.createDataFrame([("r", p, c) for p, c in some], "repo string, path string, content string")
    frame = lambda files: files_frame(spark, [("r", p, c) for p, c in files.items()] + [("s", "src/a/f1.js", "other\n")])
    state = SN.apply_changes(SN.hash_state(frame(rows)), changes)
    assert sorted(map(tuple, state.select(*SN.hash_state(frame(now)).columns).collect())) == sorted(map(tuple, SN.hash_state(frame(now)).collect()))
    assert sorted(map(tuple, SN.state_hashes(state).collect())) == sorted(map(tuple, SN.path_hashes(frame(now)).collect()))


def test_only_cited_contents_are_hashed(spark):
    files = files_frame(spark, [("r", f"src/{d}/f{k}.js", f"{d}{k}\n") for d in ("a", "b") for k in range(3)])
    refs = spark.createDataFrame([("r", "src/a"), ("r", "src/b/f1.js"), ("r", "gone.js")], "repo string, path string")
    assert {r["path"] for r in SN.cited_files(files, refs).collect()} == {"src/a/f0.js", "src/a/f1.js", "src/a/f2.js", "src/b/f1.js"}
    docs = spark.createDataFrame([("r", "d.md", "<!-- docs:start:s -->\n<!-- docs:refs:src/a/ -->\n<!-- docs:end:s -->")], "repo string, doc string, content string")
    saved = spark.createDataFrame([], "repo string, ref_path string, sha256 string, saved_at timestamp")
    depth = lambda line: len(re.match(r"[ :+-]*", line).group())
    for df in (SN.path_hashes(files, refs), SN.dir_hash(refs, files), verbs.check(docs, files, saved), verbs.update_plan(docs, files, saved)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        hashed = [k for k, line in enumerate(plan) if "sha2(cast(content" in line]
        assert hashed
        for k in hashed:  # below the hash, contents stand on the left of a semi-join
            below = next(line for line in plan[k + 1 :] if "Join" in line)
            assert "LeftSemi" in below and depth(below) > depth(plan[k])


def test_documents_are_read_once_to_verify_them(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("r", "d", "## Usage\n3 endpoints, Express 4, src/a.js\n<!-- docs:refs:src/a.js,gone/ -->"), ("r", "none", "")], "repo string, doc string, content string").write.parquet(path)
    files = files_frame(spark, [("r", "src/a.js", "x\n"), ("r", "package.json", "{}")])
    deps = spark.createDataFrame([("r", "package.json", "npm", "express", "^5.0.0", False)], "repo string, path string, kind string, dep string, version string, is_dev boolean")
    checks, quality = verbs.verify_docs(spark.read.parquet(path), files, deps)
    for df in (checks, quality):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {(r["type"], r["claim"], r["actual"], r["passed"]) for r in checks.collect()} == {
        ("file_exists", "src/a.js", "exists", True), ("ref_anchor", "src/a.js", "exists", True), ("ref_anchor", "gone", "missing", False),
        ("endpoint_count", "3 endpoints", "0", True), ("dep_version", "express 4", "5", False)}
    found = {r["doc"]: (r["checks"], r["passed"], r["refs"], r["needs_fix"]) for r in quality.collect()}
    assert found == {"d": (5, 3, 1, True), "none": (0, 0, 0, False)}
