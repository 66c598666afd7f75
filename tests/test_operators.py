"""Core operators on small inputs: hard cases, round trips and brute force."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftgrain.functions import paths, text
from siftgrain.functions.keys import norm_hash, norm_id, norm_path
from siftgrain.operators import code, evidence, graph, jsonops, lexical, orphans, snapshots, versions
from siftgrain.plans import matchquery
from siftgrain.sources import discovery, manifests
from siftgrain.streaming import changefeed

T = dt.datetime(2025, 1, 1)
at = lambda h: T + dt.timedelta(hours=h)
MANIFEST = "manifest_id string, repository_id string, module_root string, captured_at timestamp_ntz, received_at timestamp_ntz, path string"
ENTRY = "manifest_id string, repo_relative string, content_hash string, received_at timestamp_ntz, hash string"


def test_keys(spark):
    rows = [(" {ABC-1} ", "./a//b/./c\\d", " SHA256:AbC "), ("urn:uuid:abc-1", "/a/b/c/d", "abc"), (None, None, None), ("", "", "")]
    got = spark.createDataFrame(rows, "i string, p string, h string").select(norm_id(F.col("i")), norm_path(F.col("p")), norm_hash(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("abc-1", "a/b/c/d", "abc"), ("abc-1", "a/b/c/d", "abc"), (None, None, None), ("", "", "")]


def test_snapshot_cases(spark):
    m = spark.createDataFrame([(f"m{i}", "r", "x", at(i), at(9 - i), "clash") for i in range(1, 6)] + [("m2", "r", "x", at(2), at(20), "clash"), ("n1", None, None, at(1), at(1), None), (None, "r", "x", at(1), at(1), None)], MANIFEST)
    e = spark.createDataFrame([
        ("m1", "a", "h1", at(1), ""), ("m1", "./a", "H1", at(2), ""), ("m1", "b", None, at(1), ""), ("m1", "c", "sha256:h3", at(1), ""),
        ("m2", "a", None, at(1), ""), ("m2", "b", "h2", at(1), ""), ("m2", "c", "H3", at(1), ""),
        ("m4", "a", "h1", at(1), ""), ("m4", "b", "h9", at(1), ""), ("m5", "a", "h5", at(1), ""), ("m5", "b", "h9", at(1), ""), ("m5", None, "h", at(1), ""), ("zz", "q", "h", at(1), ""), ("n1", "a", "h", at(1), ""),
    ], ENTRY)
    got = sorted(map(tuple, snapshots.snapshot_changes(m, e).collect()))
    assert got == sorted([
        ("m3", "a", "removed"), ("m3", "b", "removed"), ("m3", "c", "removed"), ("m4", "a", "added"), ("m4", "b", "added"), ("m5", "a", "changed"),
    ])
    assert snapshots.snapshot_changes(m.limit(0), e).count() == 0 and snapshots.snapshot_changes(m, e.limit(0)).count() == 0


def test_snapshot_equals_brute_force(spark):
    rng = random.Random(5)
    states = [{f"p{i}": rng.choice("xyz") for i in range(12) if rng.random() < 0.6} for _ in range(15)]
    m = spark.createDataFrame([(f"m{i:02}", "r", "x", at(i), at(i), "") for i in range(15)], MANIFEST)
    e = spark.createDataFrame([(f"m{i:02}", p, h, at(i), "") for i, s in enumerate(states) for p, h in s.items()], ENTRY)
    want = set()
    for i in range(1, 15):
        a, b = states[i - 1], states[i]
        want |= {(f"m{i:02}", p, "added") for p in b.keys() - a.keys()} | {(f"m{i:02}", p, "removed") for p in a.keys() - b.keys()} | {(f"m{i:02}", p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    assert {tuple(r) for r in snapshots.snapshot_changes(m, e).collect()} == want


REF = "ref_table string, row_key string, key string, ref_first timestamp_ntz"
PARENT = "ref_table string, key string, parent_first timestamp_ntz, deleted boolean"


def test_orphan_cases(spark):
    refs = spark.createDataFrame([("t", "1", "a", at(5)), ("t", "2", "b", at(5)), ("t", "3", "c", at(5)), ("t", "4", "d", at(5)), ("t", "5", "a", None), ("t", "6", "late", at(1)), ("t", "7", "late", at(3000)), ("t", "8", None, at(1)), ("u", "9", "a", at(5))], REF)
    parents = spark.createDataFrame([("t", "a", at(4), False), ("t", "b", at(4), True), ("t", "c", at(6), False), ("t", "late", at(2000), False), ("t", "d", None, False)], PARENT)
    got = sorted((r.row_key, r.orphan_kind) for r in orphans.orphan_references(refs, parents, 3).collect())
    assert got == [("2", "deleted"), ("3", "late"), ("6", "late"), ("9", "missing")]
    assert orphans.orphan_references(refs.limit(0), parents).count() == 0
    assert {r.orphan_kind for r in orphans.orphan_references(refs, parents.limit(0)).collect()} == {"missing"}


def test_corpus_orphans(spark):
    clash = dict.fromkeys(("repo", "case_sensitive", "key", "deleted", "span"))
    with_clash = lambda df: df.withColumns({c: F.lit("x") for c in clash if c not in df.columns})
    o = with_clash(spark.createDataFrame([
        ("O1", "r1", "s1", "a/B.py", "present", 1, at(1)), ("O1", "r1", "s1", "a/B.py", "present", 1, at(9)), ("O2", "r2", " {S2}", "a/b.py", "present", 1, at(1)), ("O3", "r2", None, "a/b.py", "deleted", 2, at(2)), ("O4", None, "zz", None, None, None, None),
    ], "id string, repository_id string, source_revision_id string, path string, existence_state string, occurrence_seq bigint, received_at timestamp_ntz"))
    u = with_clash(spark.createDataFrame([("u1", "urn:uuid:o1", at(2)), ("u2", "o9", at(2)), ("u3", "O3", at(5)), ("u4", None, at(1)), ("u5", "o1", at(0)), ("u5", "o1", at(7))], "id string, file_occurrence_id string, received_at timestamp_ntz"))
    c = with_clash(spark.createDataFrame([
        ("c", 1, "EXISTING_REF", "r1", "./A/b.PY", at(3)), ("c", 2, "EXISTING_REF", "r2", "A/b.py", at(3)), ("c", 3, "TARGET_MODIFY", "r2", "a\\b.py", at(3)), ("c", 4, "ALLOW_GLOB", "r2", "q", at(3)), ("c", 5, "EXISTING_REF", "r2", None, at(3)), ("c", 6, "EXISTING_REF", None, "a/b.py", at(3)),
    ], "run_id string, ordinal int, citation_kind string, repository_id string, cited_path string, received_at timestamp_ntz"))
    r = spark.createDataFrame([("r1", False), ("r2", True)], "id string, case_sensitive boolean")
    v = spark.createDataFrame([("s1", at(0)), ("s2", at(5))], "id string, received_at timestamp_ntz")
    got = orphans.orphan_references(orphans.corpus_references(u, o, c, r), orphans.corpus_parents(o, v, r), 2)
    assert sorted((x.ref_table, x.row_key, x.orphan_kind) for x in got.collect()) == [
        ("file_occurrences", "O2", "late"), ("file_occurrences", "O4", "missing"), ("retrieval_units", "u2", "missing"), ("retrieval_units", "u3", "deleted"), ("retrieval_units", "u5", "late"),
        ("spec_citations", "c#2", "missing"), ("spec_citations", "c#3", "deleted"), ("spec_citations", "c#6", "missing"),
    ]


def test_orphans_equal_brute_force(spark):
    rng = random.Random(6)
    parents = {f"k{i}": (at(rng.randint(0, 4000)), rng.random() < 0.1) for i in range(300)}
    refs = [("t", str(i), "k0" if i % 3 == 0 else f"k{rng.randint(0, 400)}", at(rng.randint(0, 4000))) for i in range(3000)]
    want = {(r, "missing" if k not in parents else "deleted" if parents[k][1] else "late") for _, r, k, t in refs if k not in parents or parents[k][1] or parents[k][0] > t}
    got = orphans.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame([("t", k, *v) for k, v in parents.items()], PARENT), 4)
    assert {(r.row_key, r.orphan_kind) for r in got.collect()} == want
    assert sum(r.n_orphans for r in orphans.orphan_report(got).collect()) == len(want)


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("a/c.py",), ("a.py",), ("ab/x.py",)], "p string")
    names = lambda c: sorted(r.p for r in df.where(c).collect())
    assert names(paths.in_scope(F.col("p"), glob="a/*.py")) == ["a/b/c.py", "a/c.py"]
    assert names(F.col("p").rlike(text.glob_regex("a/*.py", False))) == ["a/c.py"]
    assert names(F.col("p").rlike(text.glob_regex("**/*.py", False))) == ["a.py", "a/b/c.py", "a/c.py", "ab/x.py"]
    assert names(paths.in_scope(F.col("p"), prefix="a")) == ["a/b/c.py", "a/c.py"]
    assert names(paths.ends_with_path(F.col("p"), "c.py")) == ["a/b/c.py", "a/c.py"]


@pytest.mark.parametrize("bad", ["", "AND", "a AND", "(a", "a)", "NOT", '""'])
def test_bad_match_queries(bad):
    with pytest.raises(matchquery.MatchQueryError):
        matchquery.parse(bad)


def test_match_queries(spark):
    df = spark.createDataFrame([(1, "fn hello_world() {}"), (2, "hello big world"), (3, "world"), (4, None)], "i int, t string").withColumn("tokens", text.tokens(F.col("t")))
    hits = lambda q, how="or": sorted(r.i for r in df.where(matchquery.predicate(matchquery.parse(q, how), F.col("tokens"))).collect())
    assert hits("hello_world") == [1] and hits('"hello world"') == [1]
    assert hits("hello world") == [1, 2, 3] and hits("hello world", "and") == [1, 2]
    assert hits("world AND NOT hello") == [3] and hits("(big OR fn) AND world") == [1, 2] and hits("fn OR big AND world") == [1, 2]


def test_filter_comes_before_limit(spark):
    rows = [(f"u{i:04}", "r", "out/x", "journal " * 9, "CURRENT") for i in range(300)] + [("in1", "r", "in/x", "journal and more words", "CURRENT")]
    df = spark.createDataFrame(rows, "unit_id string, repository_id string, path string, text string, freshness_state string")
    assert [r.unit_id for r in lexical.search(df, "journal", 10, paths.in_scope(F.col("path"), prefix="in")).collect()] == ["in1"]


def test_pack_lines(spark):
    body = "\n".join("x" * n for n in (3, 4, 20, 1, 1, 1, 0))
    got = spark.createDataFrame([(body,), ("",)], "t string").select(lexical.pack_lines(F.col("t"), 10).alias("c")).collect()
    assert [(c.first, c.n) for c in got[0].c] == [(0, 2), (2, 1), (3, 4)] and [(c.first, c.n) for c in got[1].c] == [(0, 1)]


def test_snippet_and_tokens(spark):
    r = spark.createDataFrame([("a\nb\nfoo bar\nc\nfoo", "Ärger_Über-x1")], "t string, u string").select(lexical.focused_snippet(F.col("t"), ["foo", "bar"]), text.tokens(F.col("u")), text.tokens(F.col("u"), fold=True)).head()
    assert r[0] == "b\nfoo bar\nc" and r[1] == ["ärger", "über", "x1"] and r[2] == ["arger", "uber", "x1"]


def test_publish(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    versions.publish(spark.range(3), root, "g1")
    versions.publish(spark.range(5), root, "g2")
    assert versions.published(spark, root).count() == 5


def test_incremental_equals_full(spark):
    base = spark.createDataFrame([(i, i % 3) for i in range(20)], "k int, v int")
    change = spark.createDataFrame([(3, 9), (40, 1)], "k int, v int")
    full = {(r.k, r.v) for r in versions.upsert(base, change, ["k"]).collect()}
    parts = versions.delete_where(base, change, ["k"]).union(change)
    assert full == {(r.k, r.v) for r in parts.collect()}
    assert versions.insert_or_ignore(base, change, ["k"]).where("k = 3").head().v == 0


def test_graph_waves(spark):
    e = spark.createDataFrame([("c", "m"), ("m", "p"), ("x", "y"), ("y", "x"), ("x", "p")], "source string, target string")
    got = {r.node: (r.component, r.wave) for r in graph.waves(e).collect()}
    assert got == {"p": ("p", 1), "m": ("m", 2), "c": ("c", 3), "x": ("x", 2), "y": ("x", 2)}


def test_impact_takes_first_shortest(spark):
    e = spark.createDataFrame([("b", "a", "e1", 0.9, True), ("c", "b", "e2", 0.5, False), ("d", "a", "e3", 0.8, True), ("c", "d", "e0", 0.7, True), ("a", "c", "e9", 0.1, True)], "source string, target string, edge_id string, confidence double, resolved boolean")
    got = {r.node: (r.depth, r.path, r.min_confidence, r.level) for r in graph.impact(e, spark.createDataFrame([("a",)], "node string"), 4).collect()}
    assert got == {"b": (1, ["e1"], 0.9, "DIRECT_RESOLVED"), "d": (1, ["e3"], 0.8, "DIRECT_RESOLVED"), "c": (2, ["e1", "e2"], 0.5, "POSSIBLE_INFERRED")}


def test_providers(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")], "repository_id string, name string")
    p = spark.createDataFrame([("b", "x"), ("c", "y"), ("d", "y"), ("a", "z")], "repository_id string, name string")
    got = {(r.consumer, r.name): (r.status, r.provider) for r in graph.resolve_providers(d, p).collect()}
    assert got == {("a", "x"): ("resolved", "b"), ("a", "y"): ("ambiguous", None), ("a", "z"): ("missing", None), ("b", "x"): ("missing", None)}


def test_context_budget_skips_but_goes_on(spark):
    df = spark.createDataFrame([("q", "a", 50, 1), ("q", "b", 60, 2), ("q", "c", 40, 3), ("q", "d", 20, 4)], "q string, id string, size int, n int")
    assert sorted(r.id for r in evidence.within_budget(df, ["q"], "size", 100, ["n"]).collect()) == ["a", "c"]


def test_claims_and_conflicts(spark):
    ev = spark.createDataFrame([("1", "CURRENT"), ("2", "STALE"), ("3", "INVALID")], "id string, freshness_state string")
    cl = spark.createDataFrame([("a", ["1"]), ("b", ["1", "2"]), ("c", ["1", "3"]), ("d", ["9"]), ("e", [])], "claim_id string, evidence_ids array<string>")
    got = {r.claim_id: r.status for r in evidence.verify_claims(cl, ev).collect()}
    assert got == {"a": "SUPPORTED", "b": "WITH_DISCLOSURE", "c": "REJECTED", "d": "REJECTED", "e": "REJECTED"}
    rows = spark.createDataFrame([("k", "1", 1, "x"), ("k", "2", 2, "x"), ("k", "3", 3, "y")], "k string, id string, n int, v string")
    assert [tuple(r) for r in evidence.adjacent_conflicts(rows, ["k"], "v", ["n"]).collect()] == [("k", "2", "3")]


def test_quality(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "z", 1)], "query_id string, item string, place int")
    rel = spark.createDataFrame([("q", "b", 3), ("q", "a", 2)], "query_id string, item string, rel int")
    got = {r.query_id: r for r in evidence.quality(ranked, rel, 5).collect()}
    assert got["q"].recall_at_k == 1 and got["q"].reciprocal_rank == 0.5 and round(got["q"].ndcg_at_k, 4) == round((2 + 3 / 1.5849625) / (3 + 2 / 1.5849625), 4) and got["r"].ndcg_at_k == 0


FILES = {
    "go.mod": ("module a.b/c\nrequire (\n\tx.y/z v1.2 // why\n)\nreplace q => ../q\n", {("provides", "a.b/c", None), ("declares", "x.y/z", "External"), ("declares", "q", "LocalPath")}),
    "package.json": ('{"name": "n", "dependencies": {"a": "^1", "b": "file:../b"}, "workspaces": ["w/*"]}', {("provides", "n", None), ("declares", "a", "External"), ("declares", "b", "LocalPath"), ("declares", "w/*", "WorkspaceMember")}),
    "pom.xml": ("<project xmlns='x'><groupId>g</groupId><artifactId>a</artifactId><modules><module>m</module></modules><dependencies><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency><dependency><groupId>${v}</groupId><artifactId>b</artifactId></dependency></dependencies></project>", {("provides", "g:a", None), ("declares", "h:b", "External"), ("declares", "m", "WorkspaceMember"), ("diagnostic", "${v}:b", "incomplete")}),
    "settings.gradle": ("rootProject.name = 'r'\ninclude ':a:b', 'c'\n", {("provides", "r", None), ("declares", ":a:b", "WorkspaceMember"), ("declares", "c", "WorkspaceMember")}),
    "build.gradle.kts": ('dependencies {\n  implementation("g:a:1.0") {\n    exclude("x")\n  }\n  api(project(":lib:core"))\n}\n', {("declares", "g:a", "External"), ("declares", "lib:core", "LocalPath")}),
    "pyproject.toml": ('[project]\nname = "My_Pkg"\ndependencies = ["a[x]>=1", "B.c"]\n', {("provides", "my-pkg", None), ("declares", "a", "External"), ("declares", "b-c", "External")}),
    "requirements-dev.txt": ("# c\n-r base.txt\na==1 # x\n-e ../lib\n", {("declares", "a", "External"), ("declares", "path:../lib", "LocalPath")}),
    ".gitmodules": ('[submodule "s"]\n  path = third/s\n  url = u\n', {("declares", "s", "LocalPath")}),
    "a.proto": ('import public "x/y.proto";\n', {("declares", "x/y.proto", "External")}),
    "MANIFEST.MF": ('Bundle-SymbolicName: s;x=1\nExport-Package: p.q;version="1,2",p.\n r\nImport-Package: i.j;version="[1,2)"\n', {("provides", "s", None), ("provides", "p.q", None), ("provides", "p.r", None), ("declares", "i.j", "External")}),
    "package.json ": ("", set()),
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_manifest_formats(name):
    body, want = FILES[name]
    assert {(r[0], r[2], r[4]) for r in manifests.parse_manifest("d/" + name, body)} == want


def test_broken_manifest_is_a_diagnostic():
    assert manifests.parse_manifest("package.json", "{")[0][0] == "diagnostic" and manifests.parse_manifest("x.json", "{") == []


def test_component_manifest(spark):
    df = spark.createDataFrame([("r", "apps/s/components/b/.content.xml", '<jcr:root sling:resourceSuperType="/apps/core/x"/>'), ("r", "a.txt", "x")], "repository_id string, path string, content string")
    assert {(r.role, r.name) for r in manifests.scan_manifests(df).collect()} == {("provides", "s/components/b"), ("declares", "core/x")}


def test_scan_tree(spark, tmp_path):
    for name, body in {"a/x.py": "password = 'hunter2hunter2'", "a/.env": "K=1", "node_modules/q.js": "1", "k.pem": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = discovery.scan_tree(spark, str(tmp_path)).withColumn("content", discovery.masked(F.col("content"))).collect()
    assert [(r.path, r.content) for r in rows] == [("a/x.py", "password = '[REDACTED]'")]


def test_code(spark):
    files = spark.createDataFrame([
        ("r", "p/a.py", "import b.c\nfrom .d import e\nclass F:\n    async def g(self): pass\n"), ("r", "p/b/c.py", "x = 1"), ("r", "q/m.ts", 'import { z } from "./n.js";\nexport abstract class K {}\n'), ("r", "q/n.ts", ""), ("r", "d.md", "# A\ntext\n## B c\n"),
    ], "repository_id string, path string, content string")
    assert {(r.kind, r.name, r.line_no) for r in code.symbols(files).collect()} == {("class", "F", 3), ("def", "g", 4), ("class", "K", 2)}
    got = {r.specifier: r.target for r in code.resolve_imports(code.imports(files), files).collect()}
    assert got == {"b.c": "p/b/c.py", ".d": "logical:.d", "./n.js": "q/n.ts"}
    assert [(r.level, r.title) for r in code.headings(files).orderBy("line_no").collect()] == [(1, "A"), (2, "B c")]


def test_json(spark):
    df = spark.createDataFrame([("1", '{"a": [1, {"b/c": null}], "e": {}}'), ("2", '{"e":{},"a":[1,{"b/c":null}]}'), ("3", "{"), ("4", None)], "id string, content string")
    assert [(r.pointer, r.value) for r in jsonops.leaves(df).where("id = '1'").collect()] == [("/a/0", "1"), ("/a/1/b~1c", "null"), ("/e", "{}")]
    assert jsonops.canonical(df).select("canonical_hash").distinct().count() == 1


def run(events, quiet=10, capacity=100, now=1000):
    held = changefeed.Coalescer(quiet, capacity)
    for path, kind, t in events:
        held.fold(path, kind, t)
    return held.drain(now), held


def test_coalescing():
    assert run([("a", "RenamedFrom", 0), ("b", "RenamedTo", 1), ("b", "Removed", 2)])[0] == [("Remove", "a", None), ("Remove", "b", None)]
    assert run([("a", "RenamedFrom", 0), ("b", "RenamedTo", 1), ("b", "Removed", 2), ("b", "Created", 3)])[0] == [("Upsert", "b", None), ("Remove", "a", None)]
    assert run([("a", "RenamedFrom", 0), ("b", "RenamedTo", 1), ("b", "Modified", 2)])[0] == [("Rename", "a", "b")]
    assert run([("a", "Created", 0), ("a", "Removed", 1)])[0] == [] and run([("a", "Removed", 0), ("a", "Created", 1), ("a", "Removed", 2)])[0] == [("Remove", "a", None)]
    out, held = run([("a", "Modified", 0), ("old", "RenamedFrom", 1), ("b", "Modified", 2), ("old2", "RenamedFrom", 3), ("a", "Modified", 4)], capacity=2)
    assert held.overflowed and ("Upsert", "a", None) in out and ("Upsert", "b", None) not in out


def test_stream_equals_batch(spark):
    from oracle import FOLDER

    from siftgrain import registry

    batch = registry.queries()["coalesce_batch"](spark, FOLDER)
    stream = registry.queries()["coalesce_stream"](spark, FOLDER)
    rows = lambda df: {(r.path, r.session_start.isoformat(), r.op, r.n_events) for r in df.collect()}
    b, s = rows(batch), rows(stream)
    assert s <= b and len(b) - len(s) < 50


def test_rename_stream(spark, tmp_path):
    rows = [("r", "a", "RenamedFrom", 0), ("r", "b", "RenamedTo", 1), ("r", "c", "Modified", 500), ("r", "d", "Modified", 5000)]
    schema = "repository_id string, path string, kind string, at_ms bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = changefeed.coalesce_renames(feed, 100).writeStream.format("memory").queryName("renames").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second").start()
    # a run to the available end would go on for ever: a processing-time timeout always wants another batch
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("renames").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {(r.op, r.path, r.new_path) for r in spark.table("renames").collect()}
    assert ("Rename", "a", "b") in got and ("Upsert", "c", None) in got


def test_bitmaps_round_trip():
    for positions in ([], [0], [5, 5, 65535], range(5000), range(0, 65536, 3)):
        packed = orphans.pack_bits(np.array(list(positions), np.int64))
        assert np.flatnonzero(orphans.unpack_bits(packed)).tolist() == sorted(set(positions)) and len(packed) <= 8193


def test_orphans_come_from_the_bitmaps(spark, monkeypatch):
    refs = spark.createDataFrame([("t", "1", "a", dt.datetime(2025, 1, 2))], REF)
    parents = spark.createDataFrame([("t", "b", dt.datetime(2025, 1, 1), False)], PARENT)
    assert orphans.orphan_references(refs, parents).count() == 1
    monkeypatch.setattr(orphans, "_survivors", lambda pdf: pd.DataFrame({"ref_table": pd.Series([], dtype=str), "span": np.zeros(0, np.int32), "code": np.zeros(0, np.int64), "period": np.zeros(0, np.int32), "state": pd.Series([], dtype=str)}))
    assert orphans.orphan_references(refs, parents).count() == 0
