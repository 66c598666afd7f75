"""Version-control metadata, content-repository files, analyzers, reads, publication and governance on small inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from siftgrain.functions.paths import is_contained, normal_path
from siftgrain.operators import aem, analyzers, governance, graph, incremental, index, resolver, routing, versions
from siftgrain.sources import git, reads


def _index(paths):
    body = b""
    for p in paths:
        name = p.encode()
        entry = b"\0" * 60 + struct.pack(">H", len(name)) + name
        body += entry + b"\0" * (8 - len(entry) % 8)
    return b"DIRC" + struct.pack(">II", 2, len(paths)) + body


def test_git(spark, tmp_path):
    data = tmp_path / ".git"
    (data / "refs/heads").mkdir(parents=True)
    (data / "HEAD").write_text("ref: refs/heads/feature/x\n")
    (data / "packed-refs").write_text("# pack-refs\n" + "a" * 40 + " refs/heads/feature/x\n")
    assert git.git_meta(str(tmp_path)) == {"commit_sha": "a" * 40, "branch": "feature/x"}
    (data / "HEAD").write_text("b" * 40)
    assert git.git_meta(str(tmp_path)) == {"commit_sha": "b" * 40, "branch": None}
    assert git.git_meta(str(tmp_path / "none")) == {"commit_sha": None, "branch": None}
    (data / "index").write_bytes(_index(["a.py", "dir/long_name_of_a_file.py"]))
    assert git.tracked_paths(str(tmp_path)) == ["a.py", "dir/long_name_of_a_file.py"]
    files = spark.createDataFrame([("a.py",), ("new.py",)], "path string")
    assert [r.path for r in git.tracked(spark, files, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / "sub/inner/.git").mkdir(parents=True)
    assert git.nested_roots(str(tmp_path)) == ["sub/inner"]


def test_ignore_rules(spark):
    rules = git.ignore_rules("# c\n*.log\n!keep.log\n/build/\ndocs/**/*.tmp\n")
    paths = ["a.log", "x/a.log", "keep.log", "build/o.txt", "x/build/o.txt", "docs/a/b.tmp", "docs/b.tmp", "a.py"]
    gone = F.lit(False)
    for pattern, excludes in rules:
        gone = F.when(F.col("path").rlike(pattern), excludes).otherwise(gone)
    got = {r.path for r in spark.createDataFrame([(p,) for p in paths], "path string").where(gone).collect()}
    assert got == {"a.log", "x/a.log", "build/o.txt", "docs/a/b.tmp", "docs/b.tmp"}


AEM = [
    ("r", "apps/x/components/b/.content.xml", '<jcr:root xmlns:jcr="j" xmlns:sling="s" sling:resourceSuperType="core/b"><items/></jcr:root>'),
    ("r", "apps/x/components/b/b.html", '<sly data-sly-use.m="M" data-sly-include="h.html"/><template data-sly-template.card="${@ x}"></template>'),
    ("r", "apps/x/config.author.prod/com.x.Svc~a.cfg.json", '{"k": 1, "l": "m"}'),
    ("r", "apps/x/clientlibs/site/js.txt", "#base=js\na.js\n\nb.js\n"),
    ("r", "apps/x/components/bad/.content.xml", "<open>"),
    ("r", "apps/x/readme.txt", "x"),
]


def test_aem(spark):
    got = {(r.node_type, r.name) for r in aem.analyze(spark.createDataFrame(AEM, "repository_id string, path string, content string")).collect()}
    assert {("JCR_NODE", "/root/items"), ("SLING_RESOURCE_SUPER_TYPE", "core/b"), ("HTL_USE", "b.html#m"), ("HTL_TEMPLATE", "b.html#card"), ("HTL_INCLUDE", "h.html"), ("OSGI_CONFIG", "com.x.Svc~a"), ("OSGI_RUN_MODE", "author"), ("OSGI_RUN_MODE", "prod"), ("OSGI_PROPERTY", "com.x.Svc#k"), ("CLIENTLIB_FILE", "js/a.js"), ("CLIENTLIB_FILE", "js/b.js")} <= got
    assert sum(k == "DIAGNOSTIC" for k, _ in got) == 1


def test_analyzers_are_chosen_by_capability(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.py", "b.json", "c.md", "d.bin", "apps/x/.content.xml")], "path string")
    assert [r[0] for r in rows.select(analyzers.chosen(F.col("path"))).collect()] == ["structural", "json", "markdown", "text", "aem"]
    with pytest.raises(ValueError):
        analyzers.register(analyzers.REGISTRY["json"])


def test_reads(spark):
    rows = spark.createDataFrame([("a", "x.txt", "abcé" * 3), ("b", ".git/x", "abc"), ("c", "../up.txt", "abc"), ("d", "n.txt", None), ("e", "k.pem", "abc")], "id string, path string, content string")
    got = {(r.id, r.n_bytes, r.truncated, r.text) for r in reads.bounded(rows, 4).collect()}
    assert got == {("a", 3, True, "abc")}
    parts = reads.windows(rows.where("id = 'a'"), 4).orderBy("window_no").collect()
    assert b"".join(bytes(p.data) for p in parts).decode() == "abcé" * 3 and [p.n_bytes for p in parts] == [4, 4, 4, 3]


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b//../c",), ("../x",), ("a/../../x",), ("/abs",), ("a",)], "p string")
    assert [tuple(r) for r in rows.select(normal_path(F.col("p")), is_contained(F.col("p"))).collect()] == [("a/c", True), ("../x", False), ("../x", False), ("abs", False), ("a", True)]


def test_globs_of_any_depth(spark):
    files = spark.createDataFrame([("r", p, p) for p in ("a.py", "x/a.py", "libs/q/x/f.ts", "libs/q/y.ts", "x+y/b.py")], "repository_id string, path string, id string")
    covered = lambda g: {r.id for r in versions.glob_covered(files, spark.createDataFrame([("r", g)], "repository_id string, glob string")).collect()}
    assert covered("**/*.py") == {"a.py", "x/a.py", "x+y/b.py"} and covered("libs/*/x/*") == {"libs/q/x/f.ts"} and covered("?.py") == {"a.py"} and covered("x+y/**") == {"x+y/b.py"} and covered("libs/**") == {"libs/q/x/f.ts", "libs/q/y.ts"}


def test_pointers_are_never_taken_away(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current_generation(spark, root) is None
    assert [versions.publish(spark.range(n), root, f"g{n}") for n in (1, 2, 3)] == [1, 2, 3]
    assert versions.current_generation(spark, root) == "g3" and versions.published(spark, root).count() == 3
    with pytest.raises(Exception):
        versions.publish(spark.range(9), root, "g3")
    assert versions.published(spark, root).count() == 3


def test_citation_blocks(spark):
    docs = [(1, "# t\n```plan\nA r p\n# c\n```\nend"), (2, "none"), (3, "```plan\nx\n```\n```plan\ny\n```"), (4, "```plan\nx")]
    got = {(r.doc_id, r.line, r.error) for r in governance.citation_blocks(spark.createDataFrame(docs, "doc_id int, text string"), "plan").collect()}
    assert (1, "A r p", None) in got and (2, None, "no block") in got and (3, None, "several blocks") in got and (4, None, "open block") in got


def test_status_output(spark):
    rows = [("a", " M x.py\0R  new.py\0old.py\0?? z\0"), ("b", "broken"), ("c", "")]
    got = {(r.source, r.path, r.orig_path, r.error) for r in governance.parse_changes(spark.createDataFrame(rows, "source string, text string"), "status").collect()}
    assert got == {("a", "x.py", None, None), ("a", "new.py", "old.py", None), ("a", "z", None, None), ("b", None, None, "no final NUL")}


def test_index_is_kept_in_step(spark, tmp_path):
    units = spark.createDataFrame([("1", "r", "Größe of alpha beta"), ("2", "r", "alpha gamma"), ("3", "q", "beta alpha beta")], "unit_id string, repository_id string, text string")
    index.build(units, str(tmp_path / "a"), 4)
    changed = spark.createDataFrame([("2", "r", "delta gamma"), ("4", "r", "alpha")], "unit_id string, repository_id string, text string")
    index.refresh(spark, str(tmp_path / "a"), str(tmp_path / "b"), changed, spark.createDataFrame([("3",)], "unit_id string"), 4)
    now = spark.createDataFrame([("1", "r", "Größe of alpha beta"), ("2", "r", "delta gamma"), ("4", "r", "alpha")], "unit_id string, repository_id string, text string")
    index.build(now, str(tmp_path / "c"), 4)
    for query in ("alpha OR gamma", '"alpha beta"', "alpha AND NOT beta", "NOT alpha", "Grosse OR große", "große"):
        found = lambda at: sorted((r.unit_id, r.score) for r in index.score_units(spark, str(tmp_path / at), query, buckets=4).collect())  # noqa: B023, E731
        assert found("b") == found("c"), query
    assert [r.unit_id for r in index.score_units(spark, str(tmp_path / "c"), "NOT alpha", buckets=4).collect()] == ["2"]
    plan = index.read_postings(spark, str(tmp_path / "c"), ["alpha"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_components_and_waves(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("h", "a")], "source string, target string")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}
    assert {r.node: r.wave for r in graph.waves(edges).collect()} == {"f": 1, "g": 1, "d": 2, "e": 2, "a": 3, "b": 3, "c": 3, "h": 4}


def test_resolver(spark):
    scanned = [
        ("c", "m/package.json", "declares", "NPM", "x", None, "External", None), ("c", "m/package.json", "declares", "NPM", "two", None, "External", None), ("c", "m/package.json", "declares", "NPM", "own", None, "External", None),
        ("c", "m/package.json", "declares", "NPM", "loc", None, "LocalPath", "../../P"), ("c", "m/a.proto", "declares", "GENERATED_API", "api/v1.proto", None, "External", "api/v1.proto"),
        ("p", "package.json", "provides", "NPM", "x", None, None, None), ("p", "package.json", "provides", "NPM", "two", None, None, None), ("q", "package.json", "provides", "NPM", "two", None, None, None), ("c", "package.json", "provides", "NPM", "own", None, None, None),
    ]
    s = spark.createDataFrame(scanned, "repository_id string, path string, role string, ecosystem string, name string, version string, kind string, hint string")
    roots = spark.createDataFrame([("c", "/srv/c"), ("p", "/srv/p")], "repository_id string, root_path string")
    files = spark.createDataFrame([("q", "proto/api/v1.proto"), ("q", "proto/notapi/v1.proto")], "repository_id string, path string")
    got = {(r.kind, r.name): (r.status, r.provider, r.confidence) for r in resolver.resolve_workspace(s, roots, files).collect()}
    assert got == {("package", "x"): ("resolved", "p", 0.9), ("package", "two"): ("ambiguous", None, None), ("package", "own"): ("missing", None, None), ("local", "../../P"): ("resolved", "p", 0.95), ("proto", "api/v1.proto"): ("resolved", "q", 0.8)}


def test_questions(spark):
    rows = spark.createDataFrame([(1, "where is src/a.py"), (2, "why does the timeout setting of max_size fail"), (3, "parseQuery"), (4, None), (5, "hello world"), (6, "explain how it works")], "id int, q string")
    got = {r.id: (r.query_type, r.confidence, r.config_key, r.symbol_hint) for r in routing.classify(rows, "q").collect()}
    assert got[1][:2] == ("EXACT_LOOKUP", "Medium") and got[2][:3] == ("CONFIGURATION", "Medium", "max_size") and got[3] == ("DEFINITION", "Medium", None, "parseQuery")
    assert got[4][0] is None and got[5][:2] == ("GENERIC_SEARCH", "Low") and got[6][:2] == ("ARCHITECTURE", "Medium")


def test_tasks(spark):
    schema = "task_id string, task_type string, repository_id string, checkpoint string, priority int, created_at int, state string, retries int"
    queue = spark.createDataFrame([("a", "T", None, "x", 1, 1, "PENDING", 0), ("b", "T", "r", "x", 9, 2, "RUNNING", 3)], schema)
    more = spark.createDataFrame([("c", "T", None, "x", 1, 3, "PENDING", 0), ("d", "T", "r", "x", 5, 4, "PENDING", 0), ("e", "T", "r", "x", 5, 5, "PENDING", 0)], schema)
    now = incremental.enqueue(queue, more)
    assert sorted(r.task_id for r in now.collect()) == ["a", "b", "d"]
    assert [r.task_id for r in incremental.claim(now, 2).collect()] == ["d", "a"]
    done = {r.task_id: (r.state, r.retries) for r in incremental.finish(now, spark.createDataFrame([("b", "FAILED"), ("d", "DONE")], "task_id string, outcome string")).collect()}
    assert done == {"a": ("PENDING", 0), "b": ("FAILED", 4), "d": ("DONE", 0)}
