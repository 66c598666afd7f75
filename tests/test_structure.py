"""Structure, heritage, calls and resolution on small sources of several languages."""

from siftgrain.operators import structure as T

FILES = [
    ("r", "a/Base.java", "package a;\npublic class Base {\n}\n"),
    ("r", "a/Child.java", "package a;\npublic class Child extends Base implements Runnable, Closeable {\n}\n"),
    ("r", "b/m.py", "class A(Base, metaclass=M):\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n\ndef main():\n    helper(2)\n    print(helper(3))\n"),
    ("r", "c/s.rs", "struct S;\nimpl Display for S {\n}\nfn go() {\n    step()\n}\nfn step() {}\n"),
    ("r", "d/k.ts", "export class K<T> extends Base implements One<T>, Two {\n}\n"),
    ("r", "e/x.rb", "class Dog < Animal\n  def bark\n  end\nend\n"),
    ("r", "f/empty.py", ""),
    ("r", "g/none.py", None),
]


def _files(spark):
    return spark.createDataFrame(FILES, "repository_id string, path string, content string")


def test_heritage(spark):
    got = {(r.source, r.edge_type, r.target_name) for r in T.heritage(_files(spark)).collect()}
    assert {("Child", "EXTENDS", "Base"), ("Child", "IMPLEMENTS", "Runnable"), ("Child", "IMPLEMENTS", "Closeable"), ("A", "EXTENDS", "Base"), ("S", "IMPLEMENTS", "Display"), ("K", "EXTENDS", "Base"), ("K", "IMPLEMENTS", "One"), ("K", "IMPLEMENTS", "Two"), ("Dog", "EXTENDS", "Animal")} <= got


def test_nodes_nest(spark):
    got = {(r.path, r.qualified_name): (r.node_type, r.start_line, r.end_line) for r in T.nodes(_files(spark)).collect()}
    assert got["b/m.py", "A.run"] == ("METHOD", 1, 4) and got["b/m.py", "A"] == ("CLASS", 0, 4) and got["b/m.py", "helper"][0] == "FUNCTION"
    assert got["e/x.rb", "Dog.bark"][0] == "METHOD"


def test_calls(spark):
    files = _files(spark)
    got = {(r.source, r.target, r.confidence) for r in T.calls(files, T.nodes(files)).collect()}
    assert got == {("A.run", "helper", 0.85), ("main", "helper", 0.85), ("go", "step", 0.85)}


def test_resolution_prefers_the_whole_name_then_the_newest(spark):
    edges = spark.createDataFrame([("r", "p", "X", "EXTENDS", "B", "SYNTACTIC", 0.5), ("r", "p", "X", "EXTENDS", "Gone", "SYNTACTIC", 0.5)], "repository_id string, path string, source string, edge_type string, target_name string, resolution string, confidence double")
    types = spark.createDataFrame([("r", "a.B", "suffix", 9), ("r", "B", "old", 1), ("r", "B", "new", 2), ("other", "B", "far", 5)], "repository_id string, qualified_name string, symbol_id string, seq bigint")
    got = {r.target_name: (r.target_id, r.resolution) for r in T.resolve_types(edges, types).collect()}
    assert got == {"B": ("new", "SYMBOL_RESOLVED"), "Gone": ("logical:Gone", "SYNTACTIC")}


def test_contradictions_spare_what_is_verified(spark):
    evidence = spark.createDataFrame([("a", "VERIFIED"), ("b", "UNVERIFIED"), ("c", "UNVERIFIED")], "id string, verification string")
    pairs = spark.createDataFrame([("a", "b")], "before_id string, id string")
    got = {r.id: (r.verification, r.n_conflicts) for r in T.apply_contradictions(evidence, pairs).collect()}
    assert got == {"a": ("VERIFIED", 1), "b": ("CONTRADICTED", 1), "c": ("UNVERIFIED", 0)}
