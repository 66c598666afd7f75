"""Contradictions between files over all keys they state."""

from siftgrain.operators import evidence


def test_configuration_conflicts(spark):
    df = spark.createDataFrame(
        [("1", "a.yaml", "# ports\nPort: 80\nhost: 'x'"), ("2", "b.json", "port: 81,\nhost: \"x\","), ("3", "b.json", "port = 82"), ("4", "c.toml", "\n\nport = 81\nport = 82\n"), ("5", "d.yaml", "a b c d: 1\n: 2\nkey:\n"), ("6", "e.yaml", None)],
        "id string, path string, content string",
    )
    got = sorted(map(tuple, evidence.conflicting_values(evidence.stated_values(df, "content")).collect()))
    assert got == [("port", "1", "2", "a.yaml", "b.json"), ("port", "3", "4", "b.json", "c.toml")]
    assert evidence.conflicting_values(evidence.stated_values(df.limit(0), "content")).count() == 0


def test_statements_against_files(spark):
    said = spark.createDataFrame([("r", "knowledge/n.md", "text\nretries = 3\nlimit: 5"), ("r", "docs/d.md", "retries: 4"), ("s", "docs/d.md", "retries: 9"), ("r", "conf/a.toml.md", "retries: 7")], "repository_id string, path string, text string")
    held = spark.createDataFrame([("r", "conf/a.toml", "retries = 4"), ("r", "src/a.py", "x = 1\nretries = 4\nlimit = 5")], "repository_id string, path string, text string")
    got = sorted(map(tuple, evidence.denied_statements(evidence.stated_values(said, "text"), evidence.stated_values(held, "text")).collect()))
    assert got == [("r", "retries", "conf/a.toml.md", 1), ("r", "retries", "knowledge/n.md", 2)]
