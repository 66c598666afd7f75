"""Queries without SQL, against what must hold of their rows."""

from collections import defaultdict

import pytest
from oracle import FOLDER

from siftgrain import registry
from siftgrain.operators import jsonops
from siftgrain.streaming.changefeed import Coalescer

NAMES = sorted(set(registry.queries()) - set(registry.oracle_sql()))


def test_only_these_have_no_sql():
    assert NAMES == ["coalesce_renames", "json_canonical"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_columns(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    assert df.columns and len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_bursts_give_what_one_fold_of_the_whole_log_gives(spark):
    folder = FOLDER.replace("sf0.01", "sf0.001")
    got = sorted((r.repository_id, r.op, r.path, r.new_path or "") for r in registry.queries()["coalesce_renames"](spark, folder).collect())
    kinds = {"signup": lambda u: "Created", "view": lambda u: "Modified", "error": lambda u: "Removed", "click": lambda u: "RenamedFrom" if u % 2 == 0 else "RenamedTo"}
    logs = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id", "event_type", "unix_millis(cast(ts as timestamp)) AS at_ms").collect():
        if r.event_type in kinds:
            logs[str(r.user_id % 4)].append((r.at_ms, str(r.user_id), kinds[r.event_type](r.user_id)))
    want = []
    for repository, events in logs.items():
        held, out = Coalescer(60_000), []
        for at, path, kind in sorted(events, key=lambda e: e[:2]):
            out += held.drain(at)
            held.fold(path, kind, at)
        out += held.drain(1 << 62)
        want += [(repository, op, path, new or "") for op, path, new in out]
    assert got == sorted(want)


def test_canonical_hashes_know_no_order(spark):
    rows = spark.createDataFrame([("a", '{"x": 1, "y": [1, {"b": 2, "a": 3}]}'), ("b", '{ "y": [1, {"a":3,"b":2}],\n"x":1}'), ("c", '{"x": 1, "y": [{"b": 2, "a": 3}, 1]}'), ("d", "no json")], "id string, content string")
    got = {r.id: r.canonical_hash for r in jsonops.canonical(rows).collect()}
    assert got["a"] == got["b"] != got["c"] and "d" not in got
