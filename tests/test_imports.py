"""Imports whose name is not the first group of their pattern."""

from siftgrain.operators import code


def test_php_includes(spark):
    files = spark.createDataFrame([("r", "a.php", "<?php\nuse App\\B;\nrequire_once 'c.php';\ninclude(\"d.php\");\n")], "repository_id string, path string, content string")
    assert {r.specifier for r in code.imports(files).collect()} == {"App\\B", "c.php", "d.php"}
