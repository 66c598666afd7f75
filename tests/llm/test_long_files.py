"""Recognition takes time in proportion to a file's length, in memory that its parts bound."""

import time

import pytest

from siftgrain.llm import parsing

LINES = {
    "python": lambda n: "".join(f"x{i} = f(a, {i}) + b[{i}]\n" for i in range(n)),
    "javascript": lambda n: "".join(f"var x{i} = f(a, {i});\n" for i in range(n)),
    "go": lambda n: "package a\n\nfunc f() {\n" + "".join(f"\tx{i} := f(a, {i})\n" for i in range(n)) + "}\n",
    "rust": lambda n: "fn f() {\n" + "".join(f"  let x{i} = f(a, {i});\n" for i in range(n)) + "}\n",
    "java": lambda n: "class A { void f() {\n" + "".join(f"  int x{i} = f(a, {i});\n" for i in range(n)) + "}}\n",
}


@pytest.mark.parametrize("language", LINES)
def test_a_hundred_thousand_lines(language):
    begun = time.perf_counter()
    assert parsing.dialects(language, LINES[language](100_000))
    assert time.perf_counter() - begun < 60


def test_one_long_expression():
    begun = time.perf_counter()
    assert parsing.dialects("javascript", "x = " + " + ".join(f"a{i}" for i in range(20_000)) + ";")
    assert not parsing.dialects("javascript", "x = " + " + ".join(f"a{i}" for i in range(20_000)) + " +;")
    assert time.perf_counter() - begun < 60
