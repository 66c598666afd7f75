"""Lists tried part by part give what a run over the whole gives, on valid and on mutated texts."""

import random

import pytest

from siftgrain.llm import grammars, parsing
from siftgrain.llm.lexers import lex

TEXTS = {
    "rust": "#![allow(x)]\nuse a::b;\nfn f(a: u8) -> u8 {\n    foo(a);\n    let y = g(a);\n    if y { h() } else { i() }\n    match y { 1 => 2, _ => { k(3) } }\n    y + 1\n}\nmod m {\n    #![deny(y)]\n    fn q() {}\n    struct S { a: u8, b: u8 }\n}\nimpl S { fn r(&self) { loop { break; } } }\n",
    "javascript": "import a from 'b';\nfoo(a);\nconst b = f(1, [2, 3], {c: 4, d: 5});\nlet z = g(a)\nconst w = 2\nfunction h(x) { if (x) { return x } for (const i of x) { p(i) } return q(x) }\nclass C { a = f(1)\n  m() { return 1 }\n  n() { x(); y() } }\n",
    "typescript": "import a from 'b';\nfoo(a);\nconst b: number = f(1, [2, 3], {c: 4});\nlet z = g(a)\nexport function h(x: string): void { if (x) { return } p(x); q(x) }\nabstract class C { a: T = f(1)\n  m(): void { y(); }\n  n(): void { x(); y() } }\n",
    "java": "package a;\nclass C {\n  int a = f(1, 2);\n  int[] b = {1, 2};\n  void m() { int x = 1; if (x > 0) { g(x); } else { h(); } for (;;) { k(); } }\n  void n() { foo(a); return; }\n}\n",
    "go": "package a\nimport \"b\"\nfunc f(a int) int {\n\tfoo(a)\n\ty := g(a, 1)\n\tif x := h(); x { return 1 }\n\tfor i := 0; i < 3; i++ { k(i) }\n\tz := []int{1, 2}\n\treturn y\n}\n",
    "python": "import a\n\ndef f(x, y=1):\n    if x:\n        return [1, 2]\n    elif y:\n        g(x, y=2)\n    else:\n        pass\n    return {1: 2, 3: 4}\n\nclass C(object):\n    def m(self): return (1, 2)\n",
    "json": '{"a": [1, 2, {"b": null}], "c": {"d": "e", "f": 1.5}}',
    "toml": 'a = [1, 2]\n[b]\nc = "d"\ne = {f = 1, g = 2}\n',
    "yaml": "a: b\nc:\n  d: [1, 2]\n  e: {f: 1, g: 2}\nh:\n  - i\n  - j: k\n",
}


def both(language: str, text: str) -> tuple[list[str], list[str]]:
    rules = grammars.grammar(language)
    short = parsing.dialects(language, text)
    kept, rules.lists = rules.lists, {}
    rules.forget()
    try:
        tokens = lex(language, rules, text)
        whole = [] if tokens is None else rules.accepted(tokens)
    finally:
        rules.lists = kept
        rules.forget()
    return short, whole


@pytest.mark.parametrize("language", TEXTS)
def test_mutated_texts(language):
    text, rng = TEXTS[language], random.Random(7)
    short, whole = both(language, text)
    assert short and short == whole
    marks = [i for i, c in enumerate(text) if c in ";,\n(){}[]:=" or c == "#"]
    for _ in range(150):
        k, to = rng.choice(marks), rng.choice(marks)
        for changed in (text[:k] + " " + text[k + 1 :], text[:to] + text[k] + text[to:]):
            short, whole = both(language, changed)
            assert short == whole, changed


@pytest.mark.parametrize(
    "language, text",
    [
        ("rust", "fn f() {\n    foo(a)\n    let y = 1;\n}\n"), ("rust", "fn f() {\n    foo(a)\n    if b { c(); }\n    g(d)\n    return 1;\n}\n"),
        ("rust", "fn f() { g(); #![allow(x)] h(); }\n"), ("rust", "use a;\n#![allow(x)]\nfn f() {}\n"),
        ("javascript", "foo(a) const b = 1;\n"), ("javascript", "function f() { foo(a) const b = 1; }\n"), ("javascript", "class C { a = f(1) b = 2; }\n"),
        ("typescript", "foo(a) const b = 1;\n"), ("typescript", "import {a} from 'b'; foo(a) let c = 1;\n"),
    ],
)
def test_missing_ends_are_rejected(language, text):
    assert not parsing.dialects(language, text)


@pytest.mark.parametrize("text", ["foo(a)\nconst b = 1\n", "foo(a); const b = 1;", "if (a) { b() } const c = 1", "function f() { foo(a) }"])
def test_line_ends_still_end_statements(text):
    assert parsing.dialects("javascript", text)
