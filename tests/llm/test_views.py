"""The classifier learns from the files, not from the rules that label them."""

import random

from siftgrain.llm import handwritten


def body(rng: random.Random) -> str:
    return "\n".join(f"def {rng.choice(['load', 'save', 'merge'])}_{rng.randrange(99)}(item):\n    return item + {rng.randrange(9)}" for _ in range(15))


def packed(rng: random.Random) -> str:
    return ";".join(f"var {rng.choice('abc')}{rng.randrange(99)}=function(t){{return t+{rng.randrange(9)}}}" for _ in range(40))


def test_evidence_is_no_feature():
    for path, text in (("a/vendor/b.py", "x = 1"), ("a/b.go", "// Code generated by x. DO NOT EDIT.\npackage a")):
        whole = handwritten.features(path, text)[0]
        signs = {handwritten.crc32(f"sign:{s}".encode()) >> (32 - handwritten.BITS) for s in handwritten.evidence(path, text)}
        assert signs and not signs & set(whole.tolist())


def test_masked_view_knows_no_header_and_path():
    text = "x = 1\ny = 2\n"
    plain = handwritten.features("b.py", text, masked=True)
    told = handwritten.features("b.py", "#!/usr/bin/env python\n" + text, masked=True)
    assert set(handwritten._grams(text, 1).tolist()) <= set(plain[0].tolist()) and set(handwritten._grams(text, 1).tolist()) <= set(told[0].tolist())
    header = "#!/bin/sh\n# Code generated by protoc. DO NOT EDIT.\n"
    assert not set(handwritten._grams("generated", 1).tolist()) & set(handwritten.features("vendor/b.py", header + text, masked=True)[0].tolist())


def test_a_body_alone_is_enough():
    rng = random.Random(3)
    rows = [(f"src/{k}.py", body(rng)) for k in range(60)] + [(f"web/{k}.js", packed(rng)) for k in range(20)]
    model = handwritten.fit(rows)
    half = packed(rng) + "\n" + "\n".join("// a line of a comment" for _ in range(120))  # too little of it for the rule
    assert not handwritten.evidence("src/z.js", half)
    assert max(handwritten.margins(model, "src/z.js", half)) >= handwritten.MARGIN
    assert max(handwritten.margins(model, "src/z.py", body(rng))) < handwritten.MARGIN
