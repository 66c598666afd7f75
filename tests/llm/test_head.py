"""Evidence in the leading comments, however long they are."""

import pytest

from siftgrain.llm import handwritten

CODE = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(20))
OWN = "".join(f"# line {i} of what the project says about itself\n" for i in range(12))


@pytest.mark.parametrize(
    "head, signs",
    [
        (OWN + "# Code generated by protoc. DO NOT EDIT.\n", {"generated"}),
        ("#!/usr/bin/env python\n\n" + OWN + "\n\n# SPDX-License-Identifier: MIT\n", {"vendored"}),
        ('"""\n' + OWN.replace("# ", "") + 'Code generated by x. DO NOT EDIT.\n"""\n', {"generated"}),
        (OWN, set()),
    ],
)
def test_long_leading_comments(head, signs):
    assert handwritten.evidence("a/b.py", head + CODE) == signs


def test_code_ends_the_leading_comments():
    assert handwritten.evidence("a/b.py", OWN + "import os\n# Code generated by protoc. DO NOT EDIT.\n" + CODE) == set()
    assert handwritten.head_of("#!/bin/sh\n# a\nx\n# b\n") == "# a\n"
