"""JSON documents: values by pointer, outlines, references to a name, canonical form."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pointer(parts: list) -> str:
    """A JSON pointer, its parts escaped."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def walk(value, parts=()):
    """(parts, value) of a document and everything in it, without recursion, in document order."""
    todo = [(list(parts), value)]
    while todo:
        at, v = todo.pop()
        yield at, v
        if isinstance(v, dict):
            todo += [([*at, k], x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [([*at, i], x) for i, x in reversed(list(enumerate(v)))]


def leaves(files: DataFrame) -> DataFrame:
    """``id, pointer, value_type, value`` of every leaf of the JSON texts in ``id, content``; texts that are no JSON give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["content"]):
                try:
                    document = json.loads((text or "").removeprefix("﻿"))
                except (ValueError, RecursionError):
                    continue
                for at, v in walk(document):
                    if not isinstance(v, (dict, list)) or not v:
                        rows.append((key, pointer(at), type(v).__name__, json.dumps(v, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["id", "pointer", "value_type", "value"])

    return files.select("id", "content").mapInPandas(read, "id string, pointer string, value_type string, value string")


def references(found: DataFrame, name: str) -> DataFrame:
    """Leaves that mention a name: ``definition`` as the last part of the pointer, ``reference`` as the whole value, ``uncertain`` inside either."""
    last = F.element_at(F.split("pointer", "/"), -1)
    plain = F.regexp_replace("value", '^"|"$', "")
    certainty = F.when(last == name, "definition").when(plain == name, "reference").when(F.col("pointer").contains(name) | F.col("value").contains(name), "uncertain")
    return found.withColumn("certainty", certainty).where(F.col("certainty").isNotNull())


def canonical(files: DataFrame) -> DataFrame:
    """``id, canonical_hash``: a hash that neither key order nor white space changes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["content"]):
                try:
                    rows.append((key, json.dumps(json.loads((text or "").removeprefix("﻿")), sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
                except (ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["id", "canonical_text"])

    return files.select("id", "content").mapInPandas(read, "id string, canonical_text string").select("id", F.sha2("canonical_text", 256).alias("canonical_hash"))
