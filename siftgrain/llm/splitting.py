"""Cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\n|[^\S\n]+|\w+|[^\w\s]")
_SENTENCE = frozenset(".!?;。！？；…")


def boundaries(text: str) -> list[list[int]]:
    """Sorted byte offsets at which the text may be cut, from the strongest kind to the weakest: after a blank line, a line, a sentence or clause, white space."""
    tokens = _TOKEN.findall(text)
    ends = list(accumulate(len(t.encode("utf-8", "surrogatepass")) for t in tokens))  # prefix sums
    blank, line, sentence, space = [], [], [], []
    for i, t in enumerate(tokens):
        if t == "\n":
            line.append(ends[i])
            if i and tokens[i - 1] == "\n" or i > 1 and tokens[i - 1].isspace() and tokens[i - 2] == "\n":
                blank.append(ends[i])
        elif t.isspace():
            space.append(ends[i])
            if i and tokens[i - 1] in _SENTENCE:
                sentence.append(ends[i])
        elif t in "。！？；":
            sentence.append(ends[i])
    return [blank, line, sentence, space]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges that cover the text: each within the limit, each but the first beginning ``overlap`` bytes before the end of the one before.

    The last boundary under the limit is found by binary search, in the
    strongest kind that leaves the piece at least half full, else in the
    strongest that advances at all; with none, the cut is hard, between two
    characters. A step back that would split a character goes on to its start.
    The overlap is honoured up to one byte below the limit (beyond, no piece could
    advance), and is left out where the limit has no room for it and one more
    character; a limit below one character's bytes gives single characters.
    """
    data = text.encode("utf-8", "surrogatepass")
    size, limit = len(data), max(1, limit)
    if size <= limit:
        return [(0, size)]
    overlap = max(0, min(overlap, limit - 1))
    kinds = boundaries(text)
    starts_inside = lambda at: at < size and data[at] & 0xC0 == 0x80
    out, start, covered = [], 0, 0
    while size - start > limit and covered < size:
        end = 0
        for least in (max(covered, start + limit // 2), covered):
            for offsets in kinds:
                at = bisect_right(offsets, start + limit) - 1
                if at >= 0 and offsets[at] > least:
                    end = offsets[at]
                    break
            if end:
                break
        if not end:
            end = start + limit
            while starts_inside(end):
                end -= 1
            if end <= covered:
                if start < covered:  # no room for the overlap
                    start = covered
                    continue
                end = start + 1
                while starts_inside(end):
                    end += 1
        out.append((start, end))
        covered, after = end, end - overlap
        while starts_inside(after):
            after -= 1
        start = after if after > start else end
    if covered < size:
        out.append((start, size))
    return out


PIECE = "unit_id string, analyzer_id string, piece_no int, n_bytes int, start_byte int, end_byte int, start_line int, end_line int, piece_text string"


def split_oversized(units: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of each unit longer than its analyzer's limit; units within the limit have none.

    ``units`` has ``id, analyzer_id, retrieval_text, start_line, end_line``,
    ``limits`` has ``analyzer_id, max_bytes, overlap_bytes``; its row ``default``
    holds where the analyzer is null or not listed (without such a row, those
    units are not cut). Only oversized units reach Python, once each however
    often they were redelivered. Lines are 0-based, the end exclusive; null
    start lines stay null. Null and empty texts are never cut. Joining the
    pieces without their overlaps gives the text back.
    """
    rule = limits.groupBy(F.col("analyzer_id").alias("analyzer")).agg(F.min("max_bytes").alias("max_bytes"), F.min("overlap_bytes").alias("overlap_bytes"))
    default = rule.where("analyzer = 'default'").select("max_bytes", "overlap_bytes").head()  # one row
    size = F.octet_length("retrieval_text")
    oversized = (
        units.select("id", "analyzer_id", "retrieval_text", "start_line")
        .join(rule, F.col("analyzer_id") == F.col("analyzer"), "left")
        .withColumn("max_bytes", F.coalesce("max_bytes", F.lit(default and default[0]).cast("int")))
        .withColumn("overlap_bytes", F.coalesce("overlap_bytes", F.lit(default and default[1]).cast("int"), F.lit(0)))
        .where(size > F.col("max_bytes"))
        .dropDuplicates(["id"])
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, analyzer, text, line, limit, overlap in zip(pdf["id"], pdf["analyzer_id"], pdf["retrieval_text"], pdf["start_line"], pdf["max_bytes"], pdf["overlap_bytes"]):
                data = text.encode("utf-8", "surrogatepass")
                first = None if pd.isna(line) else int(line)
                for n, (a, b) in enumerate(pieces(text, int(limit), int(overlap))):
                    begin = None if first is None else first + data.count(b"\n", 0, a)
                    end = None if first is None else first + data.count(b"\n", 0, b - 1) + 1
                    rows.append((unit, analyzer, n, b - a, a, b, begin, end, data[a:b].decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"start_line": "Int32", "end_line": "Int32"})

    return oversized.mapInPandas(cut, PIECE)
