"""Passages of held-out items inside documents: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
LEAK_WORDS = 12
#: Words of a block of the shift table.
BLOCK = 2
#: Items, and bytes of their texts, that a search may hold at once; more are searched in several rounds.
ROUND_ITEMS = 100_000
ROUND_BYTES = 32_000_000

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->|\\(?=[*_`~#>\[\]])|[*_~`]+", re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|tt|u)\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[\x00-\x7f]*\Z")
_TAGS = re.compile(r"[<\\*_~`]")


def words(text: str) -> list[str]:
    """The text's words: runs of letters and digits, after folding letter case, width of characters, markup and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not _ASCII.match(text):
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if _TAGS.search(text):
        text = _MARKUP.sub(lambda m: " " if m[0][0] == "<" and not _INLINE.match(m[0]) else "", text)
    return _WORD.findall(text.casefold())


class WuManber:
    """Patterns of one length m or more, all searched by their first m words."""

    def __init__(self, patterns: list[tuple[tuple[str, ...], int]], m: int):
        self.m, self.block = m, min(BLOCK, m)
        self.longest = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words_, item in patterns:
            for end in range(self.block, m + 1):
                block, far = words_[end - self.block : end], m - end
                if self.shift.get(block, self.longest) > far:
                    self.shift[block] = far
            # patterns by their last block; the first block is compared before the rest
            self.buckets.setdefault(words_[m - self.block : m], {}).setdefault(words_[: self.block], []).append((words_, item))

    def search(self, text: list[str], found: set) -> None:
        m, b, shift, longest, at, n = self.m, self.block, self.shift, self.longest, self.m, len(text)
        get = shift.get
        while at <= n:
            far = get((text[at - 2], text[at - 1]) if b == 2 else (text[at - 1],), longest)
            if far:
                at += far
                continue
            start = at - m
            for words_, item in self.buckets[tuple(text[at - b : at])].get(tuple(text[start : start + b]), ()):
                if item not in found and tuple(text[start : start + len(words_)]) == words_:
                    found.add(item)
            at += 1


def searchers(items: list[tuple[int, str]], least: int = LEAK_WORDS) -> list[WuManber]:
    """One searcher for all windows of ``least`` words, one for each length of shorter items."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        own = tuple(words(text or ""))
        if len(own) >= least:
            for i in range(len(own) - least + 1):
                by_length.setdefault(least, {})[own[i : i + least], item] = None
        elif own:
            by_length.setdefault(len(own), {})[own, item] = None
    return [WuManber(list(patterns), m) for m, patterns in sorted(by_length.items())]


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAK_WORDS, round_items: int = ROUND_ITEMS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``doc_id, item_id`` of each document that repeats ``least`` consecutive words of an item, or all of a shorter one; each pair once.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, item_text``.
    The items, a held-out set, are sent to all tasks; a set larger than
    ``round_items`` or ``round_bytes`` is searched in rounds of about that size,
    so what a task holds is bounded. Documents are read whole where they lie; only finds are shuffled.
    A null or wordless text or item leaks nothing; documents that repeat an id
    give that id's pairs once; no documents or items give no rows.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "item_text").where(F.col("item_text").isNotNull()).dropDuplicates(["item_id", "item_text"])
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).head()
    if total <= round_items and size <= round_bytes:
        rounds = [rows]
    else:
        n = max(-(-total // round_items), -(-size // round_bytes)) * 2
        rounds = [rows.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)) == i) for i in range(n)]
    out = None
    for part in rounds:
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most about round_items rows and round_bytes bytes

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tools = searchers(sent.value, least)
            for pdf in batches:
                pairs = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    found: set = set()
                    own = words(text)
                    for tool in tools:
                        tool.search(own, found)
                    pairs += [(doc, item) for item in sorted(found)]
                yield pd.DataFrame(pairs, columns=["doc_id", "item_id"])

        found = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).mapInPandas(search, "doc_id bigint, item_id bigint")
        out = found if out is None else out.union(found)
    return out.distinct()


def leak_counts(leaks: DataFrame) -> DataFrame:
    """``item_id, n_documents``: in how many documents each leaked item appears."""
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"))
