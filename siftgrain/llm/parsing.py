"""Source files that no dialect of their language derives."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.keys import extension
from siftgrain.llm.grammars import grammar
from siftgrain.llm.lexers import lex

#: Extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "rs": "rust", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "markdown": "markdown",
}


#: Frames for deeply nested texts; Python frames, which take no C stack.
NESTING = 400_000


def dialects(language: str, text: str) -> list[str]:
    """The dialects of ``language`` that derive ``text``; a byte-order mark is no part of it."""
    if sys.getrecursionlimit() < NESTING:
        sys.setrecursionlimit(NESTING)
    rules = grammar(language)
    tokens = lex(language, rules, text.removeprefix("\ufeff"))
    return [] if tokens is None else rules.accepted(tokens)


def parse_status(files: DataFrame) -> DataFrame:
    """``file_occurrence_id, repository_id, language, parses`` of files with ``file_occurrence_id, repository_id, path, content``.

    All dialects of the language that the path's extension names run over one
    graph-structured stack; ``parses`` is false if each rejects the file, null
    if the extension names no supported language or the content is null. A file
    is read whole. An empty text is judged as any other (valid but for JSON).
    Extra columns are ignored; rows that repeat give rows that repeat; no rows
    give no rows. Nothing is shuffled: each task parses the rows it has.
    """
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    named = files.select("file_occurrence_id", "repository_id", known[extension(F.col("path"))].alias("language"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [None if not isinstance(text, str) or not isinstance(language, str) else bool(dialects(language, text)) for language, text in zip(pdf["language"], pdf["content"])]
            yield pd.DataFrame({"file_occurrence_id": pdf["file_occurrence_id"], "repository_id": pdf["repository_id"], "language": pdf["language"], "parses": pd.Series(ok, dtype=object)})

    return named.mapInPandas(parse, "file_occurrence_id string, repository_id string, language string, parses boolean")


def with_paths(contents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Contents with the path and repository of their occurrence; redelivered occurrences count once."""
    known = occurrences.groupBy(F.col("id").alias("file_occurrence_id")).agg(F.first("path").alias("path"), F.first("repository_id").alias("repository_id"))
    return contents.select("file_occurrence_id", "content").join(known, "file_occurrence_id")


def unparsable(files: DataFrame) -> DataFrame:
    """``file_occurrence_id`` of each file that does not parse, once."""
    return parse_status(files).where(~F.col("parses")).select("file_occurrence_id").distinct()


def parse_rates(files: DataFrame) -> DataFrame:
    """``repository_id, language, n_files, n_unparsable, rate`` over the files that were judged, redelivered ones counted once."""
    one = parse_status(files).where(F.col("parses").isNotNull()).distinct()
    bad = F.count(F.when(~F.col("parses"), 1))
    return one.groupBy("repository_id", "language").agg(F.count("*").alias("n_files"), bad.alias("n_unparsable"), F.round(bad / F.count("*"), 6).alias("rate"))
