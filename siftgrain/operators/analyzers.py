"""The surface analyzers plug into: what they can read, how one is chosen, and the relation they give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.paths import language_of
from siftgrain.operators import aem, code, jsonops, structure

#: Analyzers in order of capability: what knows a format best comes first (fixed values).
CAPABILITIES = ("FORMAT", "STRUCTURAL", "LEXICAL")
#: The relation every analyzer gives: one row per node.
COLUMNS = ("repository_id", "path", "analyzer_id", "node_type", "name", "start_line")


@dataclass(frozen=True)
class Analyzer:
    """``accepts`` says of a path whether it is the analyzer's, ``analyze`` turns files (``repository_id, path, content``) into ``repository_id, path, node_type, name, start_line``."""

    id: str
    description: str
    capability: str
    accepts: Callable[[Column], Column]
    analyze: Callable[[DataFrame], DataFrame]


def _json(files: DataFrame) -> DataFrame:
    found = jsonops.leaves(files.withColumn("id", F.concat_ws("\u0001", "repository_id", "path")))
    at = F.split("id", "\u0001")
    return found.select(at[0].alias("repository_id"), at[1].alias("path"), F.upper("value_type").alias("node_type"), F.col("pointer").alias("name"), F.lit(0).alias("start_line"))


def _headings(files: DataFrame) -> DataFrame:
    return code.headings(files).select("repository_id", "path", F.lit("HEADING").alias("node_type"), F.col("title").alias("name"), (F.col("line_no") - 1).alias("start_line"))


def _plain(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "path", F.lit("TEXT").alias("node_type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(0).alias("start_line"))


REGISTRY: dict[str, Analyzer] = {}


def register(analyzer: Analyzer) -> Analyzer:
    """Adds an analyzer; an id is taken once."""
    if analyzer.id in REGISTRY or analyzer.capability not in CAPABILITIES:
        raise ValueError(f"analyzer {analyzer.id}")
    REGISTRY[analyzer.id] = analyzer
    return analyzer


register(Analyzer("aem", "component, template and configuration files of a content repository", "FORMAT", lambda p: aem.kind_of(p).isNotNull(), aem.analyze))
register(Analyzer("json", "values of JSON documents by pointer", "FORMAT", lambda p: F.lower(p).endswith(".json"), _json))
register(Analyzer("markdown", "headings", "FORMAT", lambda p: F.lower(p).rlike(r"\.(md|markdown)$"), _headings))
register(Analyzer("structural", "definitions of sixteen languages by line patterns", "STRUCTURAL", lambda p: F.coalesce(language_of(p).isin(*code.DEFINITIONS), F.lit(False)), lambda files: structure.nodes(files).select("repository_id", "path", "node_type", "name", "start_line")))
register(Analyzer("text", "any text as one node", "LEXICAL", lambda p: F.lit(True), _plain))


def chosen(path: Column) -> Column:
    """The id of the analyzer for a path: of those that accept it the most capable, then the least by name."""
    ranked = sorted(REGISTRY.values(), key=lambda a: (CAPABILITIES.index(a.capability), a.id))
    return reduce(lambda out, a: F.when(a.accepts(path), a.id).otherwise(out), reversed(ranked), F.lit(None).cast("string"))


def analyze(files: DataFrame) -> DataFrame:
    """The nodes of all files, each read by its analyzer. A file that its analyzer finds nothing in has no row."""
    named = files.withColumn("analyzer_id", chosen(F.col("path")))
    parts = [a.analyze(named.where(F.col("analyzer_id") == a.id).drop("analyzer_id")).withColumn("analyzer_id", F.lit(a.id)).select(*COLUMNS) for a in REGISTRY.values()]
    return reduce(DataFrame.unionByName, parts)
