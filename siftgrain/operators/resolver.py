"""Edges between repositories from what their manifests declare and provide: local paths, packages, interface files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.paths import normal_path

#: How sure an edge is, and what it rests on, by its kind (fixed values).
CONFIDENCE = {"local": 0.95, "package": 0.9, "proto": 0.8}
RESOLUTION = {"local": "BUILD_RESOLVED", "package": "PACKAGE_RESOLVED", "proto": "PACKAGE_RESOLVED"}


def _status(pairs: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """One row per declaration of ``pairs`` (``by, provider``): resolved with one provider, ambiguous with several, missing with none."""
    counted = pairs.groupBy(*by).agg(F.count_distinct("provider").alias("n"), F.min("provider").alias("provider"))
    one = F.col("n") == 1
    status = F.when(one, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return counted.select(
        "consumer", F.lit(kind).alias("kind"), "name", status.alias("status"), F.when(one, F.col("provider")).alias("provider"), F.when(one, RESOLUTION[kind]).alias("resolution"), F.when(one, CONFIDENCE[kind]).alias("confidence")
    )


def _others(c: Column) -> Column:
    return F.when(c != F.col("consumer"), c)


def package_edges(declared: DataFrame, provided: DataFrame) -> DataFrame:
    """Declared packages joined to the repositories that provide them, inside one ecosystem; a repository never provides for itself."""
    asked = declared.where("kind = 'External' AND ecosystem <> 'GENERATED_API'").select(F.col("repository_id").alias("consumer"), "ecosystem", "name").distinct()
    offers = provided.select(F.col("repository_id").alias("_p"), "ecosystem", "name").distinct()
    return _status(asked.join(offers, ["ecosystem", "name"], "left").withColumn("provider", _others(F.col("_p"))), "package", ["consumer", "ecosystem", "name"])


def local_edges(declared: DataFrame, roots: DataFrame) -> DataFrame:
    """Local paths joined to the repository whose root they name; ``..`` is followed, letter case is not told apart."""
    known = roots.select(F.col("repository_id").alias("_p"), F.lower(normal_path(F.col("root_path"))).alias("_root"))
    mine = roots.select(F.col("repository_id").alias("consumer"), F.col("root_path").alias("_own"))
    asked = declared.where("kind = 'LocalPath' AND hint IS NOT NULL").select(F.col("repository_id").alias("consumer"), F.regexp_replace("path", r"/?[^/]*$", "").alias("_dir"), "hint").distinct().join(mine, "consumer")
    target = F.when(F.col("hint").startswith("/"), F.col("hint")).otherwise(F.concat_ws("/", "_own", "_dir", "hint"))
    named = asked.withColumn("_root", F.lower(normal_path(target)))
    return _status(named.join(known, "_root", "left").select("consumer", F.col("hint").alias("name"), _others(F.col("_p")).alias("provider")), "local", ["consumer", "name"])


def proto_edges(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Imported interface files joined to the repositories that have a file whose path ends with the specifier, whole components only: an equi-join on the paths' suffixes."""
    asked = declared.where("ecosystem = 'GENERATED_API' AND kind = 'External'").select(F.col("repository_id").alias("consumer"), "name").distinct()
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    known = files.where(F.col("path").endswith(".proto")).select(F.col("repository_id").alias("_p"), F.explode(suffixes).alias("name")).distinct()
    return _status(asked.join(known, "name", "left").withColumn("provider", _others(F.col("_p"))), "proto", ["consumer", "name"])


def resolve_workspace(scanned: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """``consumer, kind, name, status, provider, resolution, confidence`` of all that the scanned manifests declare; members of a workspace make no edge."""
    declared, provided = scanned.where("role = 'declares'"), scanned.where("role = 'provides'")
    return local_edges(declared, roots).unionByName(package_edges(declared, provided)).unionByName(proto_edges(declared, files))
