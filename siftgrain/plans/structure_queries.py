"""Structure, symbols and candidate generators over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.paths import source_type
from siftgrain.operators import index as X
from siftgrain.operators import lexical as L
from siftgrain.operators import structure as T
from siftgrain.plans.base import BASE, KIND, index_of, latest, occurrences
from siftgrain.plans.search_queries import _scored_sql
from siftgrain.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark, sf) -> DataFrame:
    contents = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").withColumnRenamed("file_occurrence_id", "id").dropDuplicates(["id"])
    return latest(spark, sf, "occurrence_seq").select("id", "repository_id", "path", "occurrence_seq", "freshness_state").join(contents, "id")


_D = {
    "py": r"^\s*(?:async\s+)?(class|def)\s+([A-Za-z_]\w*)", "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|function|const)\s+([A-Za-z_]\w*)",
    "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)*(class|function|interface|enum|type|const)\s+([A-Za-z_]\w*)", "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(struct|enum|trait|union|fn|mod|type)\s+([A-Za-z_]\w*)",
}
_CASE = lambda g: "CASE e " + " ".join(f"WHEN '{e}' THEN regexp_extract(line, '{p}', {g})" for e, p in _D.items()) + " END"
_LANG = "CASE e WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE e END"
_NODES = BASE + rf""", fl AS (SELECT n.id, n.repository_id, n.path, n.occurrence_seq AS seq, n.freshness_state, lower(regexp_extract(n.path, '\.([A-Za-z0-9]+)$', 1)) AS e, any_value(content) AS content FROM newest n JOIN file_contents c ON c.file_occurrence_id = n.id GROUP BY ALL),
li AS (SELECT id, repository_id, path, seq, freshness_state, e, unnest(regexp_split_to_array(content, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\r\n|\r|\n'), 1) - 1 AS pos FROM fl WHERE e IN ('py', 'java', 'go', 'js', 'ts', 'rs')),
df AS (SELECT repository_id, path, seq, {_LANG} AS language, lower({_CASE(1)}) AS word, {_CASE(2)} AS name, pos, CASE WHEN e = 'go' THEN 0 ELSE length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ')) END AS depth FROM li WHERE {_CASE(2)} <> ''),
ty AS (SELECT *, CASE word WHEN 'def' THEN 'FUNCTION' WHEN 'func' THEN 'FUNCTION' WHEN 'fn' THEN 'FUNCTION' WHEN 'function' THEN 'FUNCTION' WHEN 'record' THEN 'CLASS' WHEN 'trait' THEN 'INTERFACE' WHEN 'type' THEN 'TYPE_ALIAS' WHEN 'mod' THEN 'MODULE' ELSE upper(word) END AS t FROM df),
pa AS (SELECT a.repository_id, a.path, a.seq, a.language, a.t, a.name, a.pos, arg_max(b.name, b.pos) AS pname, arg_max(b.t, b.pos) AS ptype FROM ty a LEFT JOIN ty b ON a.repository_id = b.repository_id AND a.path = b.path AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL),
en AS (SELECT a.repository_id, a.path, a.pos, min(b.pos) AS stop FROM ty a LEFT JOIN ty b ON a.repository_id = b.repository_id AND a.path = b.path AND b.pos > a.pos AND b.depth <= a.depth GROUP BY 1, 2, 3),
nodes AS (SELECT repository_id, path, seq, language, CASE WHEN t = 'FUNCTION' AND ptype IN ('CLASS', 'INTERFACE', 'STRUCT', 'ENUM', 'OBJECT') THEN 'METHOD' ELSE t END AS node_type, name, concat_ws('.', pname, name) AS qualified_name, pos AS start_line, coalesce(stop, 2147483647) AS end_line FROM pa JOIN en USING (repository_id, path, pos))
"""


@query(_NODES + "SELECT repository_id, path, language, node_type, name, qualified_name, language || '|' || qualified_name || '|' || node_type AS identity, start_line, end_line FROM nodes")
def structural_nodes(spark, sf):
    """Definitions with their type, the one they lie in, and the lines they reach over."""
    return T.nodes(files(spark, sf))


@query(_NODES + "SELECT repository_id, language, qualified_name, node_type AS kind, count(*) AS n_occurrences, count(DISTINCT path) AS n_files, max(seq) AS newest FROM nodes GROUP BY ALL")
def symbol_occurrences(spark, sf):
    """Each symbol's identity joined to its occurrences and their files."""
    rows = files(spark, sf)
    found = T.nodes(rows)
    named = T.symbol_identities(found)
    occ = found.join(rows.select("repository_id", "path", "occurrence_seq"), ["repository_id", "path"])
    joined = named.join(occ.withColumnRenamed("node_type", "kind"), ["repository_id", "language", "qualified_name", "kind"])
    return joined.groupBy("repository_id", "language", "qualified_name", "kind").agg(F.count("*").alias("n_occurrences"), F.count_distinct("path").alias("n_files"), F.max("occurrence_seq").alias("newest"))


_HERITAGE = _NODES + r""", hl AS (SELECT repository_id, path, CASE WHEN e = 'rs' THEN regexp_extract(line, '\bfor\s+(\w+)', 1) ELSE regexp_extract(line, '\b(?:class|interface|struct|enum|protocol|extension|object)\s+(\w+)', 1) END AS source,
  CASE e WHEN 'py' THEN regexp_extract(line, '^\s*class\s+\w+\s*\(([^)]*)\)', 1) WHEN 'java' THEN regexp_extract(line, '\bextends\s+([A-Za-z_][\w.]*)', 1) WHEN 'js' THEN regexp_extract(line, '\bclass\s+\w+\s+extends\s+([A-Za-z_][\w.]*)', 1)
    WHEN 'ts' THEN regexp_extract(line, '\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+extends\s+([^{]+?)(?:\s+implements\b|\s*\{|$)', 1) ELSE '' END AS ext,
  CASE e WHEN 'java' THEN regexp_extract(line, '\bimplements\s+([^{]+)', 1) WHEN 'ts' THEN regexp_extract(line, '\bimplements\s+([^{]+)', 1) WHEN 'rs' THEN regexp_extract(line, '^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+\w+', 1) ELSE '' END AS imp FROM li),
he AS (SELECT DISTINCT repository_id, path, source, edge_type, trim(target_name) AS target_name FROM (SELECT repository_id, path, source, 'EXTENDS' AS edge_type, unnest(string_split_regex(regexp_replace(ext, '<[^>]*>|\([^)]*\)', '', 'g'), '\s*,\s*')) AS target_name FROM hl
  UNION ALL SELECT repository_id, path, source, 'IMPLEMENTS', unnest(string_split_regex(regexp_replace(imp, '<[^>]*>|\([^)]*\)', '', 'g'), '\s*,\s*')) FROM hl) WHERE source <> '' AND regexp_matches(trim(target_name), '^[A-Za-z_][\w.:\\]*$'))
"""


@query(_HERITAGE + "SELECT *, 'SYNTACTIC' AS resolution, 0.5::DOUBLE AS confidence FROM he")
def heritage_edges(spark, sf):
    """What types extend and implement, as written."""
    return T.heritage(files(spark, sf))


@query(_HERITAGE + r""", rf AS (SELECT * FROM he UNION ALL SELECT DISTINCT repository_id, path, path, 'REFERENCES', unnest(regexp_extract_all(line, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)) FROM li), ts AS (SELECT repository_id, qualified_name, sha256(concat_ws('|', repository_id, language, qualified_name, node_type)) AS symbol_id, max(seq) AS seq FROM nodes WHERE node_type IN ('CLASS', 'INTERFACE', 'STRUCT', 'ENUM', 'UNION', 'TYPE_ALIAS') GROUP BY 1, 2, 3),
j AS (SELECT h.*, symbol_id, seq, CASE WHEN qualified_name = target_name THEN 2 WHEN ends_with(qualified_name, '.' || target_name) OR ends_with(qualified_name, '::' || target_name) THEN 1 END AS score FROM rf h LEFT JOIN ts ON ts.repository_id = h.repository_id AND list_last(string_split_regex(qualified_name, '[.:\\]+')) = list_last(string_split_regex(target_name, '[.:\\]+'))),
b AS (SELECT repository_id, path, source, edge_type, target_name, (list(symbol_id ORDER BY score DESC, seq DESC, symbol_id DESC) FILTER (score IS NOT NULL))[1] AS hit FROM j GROUP BY 1, 2, 3, 4, 5)
SELECT repository_id, path, source, edge_type, target_name, coalesce(hit, 'logical:' || target_name) AS target_id, CASE WHEN hit IS NULL THEN 'SYNTACTIC' ELSE 'SYMBOL_RESOLVED' END AS resolution, CASE WHEN hit IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM b""")
def type_edges_resolved(spark, sf):
    """Heritage and mentions of types with their types found in the repository."""
    return _type_edges_resolved(spark, sf)


def _types(spark, sf) -> DataFrame:
    rows = files(spark, sf)
    found = T.nodes(rows).where(F.col("node_type").isin("CLASS", "INTERFACE", "STRUCT", "ENUM", "UNION", "TYPE_ALIAS")).join(rows.select("repository_id", "path", "occurrence_seq"), ["repository_id", "path"])
    named = F.sha2(F.concat_ws("|", "repository_id", "language", "qualified_name", "node_type"), 256)
    return found.withColumn("symbol_id", named)


def _type_edges_resolved(spark, sf) -> DataFrame:
    types = _types(spark, sf).groupBy("repository_id", "qualified_name", "symbol_id").agg(F.max("occurrence_seq").alias("seq"))
    rows = files(spark, sf)
    return T.resolve_types(T.heritage(rows).union(T.type_references(rows)), types)


@query(SQL["type_edges_resolved"].replace("SELECT repository_id, path, source, edge_type, target_name, coalesce(hit", ", fin AS (SELECT repository_id, path, source, edge_type, target_name, coalesce(hit") + """),
sp AS (SELECT repository_id, sha256(concat_ws('|', repository_id, language, qualified_name, node_type)) AS symbol_id, min(path) AS p FROM nodes WHERE node_type IN ('CLASS', 'INTERFACE', 'STRUCT', 'ENUM', 'UNION', 'TYPE_ALIAS') GROUP BY 1, 2)
SELECT fin.repository_id, fin.path, source, target_name, coalesce(p, '-') AS target_path FROM fin LEFT JOIN sp ON resolution = 'SYMBOL_RESOLVED' AND sp.repository_id = fin.repository_id AND sp.symbol_id = target_id""")
def endpoint_join(spark, sf):
    """Endpoints of type edges brought to files: of symbols by their identity, logical ones to none."""
    edges = _type_edges_resolved(spark, sf).withColumn("target_type", F.when(F.col("resolution") == "SYMBOL_RESOLVED", "SYMBOL").otherwise("LOGICAL"))
    return T.endpoint_paths(edges, _types(spark, sf), latest(spark, sf)).select("repository_id", "path", "source", "target_name", F.coalesce("target_path", F.lit("-")).alias("target_path"))


@query(_NODES + r""", fs AS (SELECT * FROM nodes WHERE node_type IN ('FUNCTION', 'METHOD')), wd AS (SELECT DISTINCT repository_id, path, e, pos, unnest(regexp_extract_all(line, '(?:^|[^\w.])([A-Za-z_]\w*)\s*\(', 1)) AS target FROM li),
us AS (SELECT wd.* FROM wd WHERE EXISTS (SELECT 1 FROM fs WHERE fs.repository_id = wd.repository_id AND fs.path = wd.path AND fs.name = target) AND NOT EXISTS (SELECT 1 FROM fs WHERE fs.repository_id = wd.repository_id AND fs.path = wd.path AND fs.name = target AND start_line = pos)),
i AS (SELECT us.repository_id, us.path, e, pos, target, arg_max(qualified_name, start_line) AS source FROM us JOIN fs ON fs.repository_id = us.repository_id AND fs.path = us.path AND pos > start_line AND pos < end_line GROUP BY 1, 2, 3, 4, 5)
SELECT DISTINCT repository_id, path, source, target, CASE e WHEN 'java' THEN 0.9 WHEN 'go' THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM i""")
def call_edges(spark, sf):
    """Calls of functions that their own file defines."""
    rows = files(spark, sf)
    return T.calls(rows, T.nodes(rows))


_AMBIGUOUS = _NODES + """, cu AS (SELECT name, fl.id, fl.path FROM nodes JOIN fl ON fl.repository_id = nodes.repository_id AND fl.path = nodes.path WHERE freshness_state = 'CURRENT' AND node_type <> 'METHOD'),
am AS (SELECT name, lag(id) OVER w AS before_id, lag(path) OVER w AS before_path, id, path FROM cu WINDOW w AS (PARTITION BY name ORDER BY id, path))
"""


def _ambiguous(spark, sf) -> DataFrame:
    rows = files(spark, sf)
    defined = T.nodes(rows).where("node_type <> 'METHOD'").join(rows.where("freshness_state = 'CURRENT'").select("id", "repository_id", "path"), ["repository_id", "path"])
    return T.ambiguous_definitions(defined.select("name", "id", "path"))


@query(_AMBIGUOUS + "SELECT name, before_id, id FROM am WHERE before_id IS NOT NULL AND before_path <> path")
def contradiction_definition(spark, sf):
    """Names that current files next to each other define."""
    return _ambiguous(spark, sf)


@query(_AMBIGUOUS + """, cs AS (SELECT before_id AS id, id AS other FROM am WHERE before_id IS NOT NULL AND before_path <> path UNION ALL SELECT id, before_id FROM am WHERE before_id IS NOT NULL AND before_path <> path),
k AS (SELECT id, count(DISTINCT other) AS n FROM cs GROUP BY 1), ev AS (SELECT id, CASE WHEN security_state = 'clean' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS v FROM newest)
SELECT ev.id, coalesce(n, 0) AS n_conflicts, CASE WHEN coalesce(n, 0) > 0 AND v <> 'VERIFIED' THEN 'CONTRADICTED' ELSE v END AS verification FROM ev LEFT JOIN k USING (id)""")
def contradictions_applied(spark, sf):
    """Files as evidence after the contradictions among their definitions."""
    evidence = latest(spark, sf, "security_state").select("id", F.when(F.col("security_state") == "clean", "VERIFIED").otherwise("UNVERIFIED").alias("verification"))
    return T.apply_contradictions(evidence, _ambiguous(spark, sf))


# --- generators -----------------------------------------------------------

_OR = ("journal registry voucher", "has(0) OR has(1) OR has(2)", ["journal", "registry", "voucher"])


def _hits(spark, sf) -> DataFrame:
    return X.score_units(spark, index_of(spark, sf), _OR[0])


@query(_scored_sql(_OR[1], _OR[2]) + f""", w AS (SELECT * FROM hits ORDER BY score DESC, unit_id LIMIT greatest(2 * 20, 100)), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, unit_id) AS p FROM w)
SELECT unit_id, score FROM r WHERE p = 1 ORDER BY score DESC, unit_id LIMIT 20""")
def search_wide_depth(spark, sf):
    """Twenty results out of a hundred candidates, collapsed in between."""
    wide = _hits(spark, sf).orderBy(F.desc("score"), "unit_id").limit(max(2 * 20, 100))
    return L.collapse(wide).orderBy(F.desc("score"), "unit_id").limit(20).select("unit_id", "score")


@query(_scored_sql(_OR[1], _OR[2]) + f"SELECT unit_id, score FROM hits WHERE {KIND} = 'KNOWLEDGE' ORDER BY score DESC, unit_id LIMIT 16")
def knowledge_candidates(spark, sf):
    """The best sixteen knowledge notes for a question."""
    return _hits(spark, sf).where(source_type(F.col("path")) == "KNOWLEDGE").orderBy(F.desc("score"), "unit_id").limit(16).select("unit_id", "score")


@query(_scored_sql(_OR[1], _OR[2]) + r"SELECT unit_id, score FROM hits WHERE NOT regexp_matches(lower(path), '^[^/]*/[^/]*/readme(\.[a-z]+)?$|^readme(\.[a-z]+)?$')")
def search_without_readmes(spark, sf):
    """Results without the readme at a module's or repository's root."""
    return _hits(spark, sf).where(~F.lower("path").rlike(r"^[^/]*/[^/]*/readme(\.[a-z]+)?$|^readme(\.[a-z]+)?$")).select("unit_id", "score")


@query(_NODES + """, q AS (SELECT DISTINCT repository_id, cited_path AS path FROM spec_citations WHERE citation_kind IN ('EXISTING_REF', 'TARGET_MODIFY') AND cited_path IS NOT NULL)
SELECT repository_id, path, node_type, qualified_name FROM (SELECT nodes.*, row_number() OVER (PARTITION BY repository_id, path ORDER BY start_line, name) AS k FROM nodes SEMI JOIN q USING (repository_id, path)) WHERE k <= 8""")
def structural_candidates(spark, sf):
    """Up to eight definitions of each cited file, as an outline."""
    asked = read_table(spark, sf, "spec_citations", "repository_id", "citation_kind", "cited_path").where("citation_kind IN ('EXISTING_REF', 'TARGET_MODIFY') AND cited_path IS NOT NULL").select("repository_id", F.col("cited_path").alias("path")).distinct()
    found = T.nodes(files(spark, sf).join(asked, ["repository_id", "path"], "left_semi"))
    place = F.row_number().over(W.partitionBy("repository_id", "path").orderBy("start_line", "name"))
    return found.withColumn("k", place).where("k <= 8").select("repository_id", "path", "node_type", "qualified_name")


@query("""WITH e AS (SELECT repository_id AS s, dependency_repository_id AS t, count(DISTINCT run_id || '#' || ordinal) AS n FROM spec_citations WHERE dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id GROUP BY 1, 2),
b AS (SELECT s AS node, t AS other, 'out' AS way, n FROM e UNION ALL SELECT t, s, 'in', n FROM e) SELECT node, other, way, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other, way) AS k FROM b) WHERE k <= 24""")
def relationship_candidates(spark, sf):
    """Up to 24 edges of each repository, the strongest first, of either direction."""
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "repository_id", "dependency_repository_id").where("dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id")
    e = c.groupBy("repository_id", "dependency_repository_id").agg(F.count_distinct(F.concat_ws("#", "run_id", "ordinal")).alias("n"))
    both = e.select(F.col("repository_id").alias("node"), F.col("dependency_repository_id").alias("other"), F.lit("out").alias("way"), "n").union(e.select("dependency_repository_id", "repository_id", F.lit("in"), "n"))
    return both.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "other", "way"))).where("k <= 24").drop("k")


@query("""WITH e AS (SELECT repository_id AS source, dependency_repository_id AS target, count(DISTINCT run_id || '#' || ordinal) AS n FROM spec_citations WHERE dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id GROUP BY 1, 2)
SELECT source, target, round(n / (n + 1.0), 6) AS confidence FROM e ORDER BY n DESC, source, target LIMIT 64""")
def cross_repo_candidates(spark, sf):
    """The 64 most certain edges between repositories."""
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "repository_id", "dependency_repository_id").where("dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id")
    e = c.groupBy(F.col("repository_id").alias("source"), F.col("dependency_repository_id").alias("target")).agg(F.count_distinct(F.concat_ws("#", "run_id", "ordinal")).alias("n"))
    return e.orderBy(F.desc("n"), "source", "target").limit(64).select("source", "target", F.round(F.col("n") / (F.col("n") + 1.0), 6).alias("confidence"))


@query(BASE + """, q AS (SELECT DISTINCT repository_id, regexp_extract(cited_path, '([^/]+)$', 1) AS name FROM spec_citations WHERE citation_kind = 'EXISTING_REF' AND cited_path IS NOT NULL)
SELECT n.repository_id, q.name, n.path, n.path = q.name AS is_exact FROM q JOIN newest n ON n.repository_id = q.repository_id AND regexp_extract(n.path, '([^/]+)$', 1) = q.name AND existence_state = 'present'""")
def path_candidates(spark, sf):
    """Present files that a name of a citation may mean, whole paths first."""
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    asked = read_table(spark, sf, "spec_citations", "repository_id", "citation_kind", "cited_path").where("citation_kind = 'EXISTING_REF' AND cited_path IS NOT NULL").select("repository_id", name(F.col("cited_path")).alias("name")).distinct()
    known = latest(spark, sf).where("existence_state = 'present'").select("repository_id", "path", name(F.col("path")).alias("name"))
    return asked.join(known, ["repository_id", "name"]).select("repository_id", "name", "path", (F.col("path") == F.col("name")).alias("is_exact"))
