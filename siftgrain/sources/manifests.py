"""Dependency manifests: what a repository provides and declares, from eleven file formats."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "repository_id string, path string, role string, ecosystem string, name string, version string, kind string, hint string"
NAMES = r"(^|/)(go\.mod|package\.json|pom\.xml|settings\.gradle(\.kts)?|build\.gradle(\.kts)?|pyproject\.toml|requirements[^/]*\.txt|\.gitmodules|MANIFEST\.MF|\.content\.xml|[^/]*\.proto)$"


def python_name(name: str) -> str:
    """A Python project name in its normal form."""
    return re.sub(r"[-_.]+", "-", name).lower()


def parse_manifest(path: str, text: str) -> list[tuple]:
    """(role, ecosystem, name, version, kind, hint) rows; role provides, declares or diagnostic. A text that cannot be read gives one diagnostic."""
    base = path.rsplit("/", 1)[-1]
    for pattern, reader in _READERS:
        if re.fullmatch(pattern, base):
            try:
                return list(reader(path, text))
            except (ValueError, ET.ParseError, KeyError, TypeError, AttributeError) as error:
                return [("diagnostic", None, base, None, type(error).__name__, None)]
    return []


def _go(path, text):
    block = None
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if block:
            if line == ")":
                block = None
                continue
            line = f"{block} {line}" if line else ""
        elif m := re.fullmatch(r"(require|replace)\s*\(", line):
            block = m[1]
            continue
        if m := re.match(r"module\s+(\S+)", line):
            yield "provides", "GO", m[1], None, None, None
        elif m := re.match(r"require\s+(\S+)\s+(\S+)", line):
            yield "declares", "GO", m[1], m[2], "External", None
        elif m := re.match(r"replace\s+(\S+)(?:\s+\S+)?\s+=>\s+(\S+)(?:\s+(\S+))?", line):
            local = m[2].startswith((".", "/"))
            yield "declares", "GO", m[1], m[3], "LocalPath" if local else "External", m[2] if local else None


def _npm(path, text):
    data = json.loads(text)
    if data.get("name"):
        yield "provides", "NPM", data["name"], None, None, None
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, version in (data.get(section) or {}).items():
            local = re.match(r"(?:file:|link:)?(\.{1,2}/.*|/.*)|(?:file:|link:)(.*)", str(version))
            yield "declares", "NPM", name, None if local else str(version), "LocalPath" if local else "External", (local[1] or local[2]) if local else None
    spaces = data.get("workspaces") or []
    for member in spaces.get("packages", []) if isinstance(spaces, dict) else spaces:
        yield "declares", "NPM", member, None, "WorkspaceMember", member


def _maven(path, text):
    root = ET.fromstring(text)
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    child = lambda e, n: next(((c.text or "").strip() for c in e if tag(c) == n), "")
    group, artifact = child(root, "groupId"), child(root, "artifactId")
    if group and artifact:
        yield "provides", "MAVEN", f"{group}:{artifact}", None, None, None
    for e in root.iter():
        if tag(e) == "dependency":
            g, a = child(e, "groupId"), child(e, "artifactId")
            if not g or not a or "$" in g + a:
                yield "diagnostic", "MAVEN", f"{g}:{a}", None, "incomplete", None
            else:
                yield "declares", "MAVEN", f"{g}:{a}", child(e, "version") or None, "External", None
        elif tag(e) == "module" and (e.text or "").strip():
            yield "declares", "MAVEN", e.text.strip(), None, "WorkspaceMember", e.text.strip()


def _gradle_settings(path, text):
    if m := re.search(r"rootProject\.name\s*=\s*[\"']([^\"']+)", text):
        yield "provides", "GRADLE", m[1], None, None, None
    for call in re.findall(r"^\s*include\s*\(?([^\n)]*)", text, re.M):
        for name in re.findall(r"[\"']([^\"']+)[\"']", call):
            yield "declares", "GRADLE", name, None, "WorkspaceMember", name.lstrip(":").replace(":", "/")


def _gradle_build(path, text):
    for m in re.finditer(r"\bdependencies\s*\{", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        for line in text[m.end() : at].splitlines():
            if p := re.search(r"project\(\s*(?:path:\s*)?[\"']:?([^\"']+)", line):
                yield "declares", "GRADLE", p[1], None, "LocalPath", p[1].replace(":", "/")
            elif p := re.search(r"[\"']([\w.-]+:[\w.-]+)(?::([^\"'@]+))?", line):
                yield "declares", "GRADLE", p[1], p[2], "External", None
            elif p := re.search(r"group:\s*[\"']([^\"']+)[\"'],\s*name:\s*[\"']([^\"']+)[\"'](?:,\s*version:\s*[\"']([^\"']+))?", line):
                yield "declares", "GRADLE", f"{p[1]}:{p[2]}", p[3], "External", None


_REQUIREMENT = re.compile(r"([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([<>=!~].*)?")


def _pyproject(path, text):
    project = tomllib.loads(text.replace("\r\n", "\n")).get("project", {})
    if project.get("name"):
        yield "provides", "PYTHON", python_name(project["name"]), None, None, None
    for entry in project.get("dependencies", []):
        if m := _REQUIREMENT.match(entry.split(";")[0].strip()):
            yield "declares", "PYTHON", python_name(m[1]), (m[2] or "").strip() or None, "External", None


def _requirements(path, text):
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).strip()
        line = re.sub(r"^(-e|--editable)\s+", "", line)
        if not line or line.startswith("-"):
            continue
        if re.match(r"\.{0,2}/|\.$|file:", line):
            yield "declares", "PYTHON", f"path:{line}", None, "LocalPath", line
        elif m := _REQUIREMENT.match(line.split(";")[0].strip()):
            yield "declares", "PYTHON", python_name(m[1]), (m[2] or "").strip() or None, "External", None


def _submodules(path, text):
    for name, body in re.findall(r"\[submodule\s+\"([^\"]+)\"\]([^\[]*)", text):
        if m := re.search(r"^\s*path\s*=\s*(\S+)", body, re.M):
            yield "declares", "SUBMODULE", name, None, "LocalPath", m[1]


def _proto(path, text):
    for spec in re.findall(r"^\s*import\s+(?:public\s+|weak\s+)?\"([^\"]+)\"\s*;", text, re.M):
        yield "declares", "GENERATED_API", spec, None, "External", spec


def _component(path, text):
    if m := re.search(r"(?:^|/)(apps/.*?components/.*)/\.content\.xml$", path):
        yield "provides", "AEM_COMPONENT", m[1].removeprefix("apps/"), None, None, None
        if s := re.search(r"sling:resourceSuperType=\"([^\"]+)\"", text):
            yield "declares", "AEM_COMPONENT", s[1].removeprefix("/apps/"), None, "External", None


def _bundle(path, text):
    unfolded = re.sub(r"\r?\n ", "", text)
    headers = dict(re.findall(r"^([\w-]+):\s*(.*?)\r?$", unfolded, re.M))
    if "Bundle-SymbolicName" not in headers:
        return
    split = lambda v: [x for x in re.split(r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", v) if x.strip()]
    yield "provides", "OSGI", headers["Bundle-SymbolicName"].split(";")[0].strip(), None, None, None
    for item in split(headers.get("Export-Package", "")):
        yield "provides", "OSGI", item.split(";")[0].strip(), None, None, None
    for item in split(headers.get("Import-Package", "")):
        version = re.search(r"version=\"?([^\";]+)", item)
        yield "declares", "OSGI", item.split(";")[0].strip(), version[1] if version else None, "External", None


_READERS = [
    (r"go\.mod", _go), (r"package\.json", _npm), (r"pom\.xml", _maven), (r"settings\.gradle(?:\.kts)?", _gradle_settings), (r"build\.gradle(?:\.kts)?", _gradle_build), (r"pyproject\.toml", _pyproject),
    (r"requirements.*\.txt", _requirements), (r"\.gitmodules", _submodules), (r".*\.proto", _proto), (r"\.content\.xml", _component), (r"MANIFEST\.MF", _bundle),
]


def scan_manifests(files: DataFrame) -> DataFrame:
    """What all manifests among files (``repository_id, path, content``) provide and declare; other files are left out before Python sees them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, p, *row) for r, p, text in zip(pdf["repository_id"], pdf["path"], pdf["content"]) for row in parse_manifest(p, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])

    return files.where(F.col("path").rlike(NAMES)).select("repository_id", "path", "content").mapInPandas(read, ROW)
