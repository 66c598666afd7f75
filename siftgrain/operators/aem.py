"""Files of a content repository: nodes of content descriptions, templates, service configurations and client libraries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "repository_id string, path string, node_type string, name string, start_line int"


def kind_of(path: Column) -> Column:
    """``jcr``, ``htl``, ``osgi``, ``clientlib``, or null for other files."""
    return (
        F.when(path.rlike(r"(^|/)\.content\.xml$"), "jcr").when(path.rlike(r"(^|/)apps/.*\.html$"), "htl")
        .when(path.rlike(r"(^|/)config(\.[\w.-]+)?/[\w.~-]+\.(cfg\.json|cfg|config|xml)$") & path.contains("apps/"), "osgi").when(path.rlike(r"(^|/)clientlibs?/.*(^|/)?(js|css)\.txt$"), "clientlib")
    )


def _jcr(path: str, text: str):
    def walk(element, at):
        here = f"{at}/{element.tag.rsplit('}', 1)[-1]}"
        yield "JCR_NODE", here
        for key, value in element.attrib.items():
            name = key.rsplit("}", 1)[-1]
            edge = {"resourceType": "SLING_RESOURCE_TYPE", "resourceSuperType": "SLING_RESOURCE_SUPER_TYPE", "template": "CQ_TEMPLATE", "embed": "CLIENTLIB_EMBED", "dependencies": "CLIENTLIB_DEPENDENCY"}.get(name)
            if edge:
                for item in re.sub(r"^\{\w+\}|^\[|\]$", "", value).split(",") if edge.startswith("CLIENTLIB") else [value]:
                    yield edge, item.strip()
        for child in element:
            yield from walk(child, here)

    yield from walk(ElementTree.fromstring(text), "")


def _htl(path: str, text: str):
    base = path.rsplit("/", 1)[-1]
    for kind, pattern in (("HTL_TEMPLATE", r"data-sly-template\.(\w+)"), ("HTL_USE", r"data-sly-use\.(\w+)\s*=")):
        for name in re.findall(pattern, text):
            yield kind, f"{base}#{name}"
    for kind, pattern in (("HTL_INCLUDE", r"data-sly-include\s*=\s*[\"']([^\"']+)"), ("SLING_RESOURCE_TYPE", r"resourceType\s*=\s*'([^']+)'")):
        for name in re.findall(pattern, text):
            yield kind, name


def _osgi(path: str, text: str):
    base = re.sub(r"\.(cfg\.json|cfg|config|xml)$", "", path.rsplit("/", 1)[-1])
    pid = base.partition("~")[0]
    yield "OSGI_CONFIG", base
    modes = re.search(r"(?:^|/)config\.([\w.-]+)/", path)
    for mode in modes[1].split(".") if modes else []:
        yield "OSGI_RUN_MODE", mode
    if path.endswith(".json"):
        keys = json.loads(text)
    elif path.endswith(".xml"):
        keys = [k.rsplit("}", 1)[-1] for k in ElementTree.fromstring(text).attrib if "primaryType" not in k]
    else:
        keys = [m[1] for m in re.finditer(r"^\s*([\w.-]+)\s*=", text, re.M)]
    for key in keys:
        yield "OSGI_PROPERTY", f"{pid}#{key}"


def _clientlib(path: str, text: str):
    base = ""
    yield "CLIENTLIB_MANIFEST", path
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("#base="):
            base = line.removeprefix("#base=").rstrip("/") + "/"
        elif line and not line.startswith("#"):
            yield "CLIENTLIB_FILE", ("" if base in ("./", "/") else base) + line


def analyze(files: DataFrame) -> DataFrame:
    """``repository_id, path, node_type, name, start_line`` of the content files among ``files``; one that cannot be read gives one DIAGNOSTIC."""
    readers = {"jcr": _jcr, "htl": _htl, "osgi": _osgi, "clientlib": _clientlib}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repository, path, kind, text in zip(pdf["repository_id"], pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    found = list(readers[kind](path, text or ""))
                except (ElementTree.ParseError, ValueError):
                    found = [("DIAGNOSTIC", path)]
                rows += [(repository, path, node, name, 0) for node, name in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    return files.withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull()).select("repository_id", "path", "kind", "content").mapInPandas(read, NODE)
