"""Generated, minified, vendored files and data blobs: a linear support-vector classifier over hashed n-grams and path components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash space of the features (2**BITS weights, 1 MiB as float32).
BITS = 18
#: Length of a character n-gram.
GRAM = 5
#: Rows that the classifier is fitted on at most, and the largest text among them.
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 40_000
#: The margin from which a file counts as not hand-written, whatever its labels would be. Of all files of sf0.1, each scored by a
#: machine that saw none of its repository, all labelled ones but one have more, and all others less.
MARGIN = -0.2

CODE = frozenset("py pyi java js mjs cjs jsx ts tsx go rs c h cc cpp hpp cs kt scala rb php swift lua".split())
_VENDOR_DIRS = frozenset("vendor vendored node_modules 3rdparty third_party third-party thirdparty external externals deps upstream pods bower_components site-packages jspm_packages".split())
_GENERATED_DIRS = frozenset("generated autogen gen generated-sources __generated__ autogenerated".split())
_GENERATED_NAME = re.compile(r"_pb2(?:_grpc)?\.pyi?$|\.pb\.\w+$|\.g\.\w+$|[._-](?:auto)?generated\.\w+$|^zz_generated|[._-]gen\.\w+$|[._-]autogen\.\w+$", re.I)
_MINIFIED_NAME = re.compile(r"[.-]min\.\w+$|\.bundle\.\w+$|\.chunk\.\w+$|[.-][0-9a-f]{8,20}\.(?:js|css|mjs)$", re.I)

_GENERATED_TEXT = re.compile(
    r"code generated by|auto-?generated|@generated|<auto-generated|generated (?:by|from|with|on|file|code|automatically)|machine[- ]generated|automatically (?:generated|produced)|produced automatically|"
    r"do not (?:edit|modify)(?! the order)|not edit (?:this|by hand|manually)|edits are lost|changes will be (?:lost|overwritten)|re-?run `|instead of changing it|erzeugt\b|nicht bearbeiten|généré|ne pas modifier|generado|no editar",
    re.I,
)
_VENDORED_TEXT = re.compile(
    r"spdx-license-identifier|licensed under|\(c\) the \S+ authors|copyright .{0,40}(?:contributors|authors)|imported verbatim|originally part of|vendored from|copied from|^\W*upstream:|local patches|mit license|apache license|all rights reserved\. redistribution", re.I | re.M
)
_OWN = re.compile(r"written by hand|not vendored|we own this", re.I)
_COMMENT = re.compile(r"\s*(?://|#(?!\[|!\[)|/?\*|--|;|<!--|\"\"\"|''')")
_LITERAL_LINE = re.compile(r"[\s\[\](){},;]*(?:(?:-?(?:0x[0-9a-fA-F]+|\d[\d_.eE+-]*)|\"[^\"\s]{24,}\"|'[^'\s]{24,}')[\s\[\](){},;]*)+\Z")


def _apart(text: str) -> tuple[str, str]:
    """The leading comments and the rest of the text, byte-order mark and shebang in neither."""
    head, rest, closing = [], [], ""
    lines = text.removeprefix("\ufeff").splitlines(keepends=True)
    for k, line in enumerate(lines):
        plain = line.strip()
        if closing:
            closing = "" if closing in plain else closing
        elif line.startswith("#!") and not k:
            continue
        elif plain and not _COMMENT.match(line):
            rest = lines[k:]
            break
        else:
            for mark, end in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                if plain.startswith(mark) and end not in plain[len(mark) :]:
                    closing = end
        head.append(line)
    return "".join(head), "".join(rest)


def head_of(text: str) -> str:
    """The whole run of leading comments, docstrings and blank lines up to the first line of code, however long; block comments included."""
    return _apart(text)[0]


def evidence(path: str, text: str) -> set[str]:
    """What plainly shows that nobody wrote the file by hand: generated, minified, vendored, data."""
    parts = path.lower().replace("\\", "/").split("/")
    found = set()
    if _VENDOR_DIRS & set(parts[:-1]):
        found.add("vendored")
    if _GENERATED_DIRS & set(parts[:-1]) or _GENERATED_NAME.search(parts[-1]):
        found.add("generated")
    if _MINIFIED_NAME.search(parts[-1]):
        found.add("minified")
    head = head_of(text)
    if head and not _OWN.search(head):
        if _GENERATED_TEXT.search(head):
            found.add("generated")
        if _VENDORED_TEXT.search(head):
            found.add("vendored")
    if parts[-1].rpartition(".")[2] in CODE:
        lines = [x for x in text.splitlines() if x.strip()]
        size = sum(map(len, lines))
        if size >= 100:
            packed = sum(len(x) for x in lines if len(x) >= 100 and x.count(";") + x.count("{") >= len(x) / 80 and x.count(" ") < len(x) / 8)
            if packed > 0.7 * size:
                found.add("minified")
            if sum(len(x) for x in lines if len(x) > 16 and _LITERAL_LINE.match(x)) > 0.7 * size:
                found.add("data")
    return found


_FOLD = bytes((ord("0") if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 if c in (9, 13) else 128 if c >= 128 else c) for c in range(256))
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9a-f]{8,}|\d+")


def _grams(text: str, salt: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8).astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    h = np.full(len(data) - GRAM + 1, 2166136261 ^ salt, np.uint32)
    for i in range(GRAM):
        h = (h ^ data[i : len(data) - GRAM + 1 + i]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def _unit(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, n = np.unique(group, return_counts=True)
    v = np.log1p(n)
    return i, v / np.sqrt((v * v).sum())


def views(path: str, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of a file, and those with its leading comments and path masked; see features."""
    head, body = _apart(text)
    text = text.removeprefix("\ufeff")
    lines = text.splitlines() or [""]
    longest, size = max(map(len, lines)), max(1, len(text))
    shape = [f"longest:{longest.bit_length()}", f"mean:{(size // len(lines)).bit_length()}", f"digits:{sum(map(text.count, '0123456789')) * 10 // size}", f"blank:{(text.count(' ') + text.count(chr(10))) * 10 // size}"]
    parts = path.replace("\\", "/").split("/")
    stem, _, ext = parts[-1].rpartition(".")
    plain = [f"ext:{ext.lower()}", *shape]
    folders = [f"dir:{p.lower()}" for p in parts[:-1]]
    pieces = [p for p in re.split(r"[._-]", stem) if p]
    hexed = lambda p: "HEX" if re.fullmatch(r"[0-9a-f]{8,}", p) and re.search(r"\d", p) else p.lower()
    # how a name begins and ends, marks included
    name = [f"first:{hexed(p)}" for p in pieces[:2]] + [f"last:{hexed(p)}" for p in pieces[-2:]] + [f"end:{hexed(m)}" for m in re.findall(r"[._-][A-Za-z0-9]+(?=[._-]|\Z)", "_" + stem)[-1:]]
    named = lambda ws: _unit(np.array([crc32(w.encode()) >> (32 - BITS) for w in ws], np.uint32))
    shared = [_unit(g) for g in [_grams(body, 1)] if len(g)]
    said = re.findall(r"[^\W_]+", head.lower())
    told = [_unit(g) for g in [_grams(head, 2)] if len(g)] + [named([f"head:{w}" for w in ws]) for ws in (said, [" ".join(x) for x in zip(said, said[1:])]) if ws]
    out = []
    for groups in ([*shared, *told, *[named(ws) for ws in (plain, folders, name) if ws]], [*shared, named(plain)]):
        out.append((np.concatenate([i for i, _ in groups]), np.concatenate([v for _, v in groups]).astype(np.float32)))
    return out


def features(path: str, text: str, masked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: n-grams of the body and line shapes; unless masked also n-grams, words and word pairs of the leading comments, directories and name parts; of unit length in each group. What evidence says is none of them."""
    return views(path, text)[masked]


def margins(model: tuple[np.ndarray, float], path: str, text: str) -> tuple[float, float]:
    """The margin of a file, and that of its body alone."""
    w, bias = model
    whole, masked = (float(w[i] @ v) + bias for i, v in views(path, text))
    return whole, masked


def fit(rows: list[tuple[str, str]], epochs: int = 6, cost: float = 2.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support-vector machine (L2 loss, dual coordinate descent).

    Labels are the files' evidence. A file whose evidence does not rest on its
    header or path alone is given a second time with both masked, so that the
    body's n-grams learn too.
    """
    examples = []
    for path, text in rows:
        signs = evidence(path, text)
        label = 1.0 if signs else -1.0
        whole, masked = views(path, text)
        examples.append((*whole, label))
        if not signs or evidence("x." + path.rpartition(".")[2], _apart(text)[1]):
            examples.append((*masked, label))
    w = np.zeros(1 << BITS, np.float32)
    if not examples:
        return w, -1.0
    bias, rng = 0.0, np.random.default_rng(seed)
    alpha = np.zeros(len(examples))
    positive = max(1, sum(e[2] > 0 for e in examples))
    weight = {1.0: cost * min(10.0, len(examples) / (2 * positive)), -1.0: cost}
    norms = [float((e[1] * e[1]).sum()) + 1 + 1 / (2 * weight[e[2]]) for e in examples]
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            i, v, y = examples[k]
            gradient = y * (float(w[i] @ v) + bias) - 1 + alpha[k] / (2 * weight[y])
            new = max(0.0, alpha[k] - gradient / norms[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y
                alpha[k] = new
                np.add.at(w, i, np.float32(step) * v)
                bias += step
    return w, bias


def training_sample(files: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most about ``limit`` files, chosen by a hash of their id, spread over all repositories."""
    total = files.select("file_occurrence_id").count()
    every = max(1, -(-total // limit))
    chosen = F.pmod(F.xxhash64("file_occurrence_id", F.lit("sample")), F.lit(every)) == 0
    return files.where(chosen & F.col("path").isNotNull() & (F.octet_length("content") <= SAMPLE_BYTES)).limit(2 * limit)


def classify(files: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """``file_occurrence_id, repository_id, score, reasons, not_handwritten`` of files with ``file_occurrence_id, repository_id, path, content``.

    The machine is fitted on the driver on a bounded sample (``limit`` rows) and
    scores every file, whole and with leading comments and path masked; the
    higher margin is the score, and it alone decides. ``reasons`` tells what
    plain evidence there is beside it. Null contents are judged by their path
    alone, null paths as nameless; no rows give no rows; rows that repeat give
    rows that repeat.
    """
    rows = training_sample(files, limit).select("path", "content").toPandas()
    model = fit(list(zip(rows["path"], rows["content"])))
    sent = files.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, repository, path, text in zip(pdf["file_occurrence_id"], pdf["repository_id"], pdf["path"], pdf["content"]):
                path, text = path or "", text or ""
                margin = max(margins(sent.value, path, text))
                out.append((key, repository, margin, ",".join(sorted(evidence(path, text))) if margin >= MARGIN else "", margin >= MARGIN))
            yield pd.DataFrame(out, columns=["file_occurrence_id", "repository_id", "score", "reasons", "not_handwritten"])

    return files.select("file_occurrence_id", "repository_id", "path", "content").mapInPandas(score, "file_occurrence_id string, repository_id string, score double, reasons string, not_handwritten boolean")


def not_handwritten(files: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """``file_occurrence_id`` of each file that nobody wrote by hand, once."""
    return classify(files, limit).where("not_handwritten").select("file_occurrence_id").distinct()


def validate(files: DataFrame, limit: int = SAMPLE_ROWS, folds: int = 5) -> DataFrame:
    """``repository_fold, n, n_labelled, recall, precision, n_body, body_found, n_plain, plain_flagged`` on the sample, each fold's repositories held out of the fit; one row per fold.

    The labels are the files' evidence, which is no feature; recall and precision
    are those of the decision that classify makes. ``n_body`` files show it in
    their body alone; of these ``body_found`` pass with header and path masked,
    as do ``plain_flagged`` of the ``n_plain`` files without evidence.
    """
    rows = training_sample(files, limit).select("repository_id", "path", "content").toPandas()
    fold = rows["repository_id"].fillna("").map(lambda r: crc32(r.encode()) % folds)
    out = []
    for k in range(folds):
        train, test = rows[fold != k], rows[fold == k]
        if len(test):
            model = fit(list(zip(train["path"], train["content"])))
            got = np.array([margins(model, p, t) for p, t in zip(test["path"], test["content"])])
            truth = np.array([bool(evidence(p, t)) for p, t in zip(test["path"], test["content"])])
            body = np.array([bool(evidence("x." + p.rpartition(".")[2], _apart(t)[1])) for p, t in zip(test["path"], test["content"])])
            guess, alone = got.max(1) >= MARGIN, got[:, 1] >= MARGIN
            both = int((guess & truth).sum())
            out.append((k, len(test), int(truth.sum()), round(both / max(1, int(truth.sum())), 4), round(both / max(1, int(guess.sum())), 4), int(body.sum()), int((body & alone).sum()), int((~truth).sum()), int((~truth & alone).sum())))
    return files.sparkSession.createDataFrame(out, "repository_fold int, n int, n_labelled int, recall double, precision double, n_body int, body_found int, n_plain int, plain_flagged int")
