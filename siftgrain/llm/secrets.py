"""Credentials in source text: quoted strings and long tokens judged by entropy per alphabet."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Published formats of issued credentials (fixed values).
ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|[srp]k_(?:live|test)_\w{10,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]*)?|npm_\w{30,}|SG\.[\w-]{16,}\.[\w-]{16,}")
#: The beginnings of those, for a value that goes on in a concatenated string.
_ISSUED_START = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[srp]k_(?:live|test)_|AIza|eyJ|npm_|SG\.)")

_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_WHOLE = re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)(.*?)(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)

#: Words of a name that promise a credential, and words that say it is something else.
_PROMISES = re.compile(r"pass(?:wd|word|phrase|code)?(?![a-z])|passwd|password|(?<![a-z])pw(?:d|\b)|pwd|secret|token|api_?key|(?<![a-z])key|_key|Key(?![a-z])|credential|(?<![a-z])creds?\b|auth|login|signing|bearer|connect\(|private", re.I)
_DENIES = re.compile(r"digest|checksum|sha(?:1|256|512)?(?![a-z])|hash|commit|revision|run_?id|request_?id|uuid|fingerprint|integrity|etag|public|verify", re.I)
_PLACEHOLDER = re.compile(
    r"""\$\{|\$\(|\{\{|\}\}|<[^<>]*>|%\(|%s|\bx{4,}\b|x{6,}|\*{3,}|\.{3,}|^env:|^vault:|^ref:|^arn:|^file:|\[?redacted\]?|changeme|change_me|example|placeholder|not-?set|dummy|sample-|your[_-]|todo|none|null|undefined|process\.env|os\.environ|getenv|secretsmanager|^/|^\w+(?:\.\w+)+\(""",
    re.I,
)
#: Names of what people choose, which may be a word and a number.
_CHOSEN = re.compile(r"pass(?:wd|word|phrase|code)(?![a-z])|(?<![a-z])pw(?:d|\b)|pwd", re.I)
#: Password hashes in crypt format.
_CRYPT = re.compile(r"\$[\w-]+\$")
#: What follows a name, not a value.
_NAMES = re.compile(r"[(\[]|\s*(?::?=(?!=)|:)")
#: An unquoted value to the line's end, as in .env, shell, YAML and properties files.
_LITERAL = re.compile(r"\s*(?:-\s+)?(?:(?:export|ENV|ARG|set)\s+)?(?:[A-Z][A-Z0-9_]*=|[\w.-]+:\s+|[a-z][\w-]*(?:\.[\w-]+)+\s*=\s*)\Z")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_BASE32 = re.compile(r"[A-Z2-7]+={0,6}\Z")
_BASE36 = re.compile(r"[a-z0-9]+\Z|[A-Z0-9]+\Z")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}\Z")
_SPECIAL = re.compile(r"[!#$%&*?^~@]")

_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_BARE = re.compile(r"(?<![\w\"'`/.+-])[A-Za-z0-9+/_\-!#$%&*?^~@.=]{8,}")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+)@")
_USER_OPTION = re.compile(r"(?:^|\s)(?:-u|--user)[ =]([^\s:\"']+):([^\s\"']+)")
_HEADER = re.compile(r"(?:Bearer|Token|Basic)\s+([A-Za-z0-9+/=_.\-]{12,})")
#: Between two parts of a concatenated string: an operator, or an escaped line end; spaces, line ends and comments around it.
_GAP = r"(?:\s|(?://|#)[^\n]*\n)*"
_LINK = re.compile(_GAP + r"\)?(?:\+\+?|\.\.?(?!\w)|\.concat\(|\|\||&|<>|\\)" + _GAP + r"[rRbBuUfF@$]{0,2}(?=[\"'`])")
#: Without an operator, strings on successive lines are one only where an expression is open.
_NEXT_LINE = re.compile(r"[ \t]*(?:(?://|#)[^\n]*)?\n\s*[rRbBuUfF]{0,2}(?=[\"'`])")
_IN_EXPRESSION = re.compile(r"(?:(?<!=)\(|[=,:])\s*[rRbBuUfF]{0,2}\Z")
#: A line on which a string may go on that starts on it or before it.
_GOES_ON = re.compile(r"[\"'`]\s*(?:[+.|&<\\)#]|//|$)")
_OPEN_NAME = re.compile(r"([A-Za-z_][\w.-]*)[\"']?(?:\s*:\s*[&\w<>]+)?\s*(?:[:=]|=>|\()\s*\(?\s*(?:[\\|>]-?)?\s*$|([A-Za-z_]\w*)[\"']?\s*=\s*(?:\w+\()?\(?\s*$")
#: What a line must have to hold a candidate at all.
_WORTH = re.compile(r"[A-Za-z_+/!#$%&*?^~-]\d|\d[A-Za-z_+/!#$%&*?^~-]|[A-Za-z]-[A-Za-z]+-[A-Za-z]|[A-Za-z][!#$%&*?^~]\w|A[KS]IA|:[^\s/]+@|(?:-u|--user)[ =]|(?:Bearer|Basic|Token)\s")


def entropy(s: str) -> float:
    """Shannon entropy of a string's characters, in bits."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> tuple[str, int]:
    """The smallest alphabet the string is written in, and its size."""
    if _HEX.match(s):
        return "hex", 16
    if _BASE32.match(s):
        return "base32", 32
    if _BASE36.match(s):
        return "base36", 36
    if _BASE64.match(s):
        return "base64", 64
    return "printable", 94


def threshold(s: str, share: float) -> float:
    """The entropy that ``s`` must reach: a share of what its length and alphabet allow."""
    return share * math.log2(max(2, min(len(s), alphabet(s)[1])))


def is_credential(value: str, name: str) -> bool:
    """Whether a string is a usable credential, ``name`` being the code before it on its line, or the open name on the line before."""
    if len(value) < 6 or " " in value or _PLACEHOLDER.search(value) or _CRYPT.match(value):
        return False
    if _UUID.match(value):
        return False
    if _ISSUED_START.match(value):
        return entropy(value) >= threshold(value, 0.6)
    # what denies is the name itself, not other strings on the line; the key of a pair may be quoted
    own = name if name.rstrip().endswith((":", "=>")) else _QUOTED.sub("", name)
    denied, promised = _DENIES.search(own), _PROMISES.search(name)
    kind = alphabet(value)[0]
    if kind == "hex" and not value.isalpha():
        return bool(promised) and not denied and len(value) >= 16 and entropy(value) >= threshold(value, 0.75)
    if len(value) < 8:
        return False
    mixed = re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and (re.search(r"\d", value) or _SPECIAL.search(value) or value.count("-") >= 2)
    if promised and not denied:
        return bool(mixed or _one_case(value, name)) and entropy(value) >= threshold(value, 0.65)
    # without a promising name only what has all four kinds of characters, which identifiers and data lack
    return bool(mixed and re.search(r"\d", value) and _SPECIAL.search(value) and not re.search(r"[/=+|()]", value)) and entropy(value) >= threshold(value, 0.75)


def _drawn(value: str) -> bool:
    """Whether a value looks drawn at random: letters and digits follow each other three times or more, in a word with a number at most twice; parts of a snake-case name count one by one."""
    part = max(value.split("_"), key=len)
    return len(value) >= 12 and len(part) >= 10 and len(re.findall(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", part)) >= 3


def _one_case(value: str, name: str) -> bool:
    """Whether a value whose letters have one case, under a promising name, is more than a word, an identifier or a version."""
    if not (re.search(r"[A-Za-z]", value) and re.search(r"\d", value)):
        return False
    if _drawn(value):
        return True
    own = re.search(r"[A-Za-z_][\w-]*[\"'\]]*\s*(?::[^:=]*)?(?::|=|=>|\()?\s*\Z", name)
    return bool(own and _CHOSEN.search(own[0]) and (value.isalnum() or _SPECIAL.search(value)))


def find_credentials(text: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """(line from 1, spans) of each credential value in the text, in order; a value in concatenated strings has the line of its first part and the spans of all of them."""
    found, at, before = [], 0, ""
    spans: list[tuple[int, int]] = []
    keys = [(m.start(), m.end(), m.start(2), m.end(2)) for m in _PRIVATE_WHOLE.finditer(text)] if "PRIVATE KEY" in text else []
    done: list[tuple[int, int]] = []  # parts of values that began on a line before
    for number, line in enumerate(text.split("\n"), 1):
        if "PRIVATE KEY-----" in line or "PRIVATE KEY BLOCK" in line:
            for begin, end, a, b in keys:
                if at <= begin <= at + len(line) and not re.match(r"[\s\\n\"']*(?:\[?REDACTED|<|\.\.\.|\*\*\*)", text[a : a + 24]):
                    found.append((number, [(a, b)]))
                    spans.append((begin, end))
        done = [x for x in done if x[1] > at]
        if (len(line) > 7 and _WORTH.search(line) or _GOES_ON.search(line)) and not any(a < at + len(line) and at < b for a, b in spans):
            for value in _in_line(text, at, line, before, done):
                found.append((number, value))
                done += value
        before, at = line, at + len(line) + 1
    return found


def _parts(text: str, m: re.Match[str]) -> tuple[list[tuple[int, int]], int]:
    """The spans of the strings that are concatenated to the quoted string ``m``, its own first, over line ends too; and where they end."""
    spans, end = [m.span(m.lastindex)], m.end()
    lead = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
    if not lead.strip(" \trRbBuUfF"):
        lead = text[max(0, m.start() - 200) : m.start()]
    open_ = _IN_EXPRESSION.search(lead)
    while (link := _LINK.match(text, end) or open_ and _NEXT_LINE.match(text, end)) and (after := _QUOTED.match(text, link.end())):
        spans.append(after.span(after.lastindex))
        end = after.end()
    return spans, end


def _cut(parts: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """The spans that hold characters ``a`` to ``b`` of the joined parts."""
    out, at = [], 0
    for x, y in parts:
        lo, hi = max(a, at), min(b, at + y - x)
        if lo < hi:
            out.append((x + lo - at, x + hi - at))
        at += y - x
    return out


def _user_passwords(line: str) -> Iterator[tuple[int, int]]:
    for pattern, sign in ((_USERINFO, "://"), (_USER_OPTION, "-u")):
        for m in pattern.finditer(line) if sign in line else ():
            if len(m[2]) >= 6 and not _PLACEHOLDER.search(m[2]) and entropy(m[2]) >= 2:
                yield m.span(2)


def _header_values(line: str) -> Iterator[tuple[int, int]]:
    for m in _HEADER.finditer(line) if "Bearer" in line or "Token" in line or "Basic" in line else ():
        value = m[1]
        if not _PLACEHOLDER.search(value) and not _UUID.match(value) and entropy(value) >= threshold(value, 0.65) and re.search(r"\d|[A-Z].*[a-z]|[a-z].*[A-Z]", value):
            yield m.span(1)


def _in_line(text: str, at: int, line: str, before: str, done: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The spans of each credential value that begins on the line at ``at``; ``done`` has spans taken before."""
    taken: list[list[tuple[int, int]]] = []
    held = [(a - at, b - at) for a, b in done]
    free = lambda a, b: all(b <= x or y <= a for x, y in held)

    def take(parts: list[tuple[int, int]]) -> None:
        taken.append(parts)
        held.extend((a - at, b - at) for a, b in parts)

    quoted = list(_QUOTED.finditer(line))
    joined = {}
    for m in quoted:
        if _GOES_ON.match(line, m.end() - 1):
            parts, end = _parts(text, _QUOTED.match(text, at + m.start()))
            if len(parts) > 1:
                joined[m.start()] = parts, end - at
    for parts, _ in joined.values():
        value = "".join(text[a:b] for a, b in parts)
        for a, b in [*_user_passwords(value), *_header_values(value)]:
            spans = _cut(parts, a, b)
            # what begins in a later line is found there
            if spans[0][0] < at + len(line) and all(free(x - at, y - at) for x, y in spans):
                take(spans)
    for a, b in [*_user_passwords(line), *_header_values(line)]:
        if free(a, b):
            take([(at + a, at + b)])
    opened = _OPEN_NAME.search(before) if before.rstrip()[-1:] in ("=", ":", "(", "|", ">", "\\", "-") else None
    carried = before[opened.start() :] if opened else ""
    last = -1
    for m in quoted:
        if m.start() < last:
            continue
        parts, end = joined.get(m.start(), ([(at + m.start(m.lastindex), at + m.end(m.lastindex))], m.end()))
        parts = [x for x in parts if x[0] < x[1]]
        value = "".join(text[a:b] for a, b in parts)
        name = line[: m.start()] if line[: m.start()].strip(" \t([,{") else carried
        if all(free(a - at, b - at) for a, b in parts) and is_credential(value, name):
            take(parts)
            last = end
    for m in _BARE.finditer(line):
        inside = any(q.start() < m.end() and m.start() < q.end() for q in quoted)
        value = m[0].rstrip(".,;")
        name = line[: m.start()] if line[: m.start()].strip(" \t-") else carried
        # bare: the word right before says what it is (pw=, key, login x /, NAME: value)
        cue = re.search(r"([A-Za-z_][\w-]*)\s*(?:[:=]\s*|\s+(?:\w+\s*/\s*)?)$", name)
        eq = value.find("=")
        if eq > 0 and _PROMISES.search(value[:eq]) and eq + 1 < len(value.rstrip("=")):
            cue, name, start = True, value[: eq + 1], m.start() + eq + 1
            value = value[eq + 1 :]
        else:
            start = m.start()
        stop = start + len(value)
        # a word in code is a variable, unless it looks drawn at random; in settings it is the value itself
        literal = _LITERAL.match(line[:start]) and not line[stop:].strip() and not re.fullmatch(r"\$\w+", value)
        promised = _PROMISES.search(name) and (literal or not re.fullmatch(r"\w+", value) or _drawn(value) and not _NAMES.match(line, stop))
        if not inside and cue and free(start, stop) and (ISSUED.match(value) or promised or _HEX.match(value) or _special_bare(value)) and is_credential(value, name):
            take([(at + start, at + start + len(value))])
    return sorted(taken)


def _special_bare(value: str) -> bool:
    return bool(re.search(r"\d", value) and (_SPECIAL.search(value) or value.count("-") >= 2))


def redact(text: str, mark: str = "[REDACTED]") -> tuple[str, int]:
    """The text with each credential value replaced by ``mark`` between its quotes, so that the code around it is intact, and their number.

    Of a private key its body is replaced, line ends kept; of a value in
    concatenated strings every part.
    """
    found = find_credentials(text)
    out, at = [], 0
    for a, b in sorted(x for _, spans in found for x in spans):
        if a < at:
            continue
        body = text[a:b]
        if "\n" in body:  # the body of a key, its indentation and comment marks kept
            body = re.sub(r"(?m)^([ \t#/*]*)\S.*$", lambda m: m[1] + mark, body)
        elif body.startswith("\\n"):
            body = "\\n" + mark + ("\\n" if body.endswith("\\n") else "")
        else:
            body = mark
        out += [text[at:a], body]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _distinct(units: DataFrame) -> DataFrame:
    return units.where(F.col("retrieval_text").isNotNull()).select(F.col("id").alias("unit_id"), "retrieval_text")


def credential_lines(units: DataFrame) -> DataFrame:
    """``unit_id, line_no`` of each line (from 1) on which a credential value begins, one row per line.

    ``units`` has ``id, retrieval_text``. Quoted strings, concatenations of
    them, header values, user information of addresses and long bare tokens are
    candidates; each alphabet has a threshold of entropy that grows with the
    length and is lower under a promising name; digests, identifiers, public
    keys, references and placeholders are left out. Every text is read whole, in
    the task that holds it; only finds are shuffled, to fold redelivered units.
    Null and empty texts have no finds.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(unit, n) for unit, text in zip(pdf["unit_id"], pdf["retrieval_text"]) for n in sorted({f[0] for f in find_credentials(text)})]
            yield pd.DataFrame(rows, columns=["unit_id", "line_no"])

    return _distinct(units).mapInPandas(scan, "unit_id string, line_no int").distinct()


def redact_units(units: DataFrame) -> DataFrame:
    """``unit_id, n_credentials, redacted_text`` of each unit that holds a credential; see redact."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, text in zip(pdf["unit_id"], pdf["retrieval_text"]):
                clean, n = redact(text)
                if n:
                    rows.append((unit, n, clean))
            yield pd.DataFrame(rows, columns=["unit_id", "n_credentials", "redacted_text"])

    return _distinct(units).mapInPandas(scan, "unit_id string, n_credentials int, redacted_text string").dropDuplicates(["unit_id"])
