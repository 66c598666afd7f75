"""Lexers: text to token trees for the grammars. A text that has no token tree gives None."""

from __future__ import annotations

import re

from siftgrain.llm.gll import Grammar, Tree

_OPEN = {"(": "P", "[": "K", "{": "B"}
_CLOSE = {")": "P", "]": "K", "}": "B"}
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?[\d_]+)?)"

_JS = re.compile(
    r"""(?P<ws>[^\S\r\n]+)|(?P<nl>[\r\n]+)|(?P<com>//[^\r\n]*)|(?P<blk>/\*[\s\S]*?\*/)|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"""
    rf"|(?P<num>{_NUM}n?(?![\w$]))|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<priv>\#[^\W\d][\w$]*)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<tick>`)"
    r"|(?P<op>\.\.\.|=>|===|!==|==|!=|\*\*=?|\+\+|--|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|<<=?|<=|[-+*/%&|^]=|[-+*/%&|^!~?:;,.<>=@])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_JS_ENDS = frozenset("ID NUM STR REGEX TEMPLATE PRIVATE } this super null true false undefined ++ --".split())


def lex_javascript(grammar: Grammar, text: str):
    tree, at, flag, n, words = Tree(grammar), 0, False, len(text), grammar.words
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    match = _JS.match
    modes = []  # of each open brace: whether it is inside a template
    while at < n:
        if text[at] == "/" and tree.last not in _JS_ENDS and (m := _JS_REGEX.match(text, at)):
            tree.add("REGEX", flag)
            flag, at = False, m.end()
            continue
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "ws" or kind == "com":
            continue
        if kind == "nl":
            flag = True
            continue
        if kind == "blk":
            flag = flag or "\n" in m[0]
            continue
        if kind == "word":
            word = m[0]
            tree.add(word if word in words else "ID", flag)
            if word in words and word not in grammar.reserved:
                tree.last = "ID"
        elif kind == "op":
            tree.add(m[0], flag)
        elif kind == "open":
            modes.append(False)
            tree.open(_OPEN[m[0]], flag)
        elif kind == "close" or kind == "tick":
            if kind == "close":
                if not modes or not tree.close(_CLOSE[m[0]]):
                    return None
                inside = modes.pop()
            else:
                tree.open("T", flag)
                inside = True
            if inside:  # the template's text up to its end or its next expression
                while True:
                    if at >= n:
                        return None
                    c = text[at]
                    if c == "\\":
                        at += 2
                    elif c == "`":
                        at += 1
                        tree.close("T")
                        break
                    elif c == "$" and text.startswith("{", at + 1):
                        at += 2
                        tree.open("B")
                        modes.append(True)
                        break
                    else:
                        at += 1
        else:
            tree.add({"str": "STR", "num": "NUM", "priv": "PRIVATE"}[kind], flag)
        flag = False
    return None if tree.stack else tuple(tree.cur)


_JAVA = re.compile(
    r"(?P<skip>\s+|//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>\.\.\.|->|::|==|!=|&&|\|\||\+\+|--|<<=?|<=|[-+*/%&|^]=|[-+*/%&|^!~?:;,.<>=@])|(?P<open>[(\[{])|(?P<close>[)\]}])"
    r"""|(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)')"""
    rf"|(?P<num>{_NUM}[lLfFdD]?(?![\w$]))"
)
_RUST = re.compile(
    r"""(?P<skip>\s+|//[^\r\n]*)|(?P<blk>/\*)|(?P<raw>(?:br|cr|r)(?P<h>\#*)"[\s\S]*?"(?P=h))|(?P<str>[bc]?"(?:[^"\\]|\\[\s\S])*")|(?P<chr>b?'(?:[^'\\\r\n]|\\u\{[0-9a-fA-F_]+\}|\\x[0-9a-fA-F]{2}|\\.)')|(?P<life>'[^\W\d]\w*)"""
    r"|(?P<word>r\#[^\W\d]\w*|[^\W\d]\w*)|(?P<num>0[xX][0-9a-fA-F_]+(?:[iu]\w+)?|0[bo][0-7_]+(?:[iu]\w+)?|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w))"
    r"|(?P<op>\.\.\.|\.\.=|\.\.|->|=>|::|==|!=|<<=?|<=|>>=|[-+*/%&|^]=(?!=)|[-+*/%&|^!~?:;,.<>=@#$])|(?P<open>[(\[{])|(?P<close>[)\]}])"
)


def lex_plain(grammar: Grammar, text: str, pattern: re.Pattern = _JAVA):
    """Languages without significant line ends: Java, and Rust with its nested comments."""
    tree, at, n, words, match = Tree(grammar), 0, len(text), grammar.words, pattern.match
    if pattern is _RUST and text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "skip":
            continue
        if kind == "word":
            tree.cur.append(m[0] if m[0] in words else "ID")
        elif kind == "op":
            tree.cur.append(m[0])
        elif kind == "open":
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            if not tree.close(_CLOSE[m[0]]):
                return None
        elif kind == "blk":
            depth = 1
            for c in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if c[0] == "/*" else -1
                if not depth:
                    at = c.end()
                    break
            if depth:
                return None
        else:
            tree.cur.append({"num": "NUM", "chr": "CHAR", "life": "LIFETIME"}.get(kind, "STR"))
    return None if tree.stack else tuple(tree.cur)


_GO = re.compile(
    r"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<com>//[^\n]*)|(?P<blk>/\*[\s\S]*?\*/)|(?P<word>[^\W\d]\w*)|(?P<op>\.\.\.|:=|<-|&\^=?|&&|\|\||\+\+|--|<<=?|>>=?|[=!<>]=|[-+*/%&|^]=|[-+*/%&|^!~:;,.<>=])|(?P<open>[(\[{])|(?P<close>[)\]}])"
    r"""|(?P<str>`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')"""
    rf"|(?P<num>{_NUM}(?:p[+-]?\d+)?i?(?!\w))"
)
_GO_ENDS = frozenset("ID NUM STR } ++ -- break continue fallthrough return".split())


def lex_go(grammar: Grammar, text: str):
    """With the semicolons that Go puts in at line ends."""
    tree, at, n, words, match = Tree(grammar), 0, len(text), grammar.words, _GO.match
    while at < n:
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "ws" or kind == "com":
            continue
        if kind == "nl" or kind == "blk":
            if "\n" in m[0] and tree.last in _GO_ENDS:
                tree.add(";")
        elif kind == "word":
            tree.add(m[0] if m[0] in words else "ID")
        elif kind == "op":
            tree.add(m[0])
        elif kind == "open":
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            if not tree.close(_CLOSE[m[0]]):
                return None
        else:
            tree.add("STR" if kind == "str" else "NUM")
    if tree.last in _GO_ENDS:
        tree.add(";")
    return None if tree.stack else tuple(tree.cur)


_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r\n?|\n)|(?P<com>\#[^\r\n]*)|(?P<str>(?:[bB][rR]?|[rR][bBfFtT]?|[uU][rR]?|[fFtT][rR]?)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'))"""
    rf"|(?P<num>{_NUM}[jJlL]?(?!\w))|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>\.\.\.|\*\*=?|//=?|>>=?|<<=?|!=|->|:=|<>|[-+*/%@&|^<>=]=|[-+*/%@&|^<>=~:;,.])|(?P<open>[(\[{])|(?P<close>[)\]}])"
)


def _width(space: str) -> int:
    width = 0
    for c in space:
        width = width // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else width + 1
    return width


def lex_python(grammar: Grammar, text: str):
    """With NEWLINE tokens, and I groups for indented blocks."""
    tree, at, n, words, match = Tree(grammar), 0, len(text), grammar.words, _PY.match
    levels, depth, fresh, width = [0], 0, True, 0
    while at < n:
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "ws":
            if fresh and m[0][0] != "\\":
                width = _width(m[0])
            continue
        if kind == "com":
            continue
        if kind == "nl":
            if not depth:
                if not fresh:
                    tree.cur.append("NEWLINE")
                fresh, width = True, 0
            continue
        if fresh:
            fresh = False
            if width > levels[-1]:
                levels.append(width)
                tree.open("I")
            while width < levels[-1]:
                levels.pop()
                if not tree.close("I"):
                    return None
            if width != levels[-1]:
                return None
        if kind == "word":
            tree.cur.append(m[0] if m[0] in words else "ID")
        elif kind == "op":
            tree.cur.append(m[0])
        elif kind == "open":
            depth += 1
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            depth -= 1
            if not tree.close(_CLOSE[m[0]]):
                return None
        else:
            tree.cur.append("STR" if kind == "str" else "NUM")
    if depth:
        return None
    if not fresh:
        tree.cur.append("NEWLINE")
    for _ in levels[1:]:
        if not tree.close("I"):
            return None
    return None if tree.stack else tuple(tree.cur)


_JSON = re.compile(
    r"""(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)|(?P<op>[,:])|(?P<open>[\[{])|(?P<close>[\]}])"""
)
_TOML = re.compile(
    r"""(?P<ws>[ \t]+)|(?P<nl>\r\n|\n|\r)|(?P<com>\#[^\r\n]*)|(?P<str>\"\"\"(?:[^\\]|\\[\s\S])*?\"{3,5}(?!\")|'''[\s\S]*?'{3,5}(?!'))|(?P<key>"(?!"")(?:[^"\\\r\n]|\\[btnfre"\\]|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2})*"|'(?!'')[^'\r\n]*')"""
    r"|(?P<date>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?)(?![\w-])"
    r"|(?P<num>[+-]?(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|(?:0|[1-9][\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|inf|nan)(?![\w-]))|(?P<bool>(?:true|false)(?![\w-]))|(?P<bare>[A-Za-z0-9_-]+)|(?P<op>[=.,])|(?P<open>[\[{])|(?P<close>[\]}])"
)


def lex_json(grammar: Grammar, text: str):
    tree, at, n, match = Tree(grammar), 0, len(text), _JSON.match
    while at < n:
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "ws":
            continue
        if kind == "open":
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            if not tree.close(_CLOSE[m[0]]):
                return None
        else:
            tree.cur.append({"str": "STR", "num": "NUM"}.get(kind) or m[0])
    return None if tree.stack else tuple(tree.cur)


def lex_toml(grammar: Grammar, text: str):
    """Line ends count outside brackets only."""
    tree, at, n, match = Tree(grammar), 0, len(text), _TOML.match
    while at < n:
        m = match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind in ("ws", "com"):
            continue
        if kind == "nl":
            if not tree.stack:
                tree.cur.append("NEWLINE")
        elif kind == "open":
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            if not tree.close(_CLOSE[m[0]]):
                return None
        else:
            tree.cur.append({"str": "STR", "key": "KEYSTR", "date": "DATE", "num": "NUM", "bool": "BOOL", "bare": "BARE"}.get(kind) or m[0])
    return None if tree.stack else tuple(tree.cur)


_YAML_LINE = re.compile(r"( *)([^\r\n]*)(\r\n|\r|\n|$)")
_YAML = re.compile(
    r"""(?P<ws>[ \t]+)|(?P<com>(?:(?<=[ \t])|^)\#.*)|(?P<block>[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:[ \t]\#.*)?$)|(?P<dash>-(?=[ \t]|$))|(?P<ques>\?(?=[ \t]|$))|(?P<colon>:(?=[ \t]|$))"""
    r"""|(?P<anchor>&[^\s,\[\]{}]+)|(?P<alias>\*[^\s,\[\]{}]+)|(?P<tag>!(?:<[^>\s]*>|[^\s,\[\]{}]*))|(?P<flow>[\[{])|(?P<quote>["'])"""
    r"""|(?P<plain>(?:[^\s\-?:,\[\]{}\#&*!|>'"%@`]|[-?:](?=[^\s]))(?:[^\s:\#]|:(?=[^\s])|(?<=[^\s])\#|[ \t]+(?=[^\s\#]))*)"""
)
_YAML_FLOW = re.compile(
    r"""(?P<ws>\s+)|(?P<com>(?<=\s)\#[^\r\n]*)|(?P<open>[\[{])|(?P<close>[\]}])|(?P<comma>,)|(?P<ques>\?(?=\s))|(?P<colon>:(?=[\s,\[\]{}])|(?<=["'\]}]):)|(?P<anchor>&[^\s,\[\]{}]+)|(?P<alias>\*[^\s,\[\]{}]+)|(?P<tag>!(?:<[^>\s]*>|[^\s,\[\]{}]*))"""
    r"""|(?P<quoted>"(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*')|(?P<plain>(?:[^\s\-?:,\[\]{}\#&*!|>'"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s:,\[\]{}\#]|:(?=[^\s,\[\]{}])|(?<=[^\s])\#|[ \t]+(?=[^\s\#,\[\]{}:]))*)"""
)
_YAML_QUOTED = {'"': re.compile(r'"(?:[^"\\]|\\[\s\S])*"'), "'": re.compile(r"'(?:[^']|'')*'")}


def lex_yaml(grammar: Grammar, text: str):
    """Lines with NEWLINE tokens, and I groups by column: for deeper lines, and for what follows a dash or question mark."""
    tree, at, n = Tree(grammar), 0, len(text)
    levels = [0]  # columns of the open groups; the first is the document
    first = True
    while at < n:
        m = _YAML_LINE.match(text, at)
        column, line, begin, at = len(m[1]), m[2], m.start(2), m.end()
        if not line.strip(" \t") or line.lstrip(" \t").startswith("#"):
            continue
        mark = line[:3] if column == 0 and (len(line) == 3 or line[3:4] in (" ", "\t")) else ""
        if mark in ("---", "...") or column == 0 and line[0] == "%" and len(levels) == 1 and not any(t != "DIRECTIVE" for t in tree.cur[-1:]):
            while len(levels) > 1:
                levels.pop()
                tree.close("I")
            if line[0] == "%":
                tree.cur.append("DIRECTIVE")
                continue
            tree.cur.append("DOCSTART" if mark == "---" else "DOCEND")
            levels[0], first, line, column = 0, True, line[3:], 0
            if not line.strip():
                continue
            begin += 3
            lead = len(line) - len(line.lstrip())
            line, begin, column = line[lead:], begin + lead, 0
            if line.startswith("#"):
                continue
        if line[0] == "\t" and line.strip()[:1] not in ("]", "}"):
            return None
        if first:
            levels[0], first = column, False
        while column < levels[-1] and len(levels) > 1:
            levels.pop()
            tree.close("I")
        if column < levels[-1]:
            return None
        if column > levels[-1]:
            levels.append(column)
            tree.open("I")
        spot, end = begin, begin + len(line)
        while spot < end:
            m = _YAML.match(text[spot - 1 : end] if spot > begin else text[spot:end], 1 if spot > begin else 0)
            if not m:
                return None
            kind, size = m.lastgroup, len(m[0])
            if kind == "com":
                break
            if kind == "dash" or kind == "ques":
                tree.cur.append(m[0])
                spot += size
                rest = text[spot:end]
                body = rest.lstrip(" \t")
                if body and not body.startswith("#") and body[0] not in "&!|>":
                    levels.append(column + spot - begin + len(rest) - len(body))
                    tree.open("I")
            elif kind == "block":
                tree.cur.append("BLOCK")
                owner = levels[-1] if len(tree.cur) > 1 or len(levels) == 1 else levels[-2]
                parent = -1 if tree.cur[-2:-1] in ([], ["DOCSTART"]) and len(levels) == 1 else owner
                spot = end
                while at < n:  # all deeper or blank lines are its text
                    m = _YAML_LINE.match(text, at)
                    if m[2].strip() and len(m[1]) <= parent or m[1] == m[2] == m[3] == "":
                        break
                    at = m.end()
            elif kind in ("quote", "flow"):
                if kind == "quote":
                    m = _YAML_QUOTED[text[spot]].match(text, spot)
                    stop = m.end() if m else None
                    if m:
                        tree.cur.append("QUOTED")
                else:
                    stop = _flow(tree, text, spot)
                if stop is None:
                    return None
                if stop > end:  # it goes on over several lines; the rest of its last line is read on
                    m = re.compile(r"[^\r\n]*").match(text, stop)
                    end = m.end()
                    at = _YAML_LINE.match(text, stop).end() if True else at
                spot = stop
            else:
                spot += size
                if kind != "ws":
                    tree.cur.append({"colon": ":", "anchor": "ANCHOR", "alias": "ALIAS", "tag": "TAG", "plain": "PLAIN"}[kind])
        tree.cur.append("NEWLINE")
    for _ in levels[1:]:
        tree.close("I")
    return None if tree.stack else tuple(tree.cur)


def _flow(tree: Tree, text: str, at: int):
    """Reads a flow collection; where it ends, or None."""
    depth = 0
    while at < len(text):
        m = _YAML_FLOW.match(text, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "open":
            depth += 1
            tree.open(_OPEN[m[0]])
        elif kind == "close":
            if not tree.close(_CLOSE[m[0]]):
                return None
            depth -= 1
            if not depth:
                return at
        elif kind not in ("ws", "com"):
            tree.cur.append({"comma": ",", "ques": "?", "colon": ":", "anchor": "ANCHOR", "alias": "ALIAS", "tag": "TAG", "quoted": "QUOTED", "plain": "PLAIN"}[kind])
    return None


def lex(language: str, grammar: Grammar, text: str):
    """The token tree of ``text``, a tuple; None if it has none."""
    if language in ("javascript", "typescript"):
        return lex_javascript(grammar, text)
    if language == "rust":
        return lex_plain(grammar, text, _RUST)
    if language == "markdown":
        return ()
    return {"python": lex_python, "java": lex_plain, "go": lex_go, "json": lex_json, "toml": lex_toml, "yaml": lex_yaml}[language](grammar, text)
