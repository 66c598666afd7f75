"""Generalised LL recognition with a graph-structured stack, over token trees.

A grammar is written in EBNF and compiled to a recursive transition network.
A recogniser run explores descriptors (state, stack node, position); stack nodes
are shared by (nonterminal, position), so ambiguity costs no exponential work,
and several start symbols - the dialects of a language - run over one stack.

Text comes as a token tree: what stands between matching brackets (or in an
indented block) is one group token. Equal groups are one object, and whether a
nonterminal derives a group is told once. That changes no result, since brackets
match in every language here; it only makes repeated code cheap.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([A-Z])\{([\w~]+)\}|%(\w+)|([\w~]+)|([()?*+|]))")
TOKEN, GROUP, CALL, ZERO = range(4)

#: Entries of the memo tables of one grammar, after which they start anew.
MEMO_LIMIT = 400_000


def _begins_line(token):
    return token < 0 if isinstance(token, int) else token[0] == "\n"


class Grammar:
    """A language: EBNF ``rules`` as text, ``reserved`` words that are no identifiers,
    ``classes`` of tokens, ``dialects`` (start symbol by name) and ``lists``.

    In the rules ``'x'`` is a token, ``UPPER`` a token class, ``P{N}`` a group
    whose content is an N, ``%nl`` says that a line or the input ends here, and
    ``ANY`` is any token or group.

    ``lists`` maps a nonterminal to (part, last, cut) or (part, last, cut,
    first): it derives every sequence of a first (else a part), parts and a last;
    ``cut`` splits a token sequence into candidates. If all candidates are
    derived, so is the whole; if not, the whole is run. At a cut ``%nl`` holds
    only if the next candidate begins a line.

    ``overrides`` maps a dialect to rules that differ; nonterminals that don't
    reach one are shared with the base grammar.
    """

    def __init__(self, rules, dialects, reserved=(), classes=None, lists=None, overrides=None):
        source = self._split(rules)
        self.starts = {}
        for dialect, start in dialects.items():
            changed = self._split((overrides or {}).get(dialect, ""))
            if changed:
                start = self._variant(source, changed, start, dialect)
            self.starts[dialect] = start
        lists = dict(lists or {})
        for name in list(source):
            base, _, dialect = name.partition("~")
            if dialect and base in lists:
                part, last, cut, *first = lists[base]
                own = lambda n: f"{n}~{dialect}" if f"{n}~{dialect}" in source else n
                lists[name] = (own(part), own(last), cut, *map(own, first))
        self.lists = lists
        self.reserved = frozenset(reserved)
        self.classes = {k: frozenset(v) for k, v in (classes or {}).items()}
        self.words = {w for w in (*self.reserved, *(x for v in self.classes.values() for x in v)) if re.match(r"[^\W\d]", w) and w not in ("ID", "NUM", "STR", "CHAR")}
        self._eps, self._raw = [], []
        self.entry, ends = {}, {}
        for name, text in source.items():
            self.entry[name], ends[name] = self._alternatives(_Reader(text, name))
        final = set(ends.values())
        for name in {e[1] for es in self._raw for e in es if e[0] == CALL} | {e[2] for es in self._raw for e in es if e[0] == GROUP} | {*self.starts.values()}:
            if name not in self.entry:
                raise ValueError(f"no rule {name}")
        self.edges, self.final = [], []
        for state in range(len(self._raw)):
            closure, todo = {state}, [state]
            while todo:
                for x in self._eps[todo.pop()]:
                    if x not in closure:
                        closure.add(x)
                        todo.append(x)
            self.edges.append(tuple(e for s in sorted(closure) for e in self._raw[s]))
            self.final.append(bool(closure & final))
        self._first()
        self._matches = {}
        self.forget()

    @staticmethod
    def _split(text):
        rules = {}
        for chunk in re.split(r"\n(?=\w+ =)", "\n" + text.strip("\n")):
            if chunk.strip():
                name, _, body = chunk.partition("=")
                rules[name.strip()] = body
        return rules

    @staticmethod
    def _variant(source, changed, start, dialect):
        """Adds to ``source`` copies, named ``N~dialect``, of the rules that reach a changed one."""
        base = {k: v for k, v in source.items() if "~" not in k} | changed
        uses = {k: {m[2] or m[4] for m in (x.groups() for x in _META.finditer(v)) if m[2] or m[4]} for k, v in base.items()}
        own, size = set(changed), 0
        while size != len(own):
            size = len(own)
            own |= {k for k, v in uses.items() if v & own}
        for name in own:
            source[f"{name}~{dialect}"] = re.sub(r"'(?:[^'\\]|\\.)*'|\b\w+\b", lambda m: f"{m[0]}~{dialect}" if m[0] in own else m[0], base[name])
        return f"{start}~{dialect}" if start in own else start

    def _state(self):
        self._raw.append([])
        self._eps.append([])
        return len(self._raw) - 1

    def _alternatives(self, r):
        start, end = self._state(), self._state()
        while True:
            at = self._state()
            self._eps[start].append(at)
            while (piece := r.peek()) and piece[5] not in ("|", ")"):
                at = self._piece(r, at)
            self._eps[at].append(end)
            if r.peek() and r.peek()[5] == "|":
                r.next()
            else:
                return start, end

    def _piece(self, r, at):
        literal, bracket, inner, zero, name, mark = r.next()
        to = self._state()
        if mark == "(":
            start, to = self._alternatives(r)
            self._eps[at].append(start)
            r.next()
        elif literal is not None:
            literal = re.sub(r"\\(.)", r"\1", literal)
            if re.match(r"\w", literal):
                self.words.add(literal)
            self._raw[at].append((TOKEN, literal, None, to))
        elif bracket:
            self._raw[at].append((GROUP, bracket + "{", inner, to))
        elif zero:
            self._raw[at].append((ZERO, zero, None, to))
        elif re.fullmatch(r"[A-Z]+", name):
            self._raw[at].append((TOKEN, name, None, to))
        else:
            self._raw[at].append((CALL, name, None, to))
        repeat = r.peek()[5] if r.peek() else None
        if repeat in ("?", "*", "+"):
            r.next()
            begin, after = self._state(), self._state()
            # the piece was built from at; route it through its own states, so that repeating is local
            self._raw[begin], self._raw[at] = ([self._raw[at].pop()], self._raw[at]) if mark != "(" else ([], self._raw[at])
            if mark == "(":
                self._eps[begin].append(self._eps[at].pop())
            self._eps[at].append(begin)
            self._eps[to].append(after)
            if repeat in "?*":
                self._eps[begin].append(after)
            if repeat in "*+":
                self._eps[to].append(begin)
            return after
        return to

    def _first(self):
        self.first = {n: set() for n in self.entry}
        self.nullable = {n: False for n in self.entry}
        changed = True
        while changed:
            changed = False
            for name, entry in self.entry.items():
                first, null, todo, seen = set(), False, [entry], set()
                while todo:
                    state = todo.pop()
                    if state in seen:
                        continue
                    seen.add(state)
                    null = null or self.final[state]
                    for kind, a, _, to in self.edges[state]:
                        if kind in (TOKEN, GROUP):
                            first.add(a)
                        elif kind == ZERO:
                            todo.append(to)
                        else:
                            first |= self.first[a]
                            if self.nullable[a]:
                                todo.append(to)
                if first != self.first[name] or null != self.nullable[name]:
                    self.first[name], self.nullable[name], changed = first, null, True

    def forget(self):
        """Empties the memo tables and the table of groups."""
        self.ids, self.table, self.memo = {}, [("", ())], {}

    def group(self, bracket, tokens):
        """The number of a group; equal groups have one number."""
        key = (bracket, tokens)
        number = self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.table)
            self.table.append(key)
        return number

    def _match(self, token):
        found = self._matches.get(token)
        if found is None:
            plain = token[1:] if token[0] == "\n" else token
            found = {plain, "ANY"} | {k for k, v in self.classes.items() if plain in v}
            if plain in self.words:
                found.add("NAME")
                if plain not in self.reserved:
                    found.add("ID")
            elif plain == "ID":
                found.add("NAME")
            found = self._matches[token] = frozenset(found)
        return found

    def derives(self, names, tokens, line_end=True):
        """Those of ``names`` that derive the token sequence; ``line_end``: a line or the input ends after it."""
        answers = {}
        for name in names:
            if (name, tokens, line_end) in self.memo:
                answers[name] = self.memo[name, tokens, line_end]
        left = [n for n in names if n not in answers]
        for name in list(left):
            if name in self.lists:
                part, last, cut, *first = self.lists[name]
                pieces = cut(tokens)
                good = len(pieces) > 1
                for i, piece in enumerate(pieces):  # no generator: nesting must not use the C stack
                    if not good:
                        break
                    if i + 1 < len(pieces):
                        good = bool(self.derives((first[0] if first and not i else part,), piece, bool(pieces[i + 1]) and _begins_line(pieces[i + 1][0]) or not pieces[i + 1] and line_end))
                    else:
                        good = bool(self.derives((last,), piece, line_end))
                if good:
                    answers[name] = self.memo[name, tokens, line_end] = True
                    left.remove(name)
        if left:
            found = self._run(left, tokens, line_end)
            for name in left:
                answers[name] = self.memo[name, tokens, line_end] = name in found
        return [n for n in names if answers[n]]

    def _run(self, names, seq, line_end=True):
        n, edges, final, table = len(seq), self.edges, self.final, self.table
        sets = [frozenset((table[abs(t)][0] + "{", "ANY")) if isinstance(t, int) else self._match(t) for t in seq]
        nodes, returns, pops, work, seen = {}, [], [], [], set()

        def node(name, at):
            key = (name, at)
            if key not in nodes:
                nodes[key] = len(returns)
                returns.append({})
                pops.append({})
                work.append((self.entry[name], nodes[key], at))
            return nodes[key]

        roots = {node(name, 0): name for name in names}
        found = set()
        while work:
            item = work.pop()
            if item in seen:
                continue
            seen.add(item)
            state, top, i = item
            if final[state] and i not in pops[top]:
                pops[top][i] = None
                if i == n and top in roots:
                    found.add(roots[top])
                    if len(found) == len(roots):
                        return found
                for back, under in returns[top]:
                    work.append((back, under, i))
            for kind, a, b, to in edges[state]:
                if kind == TOKEN:
                    if i < n and a in sets[i]:
                        work.append((to, top, i + 1))
                elif kind == CALL:
                    if not self.nullable[a] and (i >= n or self.first[a].isdisjoint(sets[i])):
                        continue
                    child = node(a, i)
                    if (to, top) not in returns[child]:
                        returns[child][to, top] = None
                        for j in pops[child]:
                            work.append((to, top, j))
                elif kind == GROUP:
                    if i < n and a in sets[i] and self.derives((b,), table[abs(seq[i])][1]):
                        work.append((to, top, i + 1))
                elif a == "nl":
                    if line_end if i == n else _begins_line(seq[i]):
                        work.append((to, top, i))
                elif a == "same":
                    if i < n and not _begins_line(seq[i]):
                        work.append((to, top, i))
        return found

    def accepted(self, tokens):
        """The dialects whose grammar derives the whole token sequence."""
        if len(self.memo) > MEMO_LIMIT or len(self.table) > MEMO_LIMIT:
            self._rebuilt(tokens)
        starts = list(dict.fromkeys(self.starts.values()))
        found = self.derives(starts, tokens)
        return [d for d, s in self.starts.items() if s in found]

    def _rebuilt(self, tokens):
        """Drops all that is remembered but the groups of ``tokens``, which keep their numbers."""
        self.memo = {}
        keep, todo = set(), [abs(t) for t in tokens if isinstance(t, int)]
        while todo:
            number = todo.pop()
            if number not in keep:
                keep.add(number)
                todo += [abs(t) for t in self.table[number][1] if isinstance(t, int)]
        self.table = [key if i in keep else ("", ()) for i, key in enumerate(self.table)] if len(self.table) < 8 * MEMO_LIMIT else self.table
        self.ids = {self.table[i]: i for i in keep}


class _Reader:
    def __init__(self, text, name):
        self.pieces, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _META.match(text, at)
            if not m:
                raise ValueError(f"rule {name}: {text[at : at + 30]!r}")
            self.pieces.append(m.groups())
            at = m.end()
        self.pieces.reverse()

    def peek(self):
        return self.pieces[-1] if self.pieces else None

    def next(self):
        return self.pieces.pop()


class Tree:
    """Builds the token tree of one text for a grammar."""

    def __init__(self, grammar):
        self.grammar, self.stack, self.cur, self.last = grammar, [], [], ""

    def add(self, token, flag=False):
        self.cur.append("\n" + token if flag else token)
        self.last = token

    def open(self, bracket, flag=False):
        self.stack.append((bracket, flag, self.cur))
        self.cur = []
        self.last = bracket

    def close(self, bracket):
        """Whether the innermost open group has this bracket."""
        if not self.stack or self.stack[-1][0] != bracket:
            return False
        _, flag, outer = self.stack.pop()
        number = self.grammar.group(bracket, tuple(self.cur))
        outer.append(-number if flag else number)
        self.cur, self.last = outer, "}"
        return True
