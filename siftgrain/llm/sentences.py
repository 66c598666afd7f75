"""Sentence boundaries in many languages and scripts, with statistics learned from the corpus itself."""

from __future__ import annotations

import re
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.session import checkpoint_dir, cut_lineage

#: Frequent function words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the of and is to that for with are this was not before it on has by from".split(),
    "de": "der die das und ist nicht den ein von mit dem wird zu nach vor nur noch seit".split(),
    "fr": "le la les des est une du que pas un dans pour par après depuis ce son et".split(),
    "es": "el la los las que una del por se en con no según ya cada un desde y".split(),
}
_FUNCTION = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _word in _list:
        _FUNCTION.setdefault(_word, []).append(_lang)

_SCRIPTS = [
    ("ja", re.compile("[ぁ-ヿ]")), ("ko", re.compile("[가-힣]")), ("zh", re.compile("[一-鿿]")), ("th", re.compile("[ก-๛]")),
    ("ar", re.compile("[ؠ-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ӿ]")),
]
_BEYOND_LATIN = re.compile("[\u0400-\u1fff\u3040-\ud7ff]")
#: Scripts in which a period follows no abbreviation.
_NO_ABBREVIATIONS = re.compile("[ぁ-ヿ가-힣一-鿿ก-๛]")

_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,9}[.)])[ \t]+")
_LINE = re.compile(r"[^\n]*\n?")

_OPENERS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "【": "】"}
_CLOSERS = "\"'”“’»)\\]」』）】"
# a mark that white space, a closing sign, the end or (for glued sentences) a capital follows; marks of scripts without spaces anywhere
_DIGIT = re.compile(r"\d")
_MAY_CLOSE = frozenset("\"'”“’»)]」』）】 \u00a0\u202f")
_MARK_NARROW = re.compile(r"[.!?…]+(?=[\s\"'”“’»)\]」』）】A-ZÀ-ÖØ-ÞА-ЯЁ]|\Z)")
_WIDE = re.compile("[。！？؟۔।]|…(?!\\s)")
_MARK = re.compile(r"[.!?…]+(?=[\s\"'”“’»)\]」』）】A-ZÀ-ÖØ-ÞА-ЯЁ]|\Z)|[.!?…。！？؟۔।]*[。！？؟۔।][.!?…。！？؟۔।]*|…+")
_AFTER = re.compile(rf"(?:[   ]?»|[{_CLOSERS}])*")
_PAIRS = re.compile("[\"“”„«»「」『』()（）【】]")
_NEXT = re.compile(r"\s*((?:[\"“„«‘¿¡(\[「『（—–-]+[   ]?)*)([^\s.,;:!?…()\[\]\"“”»«。！？，、；：]*)")
_LEAD = "\"'“„«‘([¿¡「『（`*_"
_TOKENS = re.compile(r"[^\s\"“”„«»()\[\]{}!?…,;:。！？，、；：؟।「」『』（）`]+")
_PERIODS = re.compile(r"\.(?=\s+([^\s.,;:!?…()\[\]\"“”»«]*)|\s*\Z)")
_TOKEN_END = re.compile(r"[\"“”„«»()\[\]!?…]|\.\Z")
_STARTS = re.compile(r"(?:\A|[!?؟।]+\s+)[\"“„«‘¿¡(]*([^\s.,;:!?…()\[\]\"“”»«]+)")


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the text's blocks in order, kind one of code, heading, item, text; ends are after the last visible character."""
    out: list[tuple[int, int, str]] = []
    at, n, begin, kind = 0, len(text), -1, "text"

    def flush(end: int) -> None:
        nonlocal begin
        if begin >= 0:
            stop = begin + len(text[begin:end].rstrip())
            if stop > begin:
                out.append((begin, stop, kind))
        begin = -1

    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end + 1
        head = text[at : at + 16]
        line = text[at:end]
        if not line.strip():
            flush(at)
        elif head.lstrip()[:1] in ("`", "~") and (m := _FENCE.match(line)):
            flush(at)
            mark, begin, kind = m[1], at + len(line) - len(line.lstrip()), "code"
            while end < n:
                after = text.find("\n", end)
                after = n if after < 0 else after + 1
                closing = text[end:after].strip()
                end = after
                if closing.startswith(mark) and not closing.strip(mark[0]):
                    break
            flush(end)
            kind = "text"
        elif _HEADING.match(line):
            flush(at)
            begin, kind = at + len(line) - len(line.lstrip()), "heading"
            flush(end)
            kind = "text"
        elif m := _ITEM.match(line):
            flush(at)
            begin, kind = at + m.end(), "item"
            if not line[m.end() :].strip():
                begin = at + len(line) - len(line.lstrip())
        elif begin < 0:
            begin, kind = at + len(line) - len(line.lstrip()), "text"
        at = end
    flush(n)
    return out


def language(text: str) -> str:
    """The language of a stretch of text by its script, and in Latin script by its function words; ``und`` if none of them occurs."""
    if not text.isascii() and _BEYOND_LATIN.search(text):
        for name, pattern in _SCRIPTS:
            if len(pattern.findall(text)) * 5 > len(text) or name == "ja" and pattern.search(text):
                return name
    votes: dict[str, int] = {}
    for w in [w for w in text.lower().split() if w in _FUNCTION]:
        for name in _FUNCTION[w]:
            votes[name] = votes.get(name, 0) + 1
    return max(votes, key=lambda k: (votes[k], k)) if votes else "und"


COUNTS = "kind string, lang string, a string, b string, n bigint"


def corpus_counts(documents: DataFrame) -> DataFrame:
    """``kind, lang, a, b, n`` over all documents' prose: token totals (t), tokens at sure starts (s), tokens before a period by what follows (p)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: dict[str, Counter] = {}
        starts: dict[str, Counter] = {}
        periods: Counter = Counter()

        def counted() -> pd.DataFrame:
            # tokens with digits are only part of the total
            rows = []
            for lang, c in tokens.items():
                words = {w: n for w, n in c.items() if not _DIGIT.search(w)}
                rows += [("t", lang, w.rstrip("."), "", n) for w, n in words.items()]
                rows.append(("t", lang, "#", "", c.total() - sum(words.values())))
            rows += [("s", lang, w.rstrip("."), "", n) for lang, c in starts.items() for w, n in c.items()]
            rows += [("p", *k, n) for k, n in periods.items()]
            for c in (tokens, starts, periods):
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "lang", "a", "b", "n"])

        for pdf in batches:
            for text in pdf["text"]:
                for a, b, kind in blocks(text):
                    if kind not in ("text", "item"):
                        continue
                    part = text[a:b]
                    lang = language(part)
                    if lang in ("zh", "ja", "th"):
                        continue
                    if lang not in tokens:
                        tokens[lang], starts[lang] = Counter(), Counter()
                    tokens[lang].update(_TOKENS.findall(part))
                    starts[lang].update(_STARTS.findall(part))
                    for m in _PERIODS.finditer(part):
                        token = _before(part, 0, m.start()).lower()
                        if token and not _TOKEN_END.search(token):
                            periods[lang, "#" if token[-1].isdigit() else token, m[1] or ""] += 1
            if sum(map(len, tokens.values())) + len(periods) > 200_000:
                yield counted()
        yield counted()

    texts = documents.select("text").where(F.col("text").isNotNull())
    return texts.mapInPandas(count, COUNTS).groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio that the second event depends on the first: ``both`` of ``first``, ``second`` of ``total``."""
    p, p1 = second / total, both / first
    p2 = (second - both) / F.greatest(total - first, F.lit(1))
    return 2 * (_likelihood(both, first, p1) + _likelihood(second - both, total - first, p2) - _likelihood(both, first, p) - _likelihood(second - both, total - first, p))


def learn(counts: DataFrame) -> DataFrame:
    """``lang, kind, a, b``: what was learned from the corpus's counts, by log-likelihood ratios, all in SQL.

    Kinds: ``starter`` (a, a token that tends to begin sentences), ``common`` (a,
    a lower-case token that is frequent and never does), ``abbr`` (a, a token
    whose period is its own), ``ordinal`` (a, a token that follows a number
    with a period).
    """
    token = counts.where("kind = 't'").select("lang", F.col("a"), F.col("n").alias("t"))
    sure = counts.where("kind = 's'").select("lang", F.col("a"), F.col("n").alias("s"))
    sizes = token.groupBy("lang").agg(F.sum("t").alias("all_t"))
    starts = sure.groupBy("lang").agg(F.sum("s").alias("all_s"))
    known = token.join(sure, ["lang", "a"], "left").join(sizes, "lang").join(starts, "lang").withColumn("s", F.coalesce("s", F.lit(0)))
    share = F.col("s") / F.col("t")
    starter = known.where((F.col("s") >= 3) & (share >= 0.08) & (share > F.col("all_s") / F.col("all_t")) & (ratio(F.col("s"), F.col("t"), F.col("all_s"), F.col("all_t")) > 10))
    common = known.where((F.col("t") >= 20) & (share < 0.02) & (F.lower("a") == F.col("a")) & (F.upper("a") != F.col("a")))
    starter, common = starter.select("lang", "a").withColumn("is_starter", F.lit(True)), common.select("lang", "a")

    periods = counts.where("kind = 'p'").select("lang", F.col("a"), "b", "n")
    after = periods.join(starter.withColumnRenamed("a", "b"), ["lang", "b"], "left")
    small = (F.lower("b") == F.col("b")) & (F.upper("b") != F.col("b"))
    open_ = (F.col("b") != "") & (F.col("is_starter").isNull()) & (F.col("b").rlike(r"^\d") | small | ~F.col("b").rlike(r"^\d"))
    by_type = after.groupBy("lang", "a").agg(
        F.sum("n").alias("with"), F.sum(F.when(open_ & (F.col("b").rlike(r"^\d") | small), F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(open_, F.col("n")).otherwise(0)).alias("inner_n"),
        F.count(F.when(open_, 1)).alias("kinds"),
    )
    totals = token.groupBy("lang", F.lower("a").alias("a")).agg(F.sum("t").alias("t"))
    all_periods = periods.groupBy("lang").agg(F.sum("n").alias("all_p"))
    typed = by_type.where("a != '#'").join(totals, ["lang", "a"]).join(sizes, "lang").join(all_periods, "lang")
    length = F.length(F.regexp_replace("a", r"\.", ""))
    without = F.greatest(F.col("t") - F.col("with"), F.lit(0))
    score = ratio(F.col("with"), F.col("t"), F.col("all_p"), F.col("all_t")) * F.exp(-length) * (1 + F.length("a") - length) * F.pow(length.cast("double"), -without / F.greatest(F.col("with") / 20, F.lit(1.0)))
    abbr = typed.where(
        F.col("a").rlike(r"^\p{L}") & (F.col("with") >= 3) & (F.col("with") / F.greatest("t", "with") > 0.8) & (score > 0.3)
        & ((F.col("low") / F.col("with") >= 0.1) | ((F.col("inner_n") / F.col("with") >= 0.5) & (F.col("kinds") >= 5)))
    )
    numbers = periods.where("a = '#'").groupBy("lang", "b").agg(F.sum("n").alias("k")).join(token.withColumnRenamed("a", "b"), ["lang", "b"]).join(sizes, "lang")
    all_numbers = periods.where("a = '#'").groupBy("lang").agg(F.sum("n").alias("all_k"))
    ordinal = numbers.join(all_numbers, "lang").where((F.col("b") != "") & (F.col("k") >= 3) & (F.col("k") / F.col("t") >= 0.5) & (ratio(F.col("k"), F.col("t"), F.col("all_k"), F.col("all_t")) > 10)).select("lang", F.col("b").alias("a"))
    named = [
        (starter, "starter"),
        (common, "common"),
        (abbr, "abbr"),
        (ordinal.join(starter, ["lang", "a"], "left_anti"), "ordinal"),
    ]
    return reduce(DataFrame.union, [df.select("lang", F.lit(kind).alias("kind"), "a") for df, kind in named])


#: Learned entries that are sent to the workers as a whole; of more, each worker reads the parts it needs.
MODEL_LIMIT = 500_000
#: Parts of a large model, and how many of them a worker keeps.
SHARDS, KEPT = 4096, 256


class StoredModel:
    """A learned model in the shared folder, read part by part: for vocabularies of any size."""

    def __init__(self, folder: str, shards: int = SHARDS):
        self.folder, self.shards, self.parts = folder, shards, OrderedDict()

    def __getstate__(self):
        return {"folder": self.folder, "shards": self.shards, "parts": OrderedDict()}

    def part(self, number: int) -> frozenset:
        if number not in self.parts:
            import pyarrow.dataset as ds

            where = f"{self.folder}/shard={number}"
            try:
                rows = ds.dataset(where.removeprefix("file:"), format="parquet").to_table().to_pydict()
                self.parts[number] = frozenset(zip(rows["lang"], rows["kind"], rows["a"]))
            except FileNotFoundError:  # nothing was learned there
                self.parts[number] = frozenset()
            if len(self.parts) > KEPT:
                self.parts.popitem(last=False)
        self.parts.move_to_end(number)
        return self.parts[number]

    def has(self, lang: str, kind: str, word: str) -> bool:
        return (lang, kind, word) in self.part(crc32(f"{lang}\t{kind}\t{word}".encode("utf-8", "surrogatepass")) % self.shards)


def collect_model(learned: DataFrame, limit: int = MODEL_LIMIT, shards: int = SHARDS):
    """The learned entries as sets by (lang, kind); more than ``limit`` of them as a StoredModel, with the same answers."""
    rows = learned.limit(limit + 1).toPandas()
    if len(rows) <= limit:
        return {key: frozenset(part["a"]) for key, part in rows.groupby(["lang", "kind"])}
    folder = f"{checkpoint_dir(learned.sparkSession)}/sentences-{uuid.uuid4()}"
    both = learned.union(learned.select(F.lit("und"), "kind", "a")).distinct()
    both.withColumn("shard", F.pmod(F.crc32(F.concat_ws("\t", "lang", "kind", "a")), F.lit(shards))).repartition("shard").write.partitionBy("shard").parquet(folder)
    return StoredModel(folder, shards)


def _before(part: str, start: int, at: int) -> str:
    """The token that ends at ``at``, without opening signs."""
    around = part[max(start, at - 40) : at]
    if not around or around[-1].isspace():
        return ""
    pieces = around.rsplit(None, 1)
    if len(pieces) == 1 and at - 40 > start and not around[0].isspace():  # longer than was looked at
        pieces = part[start:at].rsplit(None, 1)
    return pieces[-1].lstrip(_LEAD)


class Splitter:
    """Splits texts with a learned model."""

    def __init__(self, model):
        self.stored = model if isinstance(model, StoredModel) else None
        self.model = {} if self.stored else dict(model)
        self.none: frozenset = frozenset()

        # text too short to tell its language is judged by what any language has learned
        for kind in ("abbr", "starter", "common", "ordinal"):
            known = [words for (lang, k), words in self.model.items() if k == kind]
            self.model["und", kind] = frozenset().union(*known)

    def has(self, lang: str, kind: str, word: str) -> bool:
        if self.stored:
            return self.stored.has(lang, kind, word)
        return word in self.model.get((lang, kind), self.none)

    def ends(self, text: str) -> list[int]:
        """The end of each sentence, in code points from the text's beginning."""
        out = []
        for a, b, kind in blocks(text):
            if kind in ("text", "item"):
                part = text[a:b]
                out += [a + x for x in self._inner(part)]
            out.append(b)
        return out

    def _inner(self, part: str) -> list[int]:
        """The boundaries inside a block."""
        lang = language(part)
        found = []
        thai = lang == "th" or not part.isascii() and _SCRIPTS[3][1].search(part)
        if thai:
            for m in re.finditer(r"[ \n ]+", part):
                x, y = part[m.start() - 1], part[m.end() : m.end() + 1]
                if y and not x.isdigit() and not y.isdigit() and ("ก" <= x <= "๛" and not (x in "ๆฯ") or x in "\"”)?!" and "ก" <= y <= "๛") and x not in ",;:(":
                    found.append(m.start())
        spans = self._spans(part)
        start = 0
        narrow = part.isascii() or not _WIDE.search(part)
        for m in (_MARK_NARROW if narrow else _MARK).finditer(part):
            at, end = m.start(), m.end()
            if at < start or end >= len(part):
                continue
            marks = m[0]
            after_end = _AFTER.match(part, end).end() if end < len(part) and part[end] in _MAY_CLOSE else end
            stop = end
            inside = next(((x, y) for x, y in spans if x < at < y), None) if spans else None
            if inside:
                # a quotation or bracket that closes right after the mark may end the sentence; marks deeper inside never do
                outer = [s for s in spans if s[0] < at < s[1]]
                closing = [s for s in outer if s[1] < after_end]
                if len(closing) < len(outer):
                    continue
                inside = min(closing)
                stop = max(s[1] for s in closing) + 1
            elif after_end > end and part[after_end - 1] not in "“" and (after_end >= len(part) or part[after_end].isspace() or marks[-1] in "。！？"):
                stop = after_end
                if part[end:stop].strip("  ") == '"' and any(s[0] == end or part[s[0]] == '"' and s[0] < stop <= s[0] + 1 for s in spans):
                    stop = end
            if stop >= len(part):
                continue
            if self._is_boundary(part, lang, marks, at, stop, inside, start):
                found.append(stop)
                start = stop
        return sorted({x for x in found if 0 < x < len(part) and part[x:].strip()})

    def _spans(self, part: str) -> list[tuple[int, int]]:
        """Quotations and brackets that are closed within the block."""
        stack: list[tuple[str, int]] = []
        out = []
        for m in _PAIRS.finditer(part):
            c, i = m[0], m.start()
            if c == '"':
                if any(s[0] == '"' for s in stack):
                    while stack[-1][0] != '"':
                        stack.pop()
                    out.append((stack.pop()[1], i))
                elif i + 1 < len(part) and not part[i + 1].isspace():
                    stack.append(('"', i))
                continue
            if c == "“" and stack and stack[-1][0] == "“low":
                out.append((stack.pop()[1], i))
            elif c == "„":
                stack.append(("“low", i))
            elif c in _OPENERS:
                stack.append((_OPENERS[c], i))
            elif any(s[0] == c for s in stack):
                while stack[-1][0] != c:
                    stack.pop()
                out.append((stack.pop()[1], i))
        return sorted(out)

    def _is_boundary(self, part: str, lang: str, marks: str, at: int, stop: int, inside, start: int) -> bool:
        spaced = part[stop].isspace()
        if marks == "." and spaced and not inside and stop == at + 1:
            # a period after an ordinary word, the usual case
            token = _before(part, start, at)
            if len(token) > 1 and token.isalpha():
                word = token.lower()
                if not (self.stored.has(lang, "abbr", word) if self.stored else word in self.model.get((lang, "abbr"), self.none)):
                    return True
        wide = marks[-1] in "。！？"
        if not spaced and not wide and marks[-1] not in "।؟۔":
            # a sentence glued to the one before: an ordinary word, then a known beginning
            token = _before(part, start, at)
            word = _NEXT.match(part, stop)[2]
            return marks[-1] in ".!?" and not inside and stop == at + len(marks) and len(token) > 2 and token.isalpha() and not token.isupper() and word[:1].isupper() and word.isalpha() and self.has(lang, "starter", word)
        if marks[0] == "…" and not spaced and "。" not in marks:
            return False
        m = _NEXT.match(part, stop)
        lead, word = m[1], m[2]
        first = word[:1]
        lower, upper = first.islower(), first.isupper()
        if inside:
            opened = part[inside[0]]
            at_start = not part[start : inside[0]].strip()
            if opened in "(（【":
                return at_start
            introduced = part[: inside[0]].rstrip()[-1:] in ":："
            if wide and not spaced:
                return introduced
            if lead[:1] in ("—", "–", "-") or not word and not lead:
                return False
            if lower:
                return not self.has(lang, "common", word) and at_start and (self.has(lang, "starter", word) or bool(word))
            if upper:
                return True
            if first and not first.isalpha():
                return True
            return introduced if first.isalpha() else bool(lead)
        if wide or marks[-1] in "!?؟।۔":
            if lead[:1] in ("—", "–") and lower:
                return False
            return not (marks[-1] in "!?" and lower and lead == "" and self.has(lang, "common", word) and not spaced)
        if marks[-1] == "…" or len(marks) > 1:
            return not lower or self.has(lang, "starter", word)
        token = _before(part, start, at)
        kind = token.lower()
        plain = kind.rstrip("”’»)\"']")
        if plain[-1:].isdigit():
            if lower:
                return not self.has(lang, "common", word)
            return not self.has(lang, "ordinal", word) or self.has(lang, "starter", word)
        short = len(plain) == 1 and plain.isalpha() and not _NO_ABBREVIATIONS.match(plain)
        dotted = "." in plain and all(len(x) <= 2 and x.isalpha() for x in plain.split("."))
        if short or dotted or self.has(lang, "abbr", plain):
            if short and token.isupper() and len(word) == 1 and part[m.end() : m.end() + 1] == ".":
                return False  # two initials
            if lead[:1] in ("(", "[") or not first:
                return bool(lead) and not lower and bool(word) and self.has(lang, "starter", word)
            if self.has(lang, "starter", word):
                return True
            return False
        return True


def sentence_ends(documents: DataFrame, model, starts: bool = True) -> DataFrame:
    """``doc_id, sentence_no, start_pos, end_pos`` of each sentence, sentences in order from 0; without ``starts`` only ``doc_id, end_pos``.

    ``end_pos`` is the number of code points up to and including the sentence's
    last character. Headings are one sentence each, list items at least one,
    fenced code one as a whole; a blank line always ends one. Null, empty and
    blank texts have none. Texts are read whole where they lie; nothing is
    shuffled, and rows that repeat give rows that repeat.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(sent.value)
        for pdf in batches:
            docs, numbers, begins, stops = [], [], [], []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                ends = splitter.ends(text)
                docs += [doc] * len(ends)
                stops += ends
                if starts:
                    numbers += range(len(ends))
                    for before in [0, *ends[:-1]][: len(ends)]:
                        while text[before].isspace():
                            before += 1
                        begins.append(before)
            columns = {"doc_id": docs} | ({"sentence_no": numbers, "start_pos": begins} if starts else {}) | {"end_pos": stops}
            yield pd.DataFrame(columns)

    schema = "doc_id bigint, sentence_no int, start_pos int, end_pos int" if starts else "doc_id bigint, end_pos int"
    return documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).mapInPandas(split, schema)


def split_sentences(documents: DataFrame, starts: bool = True) -> DataFrame:
    """Learns from all documents, then splits them all; see learn and sentence_ends.

    The corpus's counts, which the ratios read many times, are written to the
    shared checkpoint folder, so each text is read twice: to count and to split.
    """
    return sentence_ends(documents, collect_model(learn(cut_lineage(corpus_counts(documents)))), starts)
