"""Token sequences with metavariables and ellipses, matched in Arrow batches."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_text, sums_before
from .anchors import Anchors, candidates_column, regex_anchor, regex_chain, token_anchor

#: One-character tokens; blanks separate, quotes are ordinary characters.
PUNCTUATION = "+-*/%=<>!&|^~?:;,()[]{}."
_TOKEN = re.compile(r"\.\.\.|\.\.?|[" + re.escape(PUNCTUATION.replace(".", "")) + r"]|[^ \t\n\r" + re.escape(PUNCTUATION) + r"]+")
CLOSERS = {")": "(", "]": "[", "}": "{"}


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) in characters; two dots in a row are one dot token."""
    return [("." if m[0] == ".." else m[0], m.start(), m.start() + 1 if m[0] == ".." else m.end()) for m in _TOKEN.finditer(text)]


@dataclass(frozen=True)
class Step:
    """kind: literal, gap (ellipsis) or bind; stop: the next literal token, None at the pattern's end."""

    kind: str
    token: str
    stop: str | None


class TokenPattern:
    """A compiled token pattern for one language."""

    def __init__(self, pattern: str, language: str = "generic"):
        self.fold = language == "sql"
        self.java = language == "java"
        self.sql = language == "sql"
        raw = [t for t, _, _ in tokenize(pattern.replace("$...", "..."))]
        if raw and raw[-1] == ";" and not self.sql:
            raw.pop()
        tokens: list[str] = []
        for t in raw:
            if t == "..." and tokens and tokens[-1] == "$":
                tokens.pop()
            tokens.append(t)
        stops: list[str | None] = [None] * len(tokens)
        for i in range(len(tokens) - 2, -1, -1):
            n = tokens[i + 1]
            stops[i] = stops[i + 1] if n == "..." or n.startswith("$") else n
        kind = lambda t: "gap" if t == "..." else "bind" if t.startswith("$") else "literal"
        self.steps = [Step(kind(t), self._case(t) if kind(t) == "literal" else t, s and self._case(s)) for t, s in zip(tokens, stops)]
        self.anchor = next((i for i, s in enumerate(self.steps) if s.kind == "literal"), None)
        first = next((t for t in tokens if not t.startswith("$")), "")
        self.after_dot = not (self.java and first and all(c.isalnum() or c == "_" for c in first))
        self.warnings = [f"{a} {b}: the first never matches" for a, b, s in zip(tokens, tokens[1:], stops) if a.startswith("$") and b.startswith("$") and s is not None]

    def _case(self, t: str) -> str:
        return t.lower() if self.fold and t.isascii() else t

    def _seek(self, tokens: list[str], at: int, stop: str, balanced: bool) -> int | None:
        """Place of the next stop token; of the one that closes what is open, where balanced."""
        if not balanced:
            try:
                return tokens.index(stop, at)
            except ValueError:
                return None
        depth = 1
        for k in range(at, len(tokens)):
            depth += (tokens[k] == CLOSERS[stop]) - (tokens[k] == stop)
            if depth == 0:
                return k
        return None

    def at(self, tokens: list[str], start: int) -> tuple[int, dict[str, tuple[int, int]]] | None:
        """(end, bindings as token ranges) of a match that starts at a token, without backtracking."""
        j, bound = start, {}
        for step in self.steps:
            if j >= len(tokens):
                return None
            if step.kind == "literal":
                if tokens[j] != step.token:
                    return None
                j += 1
                continue
            if step.stop is None:
                end = len(tokens)
            else:
                balanced = step.stop in CLOSERS and (step.kind == "gap" or step.stop == ")")
                end = self._seek(tokens, j, step.stop, balanced)
                if end is None:
                    return None
            if step.kind == "bind":
                if end == j:
                    return None
                seen = bound.setdefault(step.token, (j, end))
                if tokens[seen[0] : seen[1]] != tokens[j:end]:
                    return None
            if step.stop is None:
                return end, bound
            j = end
        return j, bound

    def matches(self, text: "str | Tokens", statements: bool = True) -> list[tuple[int, int, dict[str, tuple[int, int]]]]:
        """(start, end, bindings) in characters; spans may overlap. SQL is matched statement by statement."""
        tokens = Tokens(text) if isinstance(text, str) else text
        if not self.fold and not all(s.token in tokens.text for s in self.steps if s.kind == "literal"):
            return []
        words = tokens.folded if self.fold else tokens.words
        if self.sql and statements:
            cuts = [0, *(i + 1 for i, t in enumerate(words) if t == ";"), len(words)]
        else:
            cuts = [0, len(words)]
        places: list[int] | range
        out = []
        for low, high in zip(cuts, cuts[1:]):
            window = words[low:high]
            if self.anchor is None:
                places = range(len(window))
            else:
                want = self.steps[self.anchor].token
                places = [i - self.anchor for i, t in enumerate(window) if t == want and i >= self.anchor]
            for s in places:
                if not self.after_dot and low + s > 0 and words[low + s - 1] == ".":
                    continue
                got = self.at(window, s)
                if got and got[0] > s:
                    end, bound = got
                    place = tokens.span
                    out.append((place(low + s)[0], place(low + end - 1)[1], {k: (place(low + a)[0], place(low + b - 1)[1]) for k, (a, b) in bound.items()}))
        return out


#: Rows, and characters in them, after which a pass over texts hands on what it has; texts and nodes that it unpacks at once.
ROWS, CHARS, TEXTS, NODES = 4096, 1 << 22, 256, 2048


def row_batches(batch: pa.RecordBatch, rows_of: Callable[[pa.RecordBatch], Iterable[tuple[int, tuple]]], names: list[str], types: list[pa.DataType], at_once: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The rows made of a batch, after the first column of what they come from, in batches of a bounded size.

    rows_of takes a slice of the batch and gives its rows, each with its place in the slice. So a pass holds what one text and
    one batch of rows need, however many texts come at once and however many rows a text has.
    """
    size = lambda v: 0 if v is None else len(v) if isinstance(v, str) else sum(len(x) for pair in v for x in pair)
    texts = [k for k, t in enumerate(types) if not pa.types.is_integer(t)]

    def leave(part: pa.RecordBatch, keep: list[int], rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names)

    for k in range(0, batch.num_rows, at_once):
        part = batch.slice(k, at_once)
        keep, rows, chars = [], [], 0
        for i, row in rows_of(part):
            keep.append(i)
            rows.append(row)
            for c in texts:
                chars += size(row[c])
            if len(rows) >= ROWS or chars >= CHARS:
                yield leave(part, keep, rows)
                keep, rows, chars = [], [], 0
        if rows:
            yield leave(part, keep, rows)


class Tokens:
    """A text's tokens, split once for all patterns; their places only where a match asks for them."""

    def __init__(self, text: str):
        self.text = text
        self._words: list[str] | None = None
        self._folded: list[str] | None = None
        self._spans: list[tuple[int, int]] | None = None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = _TOKEN.findall(self.text)
            if ".." in self.text:
                self._words = ["." if t == ".." else t for t in self._words]
        return self._words

    @property
    def folded(self) -> list[str]:
        if self._folded is None:
            self._folded = [t.lower() if t.isascii() else t for t in self.words]
        return self._folded

    def span(self, i: int) -> tuple[int, int]:
        if self._spans is None:
            self._spans = [(a, b) for _, a, b in tokenize(self.text)]
        return self._spans[i]


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_col(starts: list[int], at: int) -> tuple[int, int]:
    """1-based line and column, in characters."""
    i = bisect_left(starts, at + 1) - 1
    return i + 1, at - starts[i] + 1


MATCH_FIELDS = "rule_id string, pattern_no int, start long, end long, start_line int, start_column int, end_line int, end_column int, matched string, bindings map<string,string>"

MATCH_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]


@dataclass(frozen=True)
class Leaf:
    """A leaf pattern of a rule. kind is simple or regex; focus is a metavariable whose place becomes the match's; mark is one
    whose place a match of tokens keeps beside its own, under PLACE in its bindings."""

    rule_id: str
    no: int
    kind: str
    text: str
    languages: tuple[str, ...]
    statements: bool = True
    focus: str | None = None
    mark: str | None = None


#: Where a match keeps its marked metavariable's place: start, end, lines and columns, and text.
PLACE = "\x00place"


def java_regex(pattern: str) -> str:
    """A regular expression of rule files as the JVM reads it: named groups and the end of the text are written differently."""
    return re.sub(r"\\Z", r"\\z", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")))


def regex_groups(pattern: str) -> int:
    """Capturing groups of a regular expression, as the JVM counts them."""
    bare = re.sub(r"\[(\^?\]?)[^\]]*\]", "", re.sub(r"\\Q.*?(\\E|$)|\\.", "", java_regex(pattern), flags=re.DOTALL))
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


#: From so many regular expressions on, texts are first walked by one automaton over all their anchors; fewer are looked for one by one.
MANY = 32


def match_leaves(files: DataFrame, leaves: list, id_col: str = "file_id", text_col: str = "source", language_col: str | None = "language", once: set[str] = frozenset(), plain: bool = False) -> DataFrame:
    """Matches of leaf patterns in every file; leaves are Leaf objects or their first five fields.

    The leaves are a driver-side list: no shuffle, and at most two passes over the files. Regular expressions
    are matched by built-in functions, whatever stands beside them, token patterns in Arrow batches; both only where an
    anchor of theirs occurs (plain: everywhere, with the same result). A leaf is tried
    where the file's language is among its languages (or they hold "generic"). Null and empty texts have no matches.
    Of the rules in `once`, matches of equal spans of one file are one match, that of the least leaf; all leaves of
    such a rule are of one kind.
    """
    leaves = [x if isinstance(x, Leaf) else Leaf(*x[:4], tuple(x[4])) for x in leaves]
    language = F.col(language_col) if language_col else F.lit("generic")
    slim = files.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), language.cast("string").alias("_language"))
    parts = []
    if regexes := [x for x in leaves if x.kind != "simple"]:
        parts.append(_by_functions(slim, regexes, once, plain))
    if simple := [x for x in leaves if x.kind == "simple"]:
        parts.append(_by_tokens(slim, simple, once, plain))
    if not parts:
        parts.append(_by_tokens(slim, [], once, plain))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("_id", id_col)


def _by_functions(slim: DataFrame, leaves: list[Leaf], once: set[str], plain: bool) -> DataFrame:
    """One replacement a leaf and text puts marks around its matches and their groups; splitting at the marks gives the
    matches and what stands between them, and adding up lengths their places. The expression runs once.

    Marks are private characters around a number that the text does not hold. A focus on a group is its first occurrence inside the match.
    """
    anchors = [None if plain else regex_anchor(x.text) for x in leaves]
    many = len(leaves) >= MANY and not plain
    rows = [
        {"rule": x.rule_id, "no": x.no, "re": java_regex(x.text), "groups": (n := regex_groups(x.text)), "any": "generic" in x.languages, "langs": list(x.languages), "once": x.rule_id in once, "need": [] if many else sorted(a or ()), "focus": int(x.focus[1:]) if x.focus and x.focus[1:].isdigit() and int(x.focus[1:]) <= n else 0}
        for x, a in zip(leaves, anchors)
    ]
    row = "rule: string, no: int, re: string, groups: int, any: boolean, langs: array<string>, once: boolean, need: array<string>, focus: int"
    # every leaf of the run as one constant, whatever their number
    table = f"from_json({sql_text(json.dumps(rows, ensure_ascii=False))}, 'array<struct<{row}>>')"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    count = lambda s: f"char_length({s}) - char_length(replace({s}, '\n', ''))"
    # 1-based place of a string's last line feed, 0 for none
    last = lambda s: f"if(instr({s}, '\n') = 0, 0, char_length({s}) + 1 - instr(reverse({s}), '\n'))"
    shape = lambda s: f"named_struct('n', char_length({s}), 'nl', {count(s)}, 'last', {last(s)})"
    mark = lambda c: f"concat('{c}', _mark, '\ue003')"
    fields = "rule: string, no: int, once: boolean, start: int, end: int, l1: int, c1: int, l2: int, c2: int, matched: string, groups: map<string, string>"
    # the column counts from the last line feed before a place: of the texts before, of what precedes the focus, of the focus itself
    column = lambda at, *lasts: f"{at} - greatest(nl[j], " + ", ".join(f"if({x}.last > 0, {base} + {x}.last - 1, -1)" for x, base in lasts) + ")"
    begin, gap, before = "at[j] + g[j].n + h[j].n", ("g[j]", "at[j]"), ("h[j]", "at[j] + g[j].n")
    one = (
        f"named_struct('rule', r.rule, 'no', r.no, 'once', r.once, 'start', {begin}, 'end', {begin} + t[j].n, 'l1', 1 + ls[j] + g[j].nl + h[j].nl, 'c1', {column(begin, gap, before)}, "
        f"'l2', 1 + ls[j] + g[j].nl + h[j].nl + t[j].nl, 'c2', {column(begin + ' + t[j].n', gap, before, ('t[j]', begin))}, 'matched', if(r.focus > 0, f[j][r.focus], f[j][0]), "
        "'groups', if(r.groups = 0, cast(map() as map<string, string>), map_from_arrays(transform(sequence(1, r.groups), k -> concat('$', k)), slice(f[j], 2, r.groups))))"
    )
    body = f"transform(f, (x, j) -> {one})"
    body = let("t", f"transform(f, x -> {shape('if(r.focus > 0, x[r.focus], x[0])')})", body)
    body = let("h", f"transform(f, x -> if(r.focus > 0, {shape('left(x[0], greatest(instr(x[0], x[r.focus]) - 1, 0))')}, named_struct('n', 0, 'nl', 0, 'last', 0)))", body)
    body = let("nl", sums_before("transform(f, (x, j) -> greatest(if(g[j].last > 0, at[j] + g[j].last - 1, -1), if(m[j].last > 0, at[j] + g[j].n + m[j].last - 1, -1)))", "-1", "greatest({0}, {1})"), body)
    body = let("ls", sums_before("transform(f, (x, j) -> g[j].nl + m[j].nl)"), body)
    body = let("at", sums_before("transform(f, (x, j) -> g[j].n + m[j].n)"), body)
    body = let("m", f"transform(f, x -> {shape('x[0]')})", body)
    after = f"if(j = 0, x, substring(x, instr(x, {mark(chr(0xE002))}) + char_length({mark(chr(0xE002))})))"
    body = let("g", f"transform(p, (x, j) -> transform(array({after}), y -> {shape('y')})[0])", body)
    body = let("f", f"transform(slice(p, 2, size(p) - 1), x -> split(substring_index(x, {mark(chr(0xE002))}, 1), {mark(chr(0xE001))}, -1))", body)
    groups = f"if(r.groups = 0, '', array_join(transform(sequence(1, r.groups), k -> concat({mark(chr(0xE001))}, '$', k)), ''))"
    marked = f"regexp_replace(_text, r.re, concat({mark(chr(0xE000))}, '$0', {groups}, {mark(chr(0xE002))}))"
    found = let("p", f"split({marked}, {mark(chr(0xE000))}, -1)", f"if(size(p) = 1, cast(array() as array<struct<{fields}>>), {body})")
    texts = slim.where("_text is not null and _text != ''")
    if many:
        texts = texts.withColumn("_try", candidates_column(F.col("_text"), anchors, [regex_chain(x.text) for x in leaves]))
        tried = f"transform(_try, i -> {table}[i])"
    else:
        tried = f"filter({table}, r -> size(r.need) = 0 or exists(r.need, a -> contains(_text, a)))"
    free = "filter(sequence(0, char_length(_text) - char_length(replace(_text, '\ue003', ''))), n -> not exists(array('\ue000', '\ue001', '\ue002'), c -> contains(_text, concat(c, n, '\ue003'))))[0]"
    texts = texts.withColumn("_mark", F.expr(f"cast({free} as string)"))
    every = texts.select("_id", F.expr(f"flatten(transform(filter({tried}, r -> r.any or array_contains(r.langs, _language)), r -> {found}))").alias("_all"))
    if any(x.rule_id in once for x in leaves):
        # sorted, so that equal spans of a rule stand together and the least leaf first
        keyed = "array_sort(transform(_all, x -> named_struct('rule', x.rule, 'start', x.start, 'end', x.end, 'no', x.no, 'x', named_struct('once', x.once, 'l1', x.l1, 'c1', x.c1, 'l2', x.l2, 'c2', x.c2, 'matched', x.matched, 'pairs', map_entries(x.groups)))))"
        every = every.withColumn("_all", F.expr(let("s", keyed, "filter(s, (x, i) -> i = 0 or not x.x.once or x.rule != s[i - 1].rule or x.start != s[i - 1].start or x.end != s[i - 1].end)")))
        cols = ["m.rule", "m.no", "m.start", "m.end", "m.x.l1", "m.x.c1", "m.x.l2", "m.x.c2", "m.x.matched"]
        groups = F.map_from_entries("m.x.pairs")
    else:
        cols, groups = ["m.rule", "m.no", "m.start", "m.end", "m.l1", "m.c1", "m.l2", "m.c2", "m.matched"], F.col("m.groups")
    # the outer form, as from explode() the optimizer infers a filter on the array and works it out a second time below
    rows_ = every.select("_id", F.explode_outer("_all").alias("m")).where("m is not null")
    names = [f.split() for f in MATCH_FIELDS.split(", ")]
    return rows_.select("_id", *[F.col(c).cast(t).alias(n) for c, (n, t) in zip(cols, names)], groups.alias("bindings"))


def _by_tokens(slim: DataFrame, leaves: list[Leaf], once: set[str], plain: bool) -> DataFrame:
    anchors = [None if plain else token_anchor(TokenPattern(x.text)) for x in leaves]

    names = ["_id", *[f.split()[0] for f in MATCH_FIELDS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        known = Anchors(anchors, fold=True)

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            for k, (text, language) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not text:
                    continue
                tokens, starts, seen = Tokens(text), None, set()
                for leaf in map(leaves.__getitem__, known.candidates(text)):
                    if "generic" not in leaf.languages and language not in leaf.languages:
                        continue
                    key = (leaf.text, language)
                    if key not in compiled:
                        compiled[key] = TokenPattern(leaf.text, language or "generic")
                    for a, b, bound in compiled[key].matches(tokens, leaf.statements):
                        a, b = bound.get(leaf.focus, (a, b))
                        if leaf.rule_id in once:
                            if (leaf.rule_id, a, b) in seen:
                                continue
                            seen.add((leaf.rule_id, a, b))
                        starts = starts or line_starts(text)
                        bindings = [(n, text[x:y]) for n, (x, y) in bound.items()]
                        if leaf.mark in bound:
                            x, y = bound[leaf.mark]
                            bindings.append((PLACE, ":".join(map(str, (x, y, *line_col(starts, x), *line_col(starts, y), text[x:y])))))
                        yield k, (leaf.rule_id, leaf.no, a, b, *line_col(starts, a), *line_col(starts, b), text[a:b], bindings)

        for batch in batches:
            yield from row_batches(batch, rows_of, names, MATCH_TYPES)

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, {MATCH_FIELDS}")


def token_rows(files: DataFrame, id_col: str = "file_id", text_col: str = "source") -> DataFrame:
    """(id, i, token, start, end): every token of every text with its number from 0 and its place in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = [tokenize(t or "") for t in part.column(1).to_pylist()]
                owner = pa.array([j for j, x in enumerate(lists) for _ in x], pa.int64())
                number = pa.array([i for x in lists for i in range(len(x))], pa.int32())
                cols = list(zip(*(t for x in lists for t in x))) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), number, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["_id", "i", "token", "start", "end"])

    slim = files.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, i int, token string, start long, end long").withColumnRenamed("_id", id_col)


def statement_numbers(tokens: DataFrame, separator: str = ";", id_col: str = "file_id") -> DataFrame:
    """Tokens with `stmt`: the number of separators before them in their text."""
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("stmt", F.coalesce(F.sum(F.when(F.col("token") == separator, 1).otherwise(0)).over(w), F.lit(0)).cast("long"))


def holds(value: str, patterns: list[str], language: str = "generic") -> bool:
    """Whether any token pattern matches a text at all (an ending semicolon of a pattern never counts)."""
    tokens = Tokens(value)
    return any(TokenPattern(p.rstrip().removesuffix(";"), language).matches(tokens, False) for p in patterns)


def approximate_span(text: Column, pattern: str) -> Column:
    """struct<start, end> (0-based characters) from a pattern's first literal to the next of its last one; null where the first is not there."""
    anchors = [x for x in re.split(r"\$\w*", pattern) if x]
    if not anchors:
        return F.lit(None).cast("struct<start: int, end: int>")
    first, last = anchors[0], anchors[-1]
    start = F.instr(text, first)
    after = start + len(first)
    more = F.locate(last, text, 1) if len(anchors) == 1 else F.instr(F.substring(text, after, F.lit(1 << 30)), last)
    end = F.when(F.lit(len(anchors) > 1) & (more > 0), after - 1 + more - 1 + len(last)).otherwise(after - 1)
    return F.when(start > 0, F.struct((start - 1).alias("start"), end.cast("int").alias("end")))
