"""Literal anchors of patterns, and one automaton over the anchors of all rules.

A pattern's anchor is a set of literal texts of which at least one occurs wherever the pattern matches. An
Aho-Corasick automaton over all anchors is walked once a text and tells the few patterns that can match
there; the others are not tried. A pattern without an anchor is tried everywhere, so nothing is lost.

Anchors that are common words tell little. A pattern of several literals with runs of a character class between
them therefore has a chain: its text with a mark for every run of the class. Where the pattern matches, the chain
occurs in the text whose own runs are marked, so a second automaton, over all chains of a class, is walked there.
"""

from __future__ import annotations

import itertools
import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from re import _constants as op
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives that one anchor may have; with more the pattern is tried everywhere.
MOST = 16
#: Escapes that the JVM reads otherwise than the parser used here, or that only one of them knows.
_OTHER_ESCAPES = set("0vQEpPxGRXkKhHzZ")


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two anchors that both hold, the one whose shortest text is longer; then the one of fewer texts."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s), sorted(s)))


def _of(tree) -> frozenset | None:
    """The best anchor of a sequence of parsed items."""
    best, run = None, ""
    for kind, value in tree:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        inner = None
        if kind is op.SUBPATTERN:
            _, on, _, items = value
            inner = None if on & re.IGNORECASE else _of(items)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        elif kind is op.ATOMIC_GROUP:
            inner = _of(value)
        elif kind is op.BRANCH:
            each = [_of(items) for items in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        if inner is not None and len(inner) <= MOST:
            best = _better(best, inner)
    return _better(best, frozenset([run])) if run else best


@cache
def regex_anchor(pattern: str) -> frozenset | None:
    """The anchor of a regular expression, None if it has none, is read without regard to case, or cannot be judged."""
    bare = re.sub(r"\\.", "", pattern, flags=re.DOTALL)
    if _OTHER_ESCAPES & set(re.findall(r"\\(.)", pattern, re.DOTALL)) or "&&" in bare or re.search(r"\[[^\]]*\[", bare):  # classes in classes, which the JVM joins
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return None if tree.state.flags & (re.IGNORECASE | re.VERBOSE) else _of(tree)


def _flat(tree) -> Iterator[tuple]:
    """Parsed items without the groups around them, as long as these set no flags; places without a width are left out."""
    for kind, value in tree:
        if kind is op.SUBPATTERN and not value[1] and not value[2]:
            yield from _flat(value[3])
        elif kind is op.ATOMIC_GROUP:
            yield from _flat(value)
        elif kind is not op.AT:
            yield kind, value


#: Classes that both dialects read alike.
_CATEGORIES = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_NOT_DIGIT: r"\D", op.CATEGORY_SPACE: r"\s", op.CATEGORY_NOT_SPACE: r"\S", op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_WORD: r"\W"}


def _class(tree) -> str | None:
    """A single character class as text, None for anything else."""
    if len(tree) != 1:
        return None
    kind, value = tree[0]
    items = value if kind is op.IN else [(op.NEGATE, None), (op.LITERAL, value)] if kind is op.NOT_LITERAL else [(kind, value)]
    out = ""
    for k, v in items:
        if k is op.NEGATE:
            out += "^"
        elif k is op.LITERAL:
            out += re.escape(chr(v))
        elif k is op.RANGE:
            out += f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}"
        elif k is op.CATEGORY and v in _CATEGORIES:
            out += _CATEGORIES[v]
        else:
            return None
    return f"[{out}]"


#: What stands for a run of a class, and the classes of which an automaton is kept; patterns of further ones have their anchors.
RUN, CLASSES = "\0", 8


@cache
def _runs(text: str) -> re.Pattern:
    return re.compile(text + "+", re.ASCII)


def marked(text_class: str, text: str) -> str:
    """A text with one mark for every run of a class."""
    return _runs(text_class).sub(RUN, text)


def _chains(tree) -> Iterator[tuple[str, str]]:
    """(class, marked text) of what stands together in a sequence of parsed items, for each class that it repeats."""
    parts: list[list[tuple[str | None, str]]] = [[]]  # (None, literal) or (class, "")
    for kind, value in _flat(tree):
        if kind is op.LITERAL:
            parts[-1].append((None, chr(value)))
            continue
        repeated = kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
        text = _class(value[2] if repeated else [(kind, value)]) if not repeated or value[0] > 0 else None
        if text is None:
            parts.append([])
        else:
            parts[-1].append((text, ""))
    for part in parts:
        for text_class in dict.fromkeys(c for c, _ in part if c is not None):
            for own, run in itertools.groupby(part, lambda x: x[0] in (None, text_class)):  # noqa: B023
                if own:
                    literals = [RUN if c else marked(text_class, t) for c, t in run]
                    yield text_class, re.sub(f"{RUN}+", RUN, "".join(literals))


@cache
def regex_chain(pattern: str) -> tuple[str, str] | None:
    """The chain of a regular expression that has an anchor, where it says more than the anchor: (class, marked text)."""
    anchor = regex_anchor(pattern)
    if anchor is None or RUN in "".join(anchor) or re.search(r"\0|\\[0xuN]", pattern):  # a mark of its own
        return None
    letters = lambda c: len(c[1].replace(RUN, ""))
    best = max(_chains(parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))), key=letters, default=None)
    return best if best and letters(best) > min(map(len, anchor)) else None


def token_anchor(pattern) -> frozenset | None:
    """The longest literal token of a token pattern."""
    words = [s.token for s in pattern.steps if s.kind == "literal"]
    return frozenset([max(words, key=lambda w: (len(w), w))]) if words else None


def _automaton(owners: dict[str, list[int]]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for t, own in owners.items():
        out.add_word(t, own)
    if owners:
        out.make_automaton()
    return out if owners else None


class Anchors:
    """The automata over the anchors of numbered patterns, or over their chains where they have some; fold: without regard to case."""

    def __init__(self, anchors: Iterable[frozenset | None], fold: bool = False, chains: Iterable[tuple[str, str] | None] = ()):
        self.always: list[int] = []
        self.fold = fold
        anchors, chains = list(anchors), list(chains)
        common = [c for c, _ in Counter(c for c, _ in filter(None, chains)).most_common(CLASSES)]
        owners: dict[str, list[int]] = {}
        chained: dict[str, dict[str, list[int]]] = {c: {} for c in common}
        for i, (texts, chain) in enumerate(itertools.zip_longest(anchors, chains)):
            if chain is not None and chain[0] in chained:
                chained[chain[0]].setdefault(chain[1], []).append(i)
                continue
            if texts is None:
                self.always.append(i)
            for t in texts or ():
                owners.setdefault(t.casefold() if fold else t, []).append(i)
        self.automaton = _automaton(owners)
        self.chained = {c: _automaton(own) for c, own in chained.items()}

    def candidates(self, text: str) -> list[int]:
        """Numbers of the patterns that can match in a text, ascending."""
        found = set(self.always)
        walks = [(self.automaton, text.casefold() if self.fold else text)] if self.automaton is not None else []
        for automaton, t in itertools.chain(walks, ((a, marked(c, text)) for c, a in self.chained.items())):
            seen = set()
            for _, own in automaton.iter(t):
                if id(own) not in seen:
                    seen.add(id(own))
                    found.update(own)
        return sorted(found)


def candidates_column(text: Column, anchors: list[frozenset | None], chains: list[tuple[str, str] | None]) -> Column:
    """array<int>: for each text the numbers of the patterns that can match in it (null for a null text)."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Anchors(anchors, chains=chains)
        for texts in batches:
            yield pd.Series([None if t is None else known.candidates(t) for t in texts], dtype=object)

    return run(text)
