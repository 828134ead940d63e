"""The pattern algebra over matches: union, either, all, not, inside, conditions, spans."""

from __future__ import annotations

import itertools
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import included
from ..plans.extensions import Extensions, option
from ..plans.rules import PatternNode, Rule, leaves
from ..plans.storage import saved
from .conditions import clause_column, every
from .tokens import PLACE, Leaf, java_regex, match_leaves

#: Kinds of entries of a list that its matches come from.
POSITIVE = ("simple", "regex", "either", "all")


def evaluate(files: DataFrame, rules: list[Rule], id_col: str = "file_id", text_col: str = "source", language_col: str | None = "language", combine: str = "all", inside_mode: str = "ancestor", path_col: str | None = None, statements: bool | None = None, extensions: Extensions | None = None) -> DataFrame:
    """Matches of whole rules: leaves in one pass over the files, then all other rules in one pass over (file, rule).

    combine "all" keeps matches of the first positive entry that overlap a match of every other
    one; "union" keeps all entries' matches and ignores negative ones. A list without positive
    entries keeps the enclosing matches of its first `pattern-inside`; of negative entries alone
    there is nothing to keep. Rules of single patterns, or of alternatives of them, are one filter
    over that pass, whose equal spans of a file are dropped inside the file's own row: they run on
    streams without state. Where there are others, the pass's matches (never texts) are written once
    to the shared folder and one grouped pass combines them, however many rules there are. Nothing is collected. Rules without a pattern and
    disabled ones match nothing. With path_col, a rule's own include and exclude paths hold (one pass for each
    different set of them). `statements` is the run's choice of matching SQL statement by statement,
    which a rule's option overrides. extensions holds the conditions that rules name by `custom-condition`. A rule's focus moves
    its matches to the metavariable's place; in a list, that of the first positive entry, where it is bound by tokens.
    """
    active = [r for r in rules if r.enabled and r.pattern]
    groups: dict[str, list[Rule]] = {}
    for r in active:
        groups.setdefault(json.dumps(r.paths if path_col else {}, sort_keys=True), []).append(r)
    parts = []
    for paths, some in groups.items():
        wanted = json.loads(paths)
        taken = files.where(included(F.col(path_col), wanted.get("include") or [], wanted.get("exclude") or [])) if wanted else files
        parts += _evaluate(taken, some, id_col, text_col, language_col, combine, inside_mode, statements, extensions)
    return reduce(DataFrame.unionByName, parts) if parts else match_leaves(files, [], id_col, text_col, language_col)


def _evaluate(files: DataFrame, active: list[Rule], id_col: str, text_col: str, language_col: str | None, combine: str, inside_mode: str, statements: bool | None, extensions: Extensions | None) -> list[DataFrame]:
    flat, at = [], {}
    plain = [r for r in active if _plain(r.pattern)]
    for r in active:
        by_statement = option(r, "sql_statement_boundary", None if statements is None else str(statements))
        for leaf in leaves(r.pattern):
            at[id(leaf)] = len(flat)
            flat.append(Leaf(r.id, len(flat), "simple" if leaf.kind == "simple" else "regex", leaf.text, tuple(r.languages), by_statement, r.focus if r in plain else None, None if r in plain else r.focus))
    found = match_leaves(files, flat, id_col, text_col, language_col, once={r.id for r in plain})
    if len(plain) == len(active):
        return [_with_conditions(found, plain, extensions)]
    found = saved(found, "matches")
    parts = []
    if plain:
        numbers = [at[id(leaf)] for r in plain for leaf in leaves(r.pattern)]
        parts.append(_with_conditions(found.where(F.col("pattern_no").isin(numbers)), plain, extensions))
    lists = evaluate_trees(found, [(r.id, r.pattern) for r in active if r not in plain], at, id_col, combine, inside_mode, extensions=extensions)
    parts.append(_focused(lists) if any(r.focus for r in active if r not in plain) else lists)
    return parts


def _focused(matches: DataFrame) -> DataFrame:
    """Matches moved to the place that they keep of a metavariable; those without one as they are."""
    place = F.split(F.try_element_at("bindings", F.lit(PLACE)), ":", 7)
    columns = ("start", "end", "start_line", "start_column", "end_line", "end_column", "matched")
    moved = {c: F.coalesce(F.get(place, k).cast(matches.schema[c].dataType), F.col(c)) for k, c in enumerate(columns)}
    return matches.withColumns({**moved, "bindings": F.map_filter("bindings", lambda k, _: k != PLACE)})


def _with_conditions(found: DataFrame, rules: list[Rule], extensions: Extensions | None) -> DataFrame:
    """Conditions of a single pattern hold on its own matches."""
    for r in rules:
        if clauses := [c for c in r.pattern.conditions if c["kind"] != "focus-metavariable"]:
            found = found.where((F.col("rule_id") != r.id) | every([clause_column(c, extensions) for c in clauses]))
    return found


def _plain(node: PatternNode, top: bool = True) -> bool:
    """A positive leaf, with conditions only where it is the whole rule, or alternatives of leaves of one kind without any."""
    if node.text is not None:
        return node.kind in ("simple", "regex") and (top or not node.conditions)
    return node.kind == "either" and not node.conditions and all(p.text is not None and _plain(p, False) for p in node.parts) and len({p.kind for p in node.parts}) == 1


def _clauses(node: PatternNode):
    """All (node, condition) pairs of a tree that act on matches."""
    for c in node.conditions:
        if c["kind"] != "focus-metavariable":
            yield node, c
    for p in node.parts:
        yield from _clauses(p)


def evaluate_trees(found: DataFrame, trees: list[tuple[str, PatternNode]], at: dict[int, int], id_col: str, combine: str = "all", inside_mode: str = "ancestor", nodes: bool = False, extensions: Extensions | None = None) -> DataFrame:
    """Matches of whole pattern trees, for all rules in one pass over their leaves' matches, grouped by file and rule.

    Conditions are columns and are worked out first, as one array a match; then a group's matches are combined by sorted
    lookups (see Spans), so a group costs its sorting whatever the tree. nodes: the spans are numbers of syntax nodes, and
    entries of a list hold for one and the same node, not for texts that overlap.
    """
    numbers: dict[int, list[int]] = {}  # of a node's conditions among its rule's
    held = None
    for rule_id, tree in trees:
        columns = []
        for node, c in _clauses(tree):
            columns.append((node, F.coalesce(clause_column(c, extensions), F.lit(False))))
        for k, (node, _) in enumerate(columns):
            numbers.setdefault(id(node), []).append(k)
        if columns:
            held = (F if held is None else held).when(F.col("rule_id") == rule_id, F.array(*[c for _, c in columns]))
    compiled = {rule_id: _plan(tree, at, numbers) for rule_id, tree in trees}
    mine = found.where(F.col("rule_id").isin(*compiled)).withColumn("_held", F.lit(None).cast("array<boolean>") if held is None else held)
    keys = [id_col, "rule_id"]
    order = [*keys, "start", "end", "pattern_no"]
    wanted = [mine.columns.index(c) for c in (id_col, "rule_id", "start", "end", "pattern_no", "bindings", "_held")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive sorted; a group's batches are kept until it ends, then its chosen rows go out."""
        now, kept, rows = None, [], []

        def leave() -> Iterator[pa.RecordBatch]:
            chosen = combined(compiled[now[1]], rows, combine, inside_mode, nodes)
            table = pa.Table.from_batches(kept).take(pa.array(chosen, pa.int64())).drop_columns(["_held"])
            yield from table.to_batches()

        for batch in batches:
            start = 0
            for i, (f, r, *row) in enumerate(zip(*(batch.column(k).to_pylist() for k in wanted))):
                if (f, r) != now:
                    if now is not None:
                        if i > start:
                            kept.append(batch.slice(start, i - start))
                        yield from leave()
                    now, kept, rows, start = (f, r), [], [], i
                rows.append((*row[:3], {k: v for k, v in row[3] or () if k != PLACE}, row[4]))
            kept.append(batch.slice(start))
        if now is not None:
            yield from leave()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return mine.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, fields)


def _plan(node: PatternNode, at: dict[int, int], numbers: dict) -> tuple:
    """A tree without objects of the driver: (kind, leaf number, parts, numbers of its conditions)."""
    return node.kind, None if node.text is None else at[id(node)], [_plan(p, at, numbers) for p in node.parts], numbers.get(id(node), [])


class Spans:
    """Matches sorted by start with the greatest end so far, and by start from behind with the least end: whether any of
    them overlaps, holds or lies in a given span is one bisection. With bindings, matches are filed by the values of
    the metavariables that both sides bind."""

    def __init__(self, rows: list[tuple]):
        self.filed: dict[tuple, dict[tuple, list]] = {}
        self.kinds: dict[frozenset, list] = {}
        for r in rows:
            self.kinds.setdefault(frozenset(r[3]), []).append(r)

    def _of(self, bound: dict, alike: bool) -> Iterator[tuple]:
        for names, rows in self.kinds.items():
            shared = tuple(sorted(names & bound.keys())) if alike else ()
            files = self.filed.get((names, shared))
            if files is None:
                files = {}
                for r in rows:
                    files.setdefault(tuple(r[3][n] for n in shared), []).append((r[0], r[1]))
                for key, spans in files.items():
                    spans.sort()
                    tops, lows = list(itertools.accumulate((e for _, e in spans), max)), list(itertools.accumulate((e for _, e in reversed(spans)), min))[::-1]
                    files[key] = ([a for a, _ in spans], tops, lows, set(spans))
                self.filed[names, shared] = files
            hit = files.get(tuple(bound[n] for n in shared))
            if hit:
                yield hit

    def overlaps(self, start: int, end: int, bound: dict) -> bool:
        return any((k := bisect_left(starts, end)) and tops[k - 1] > start for starts, tops, _, _ in self._of(bound, True))

    def same(self, start: int, end: int, bound: dict) -> bool:
        return any((start, end) in spans for *_, spans in self._of(bound, True))

    def holds(self, start: int, end: int, bound: dict, alike: bool = False) -> bool:
        return any((k := bisect_right(starts, start)) and tops[k - 1] >= end for starts, tops, _, _ in self._of(bound, alike))

    def within(self, start: int, end: int, bound: dict, alike: bool = False) -> bool:
        return any((k := bisect_left(starts, start)) < len(starts) and lows[k] <= end for starts, _, lows, _ in self._of(bound, alike))

    def edge(self, before: bool) -> int | None:
        """The end of the first to end, or the start of the last to begin."""
        every = [r for rows in self.kinds.values() for r in rows]
        return None if not every else min(r[1] for r in every) if before else max(r[0] for r in every)


def combined(plan: tuple, rows: list[tuple], combine: str = "all", inside_mode: str = "ancestor", nodes: bool = False) -> list[int]:
    """Numbers of the rows (start, end, leaf, bindings, conditions) of one file and rule that a tree keeps, as it lists them."""
    kind, leaf, parts, conditions = plan
    sub = lambda p: combined(p, rows, combine, inside_mode, nodes)
    alone = lambda p: sub(p if p[1] is not None else p[2][0])
    if leaf is not None:
        out = [i for i, r in enumerate(rows) if r[2] == leaf]
    elif kind == "either":
        first: dict[tuple, int] = {}  # of equal spans of a leaf's alternatives that of the least leaf
        for i in sorted((i for p in parts for i in sub(p)), key=lambda i: rows[i][2]):
            first.setdefault((rows[i][0], rows[i][1]), i)
        out = list(first.values())
    elif kind == "all":
        positive = [p for p in parts if p[0] in POSITIVE]
        if not positive:
            around = [p for p in parts if p[0] == "inside"]
            positive = [p if p[1] is not None else p[2][0] for p in around[:1]]
        if not positive:
            return []
        if combine == "union":
            out = [i for p in positive for i in sub(p)]
        else:
            out = sub(positive[0])
            for p in positive[1:]:
                other = Spans([rows[i] for i in sub(p)])
                test = other.same if nodes else other.overlaps
                out = [i for i in out if test(*rows[i][:2], rows[i][3])]
            for p in parts:
                if p[0] in ("inside", "not-inside"):
                    other = Spans([rows[i] for i in alone(p)])
                    test = other.holds if inside_mode == "ancestor" else other.within
                    out = [i for i in out if test(*rows[i][:2], rows[i][3], nodes) == (p[0] == "inside")]
                elif p[0] in ("not", "not-regex"):
                    other = Spans([rows[i] for i in alone(p)])
                    test = other.same if nodes else other.overlaps
                    out = [i for i in out if not test(*rows[i][:2], rows[i][3])]
                elif p[0] in ("followed-by", "preceded-by"):
                    edge = Spans([rows[i] for i in alone(p)]).edge(p[0] == "preceded-by")
                    out = [i for i in out if edge is not None and (edge <= rows[i][0] if p[0] == "preceded-by" else edge >= rows[i][1])]
    else:
        out = sub(parts[0])
    return [i for i in out if all(rows[i][4][k] for k in conditions)]


def overlapping(left: DataFrame, right: DataFrame, id_col: str, anti: bool = False) -> DataFrame:
    """Matches of left that overlap (anti: do not) a match of right in the same file, with equal shared bindings."""
    leaf = lambda n: PatternNode("simple", str(n))
    parts = [leaf(0), PatternNode("not", None, [leaf(1)]) if anti else leaf(1)]
    inner = parts[1].parts[0] if anti else parts[1]
    both = left.withColumns({"rule_id": F.lit("r"), "pattern_no": F.lit(0), "_left": F.struct(*left.columns)}).select(id_col, "rule_id", "pattern_no", "start", "end", "bindings", "_left")
    other = right.select(id_col, F.lit("r").alias("rule_id"), F.lit(1).alias("pattern_no"), "start", "end", "bindings", F.lit(None).cast(both.schema["_left"].dataType).alias("_left"))
    out = evaluate_trees(both.unionByName(other), [("r", PatternNode("all", None, parts))], {id(parts[0]): 0, id(inner): 1}, id_col)
    return out.select("_left.*")


def contained(inner: DataFrame, outer: DataFrame, id_col: str, wanted: bool = True, mode: str = "ancestor") -> DataFrame:
    """Matches inside (or not inside) an outer one; mode "descendant" looks for an outer one inside the match instead.

    Both sides are sorted together by start: an outer match holds an inner one if the greatest end of those that start no later
    reaches its end. No pairs are made, so a file of any number of matches costs its sorting.
    """
    return nested(inner, outer, [id_col], wanted, mode == "ancestor", "start", "end")


def nested(inner: DataFrame, outer: DataFrame, keys: list[str], wanted: bool, above: bool, start: str, end: str, strict: bool = False) -> DataFrame:
    """Rows of inner that an outer span of their keys holds (above), or that hold one; strict: one that starts elsewhere."""
    both = inner.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(None).cast("long").alias("_o"), F.struct(*inner.columns).alias("_row"))
    other = outer.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(end).cast("long").alias("_o"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"))
    reach = Window.partitionBy(*keys).orderBy((F.col("_s") if above else -F.col("_s")).cast("long")).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    edge = (F.max("_o") if above else F.min("_o")).over(reach)
    hit = F.coalesce(edge >= F.col("_e") if above else edge <= F.col("_e"), F.lit(False))
    return both.unionByName(other).withColumn("_hit", hit).where(F.col("_row").isNotNull() & (F.col("_hit") == wanted)).select("_row.*")


def with_follower(left: DataFrame, right: DataFrame, keys: list[str], before: bool = False, column: str = "followed") -> DataFrame:
    """Matches of left with whether a match of right of the same keys begins after their end (before: ends before their start).

    One right match decides for all left ones of its keys, the last to begin or the first to end, so no pairs are made.
    """
    edge = F.min("end") if before else F.max("start")
    r = right.groupBy(*keys).agg(edge.alias("_edge"))
    test = F.col("_edge") <= F.col("start") if before else F.col("_edge") >= F.col("end")
    return left.join(r, keys, "left").withColumn(column, F.coalesce(test, F.lit(False))).drop("_edge")


def followed_by(left: DataFrame, right: DataFrame, keys: list[str], before: bool = False) -> DataFrame:
    """Matches of left that a match of right of the same keys follows (before: precedes)."""
    return with_follower(left, right, keys, before, "_followed").where("_followed").drop("_followed")


def innermost(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that hold no other match of the same keys (child-first search): none that starts later ends as soon, and none
    that starts with it ends sooner."""
    later = Window.partitionBy(*keys).orderBy((-F.col("start")).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy(*keys, "start")
    marked = matches.withColumns({"_later": F.min("end").over(later), "_beside": F.min("end").over(beside)})
    return marked.where((F.col("_later").isNull() | (F.col("_later") > F.col("end"))) & (F.col("_beside") >= F.col("end"))).drop("_later", "_beside")


def smallest_spans(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy choice of non-overlapping spans, shortest first, then leftmost, then by the other columns.

    Spans come sorted to one pass that keeps the chosen ones of the current keys in order and finds room by bisection.
    """
    rest = [c for c in matches.columns if c not in (*keys, "start", "end")]
    order = [*keys, F.col("end") - F.col("start"), "start", *rest]
    at = [matches.columns.index(c) for c in (*keys, "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lows, highs = None, [], []
        for batch in batches:
            keep = []
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in at))):
                key, low, high = row[:-2], row[-2], row[-1]
                if key != now:
                    now, lows, highs = key, [], []
                k = bisect_left(lows, high)  # chosen spans before k start before this one ends
                if not k or highs[k - 1] <= low:
                    lows.insert(k, low)
                    highs.insert(k, high)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema.fields)
    return matches.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, fields)


def consecutive(df: DataFrame, partition: list[str], order: list[str], column: str, values: list[str]) -> DataFrame:
    """Rows at which a run of consecutive siblings has exactly these values."""
    w = Window.partitionBy(*partition).orderBy(*order)
    tests = [F.col(column) == values[0]] + [F.lead(column, i).over(w) == v for i, v in enumerate(values[1:], 1)]
    named = df.withColumns({f"_t{i}": t for i, t in enumerate(tests)})
    return named.where(reduce(lambda a, b: a & b, [F.col(f"_t{i}") for i in range(len(tests))])).drop(*[f"_t{i}" for i in range(len(tests))])


def interpolate(message: Column, bindings: Column) -> Column:
    """$NAME and ${NAME} in a message by their bindings, longer names first, so that $1 leaves $10 alone."""
    step = lambda acc, e: F.replace(F.replace(acc, F.concat(F.lit("${"), F.ltrim(e["key"], F.lit("$")), F.lit("}")), e["value"]), e["key"], e["value"])
    by_length = F.transform(F.map_entries(bindings), lambda e: F.struct((-F.char_length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.aggregate(F.array_sort(by_length), message, step)


def fixed(matches: DataFrame, rules: list[Rule], column: str = "fixed") -> DataFrame:
    """Matches with the matched text as the rule's fix leaves it: its fix-regex applied, else its fix with bindings filled in, else null."""
    made = F.lit(None).cast("string")
    for r in rules:
        if r.fix_regex:
            done = F.regexp_replace("matched", java_regex(r.fix_regex["regex"]), re.sub(r"\\(\d)", r"$\1", r.fix_regex["replacement"]))
        elif r.fix is not None:
            done = interpolate(F.lit(r.fix), F.col("bindings"))
        else:
            continue
        made = F.when(F.col("rule_id") == r.id, done).otherwise(made)
    return matches.withColumn(column, made)


def findings(matches: DataFrame, rules: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Matches with their rule's severity, confidence, interpolated message and fix; the rules table is a driver-side list."""
    r = rules.select("rule_id", "message", "severity", "severity_ord", "confidence", "confidence_ord", "fix", "metadata")
    out = matches.join(r, "rule_id")
    return out.withColumn("message", interpolate(F.col("message"), F.col("bindings")))
