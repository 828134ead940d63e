"""Rules with sources, sinks and sanitizers, and code patterns, over node tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import PatternNode, Role, Rule, leaves
from . import dataflow as flow
from .anchors import Anchors, token_anchor
from .matching import POSITIVE, evaluate_trees
from .nodes import child_first, classified_column, classify
from .summaries import Program, tainted
from .syntax import parse
from .tokens import MATCH_FIELDS, MATCH_TYPES, NODES, TokenPattern, Tokens, java_regex, row_batches

#: Kinds of entries and the parts of a rule that they fill.
ROLES = ("sources", "sinks", "sanitizers")


def _head(pattern: str) -> str | None:
    """The head of a pattern of a block whose body is an ellipsis, as nodes with a body hold their head for text."""
    m = re.fullmatch(r"(.*[:{])\s*\.\.\.\s*\}?\s*", pattern, re.DOTALL)
    return m and m[1]


def _flattened(trees: list[tuple[str, list[str], PatternNode]]) -> tuple[list[tuple], dict[int, int]]:
    """([(key, number, kind, texts, languages)], {leaf object: number}) of the leaves of pattern trees."""
    out, at = [], {}

    def walk(key: str, languages: list[str], node: PatternNode, around: bool) -> None:
        around = around or node.kind in ("inside", "not-inside")
        if node.text is not None:
            at[id(node)] = len(out)
            texts = [node.text, _head(node.text)] if around else [node.text]
            out.append((key, len(out), node.kind, [t for t in texts if t], tuple(languages)))
        for p in node.parts:
            walk(key, languages, p, around)

    for key, languages, tree in trees:
        walk(key, languages, tree, False)
    return out, at


def node_matches(nodes: DataFrame, leaves_: list[tuple]) -> DataFrame:
    """Leaf patterns on the nodes of files of their languages: a match covers the node's whole text. Spans are node numbers:
    a node's own and one past its last descendant's. Regular expressions are the JVM's; those of `not-regex` are found anywhere."""
    simple = [x for x in leaves_ if x[2] == "simple"]
    anchors = [[token_anchor(TokenPattern(t)) for t in x[3]] for x in simple]
    union = [None if None in a else frozenset().union(*a) for a in anchors]
    names = ["file_id", *[f.split()[0] for f in MATCH_FIELDS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, compiled = Anchors(union, fold=True), {}

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            for k, (node, end, text, language, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 7)))):
                if not text:
                    continue
                tokens, size = Tokens(text), len(text.rstrip("; \t\r\n"))
                for key, no, _, texts, languages in map(simple.__getitem__, known.candidates(text)):
                    if "generic" not in languages and language not in languages:
                        continue
                    for t in texts:
                        if (t, language) not in compiled:
                            compiled[t, language] = TokenPattern(t, language or "generic")
                        for a, b, bound in compiled[t, language].matches(tokens):
                            if a == 0 and b >= size:
                                yield k, (key, no, node, end, low, 1, high, 1, text, [(n, text[x:y]) for n, (x, y) in bound.items()])
                                break

        for batch in batches:
            yield from row_batches(batch, rows_of, names, MATCH_TYPES, NODES)

    last = F.col("post") + F.col("depth") + 1  # a node has post - node_id + depth descendants
    # a whole program is no statement or expression, though it may begin and end as one
    slim = nodes.where("node_type != 'program'").select("file_id", "node_id", last.alias("end"), "text", "language", "start_line", "end_line")
    kind = nodes.schema["file_id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"file_id {kind}, {MATCH_FIELDS}")
    for key, no, kind, texts, languages in leaves_:
        if kind != "simple":
            regex = java_regex(texts[0]) if kind == "not-regex" else rf"\A(?:{java_regex(texts[0])})[;\s]*\z"
            hit = slim.where(F.regexp("text", F.lit(regex)) & (F.lit("generic" in languages) | F.col("language").isin(*languages)))
            fields = [F.lit(key), F.lit(no), F.col("node_id"), F.col("end"), F.col("start_line"), F.lit(1), F.col("end_line"), F.lit(1), F.col("text"), F.create_map().cast("map<string,string>")]
            out = out.unionByName(hit.select("file_id", *[c.cast(f.split()[1]).alias(f.split()[0]) for c, f in zip(fields, MATCH_FIELDS.split(", "))]))
    return out


def tree_nodes(nodes: DataFrame, trees: list[tuple[str, list[str], PatternNode]]) -> DataFrame:
    """(file_id, rule_id, node_id, bindings): nodes that pattern trees keep, a tree being (key, languages, pattern).

    All positive entries of a list hold for one node with the same bindings; `pattern-inside` holds for it or for a node above it. A
    focus on a metavariable moves the result to the nodes at or below whose text it binds.
    """
    flat, at = _flattened(trees)
    found = node_matches(nodes, flat)
    plain = [key for key, _, t in trees if t.text is not None and not t.conditions]
    parts = [found.where(F.col("rule_id").isin(*plain))] if plain else []
    if rest := [(key, t) for key, _, t in trees if key not in set(plain)]:
        parts.append(evaluate_trees(found, rest, at, "file_id", nodes=True))
    kept = reduce(DataFrame.unionByName, parts).select("file_id", "rule_id", F.col("start").alias("node_id"), "end", "bindings")
    focus = {key: c["spec"] if isinstance(c["spec"], str) else c["spec"][0] for key, _, t in trees for c in t.conditions if c["kind"] == "focus-metavariable"}
    if not focus:
        return kept.drop("end")
    name = F.lit(None).cast("string")
    for key, variable in focus.items():
        name = F.when(F.col("rule_id") == key, variable).otherwise(name)
    kept = kept.withColumn("_text", F.try_element_at("bindings", name))
    below = nodes.select("file_id", F.col("node_id").alias("_node"), F.col("text").alias("_text"))
    moved = kept.where("_text is not null").join(below, ["file_id", "_text"]).where("_node >= node_id and _node < end")
    moved = moved.select("file_id", "rule_id", F.col("_node").alias("node_id"), "bindings").dropDuplicates(["file_id", "rule_id", "node_id"])
    return kept.where(~F.col("rule_id").isin(*focus)).select("file_id", "rule_id", "node_id", "bindings").unionByName(moved)


def role_nodes(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, node_id, rule_id, role, entry): nodes that a rule's sources, sinks and sanitizers name."""
    trees = [(f"{r.id}\t{role}\t{k}", r.languages, x.pattern) for r in rules for role in ROLES for k, x in enumerate(r.roles[role])]
    key = F.split("rule_id", "\t")
    return tree_nodes(nodes, trees).select("file_id", "node_id", key[0].alias("rule_id"), key[1].alias("role"), key[2].cast("int").alias("entry")).distinct()


def value_edges(nodes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(file_id, src, dst) along which values go: from operands and arguments to what holds them, and from an
    assignment or a parameter to the later identifiers that read its variable, up to its next assignment.

    A variable is its function's own if the function assigns it before (nodes have `scope`), else that of the file.
    Arguments of calls in resolved(file_id, call) do not go to the call: they go into its function.
    """
    p = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("_type"), F.col("text").alias("_text"))
    holders = ("assignment", "call_expression", "binary_expression", "return_statement", "member_expression")
    callee = F.trim(F.substring_index("_text", "(", 1))
    up = nodes.join(p, ["file_id", "parent_id"]).where(F.col("_type").isin(*holders) & ~((F.col("_type") == "call_expression") & (F.col("text") == callee)))
    up = up.where(~((F.col("_type") == "assignment") & (F.col("sibling_idx") == 0) & (F.col("node_type") == "identifier") & (F.col("text") == F.trim(F.substring_index("_text", "=", 1)))))
    if resolved is not None:
        known = resolved.select("file_id", F.col("call").alias("parent_id"), F.lit(True).alias("_known")).distinct()
        up = up.join(known, ["file_id", "parent_id"], "left").where(F.col("_known").isNull() | F.col("arg").isNull())
    up = up.select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    # an assignment has been made when it ends: in post order it comes after its own operands and before later readers
    scope = F.col("scope") if "scope" in nodes.columns else F.lit(0).cast("long")
    name = F.when(F.col("node_type") == "parameter", F.col("text")).otherwise(F.regexp_extract(F.substring_index("text", "=", 1), r"([^\s.]+)\s*$", 1))
    defs = nodes.where("node_type in ('assignment', 'parameter')").select("file_id", scope.alias("scope"), name.alias("var"), "post", F.col("node_id").alias("def"), F.lit(None).cast("long").alias("use"))
    uses = nodes.where("node_type = 'identifier'").select("file_id", scope.alias("scope"), F.regexp_replace("text", r"^\$", "").alias("var"), "post", F.lit(None).cast("long").alias("def"), F.col("node_id").alias("use"))
    defs = defs.withColumn("var", F.regexp_replace("var", r"^\$", ""))
    last = lambda *keys: F.last("def", ignorenulls=True).over(Window.partitionBy("file_id", *keys, "var").orderBy("post").rowsBetween(Window.unboundedPreceding, -1))
    own = defs.unionByName(uses).withColumn("src", last("scope")).where("use is not null")
    read = own.where("src is not null").select("file_id", "src", F.col("use").alias("dst"))
    far = own.where("src is null and scope != 0").drop("src").unionByName(defs.where("scope = 0")).withColumn("src", last()).where("use is not null and src is not null")
    return up.unionByName(read).unionByName(far.select("file_id", "src", F.col("use").alias("dst")))


def call_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """What calls and functions of a file have to do with each other, by name within the file.

    calls(file_id, call, function, scope), arguments(file_id, argument, call, function, parameter), parameters(file_id, function,
    parameter) and returns(file_id, function, ret). An argument goes to the parameter at its place.
    """
    name = F.regexp_extract(F.trim(F.substring_index("text", "(", 1)), r"([\w$]+)$", 1)
    functions = nodes.where("node_type = 'function_declaration'").select("file_id", F.regexp_extract("text", r"([\w$]+)\s*\(", 1).alias("name"), F.col("node_id").alias("function"))
    calls = nodes.where("node_type = 'call_expression'").select("file_id", name.alias("name"), F.col("node_id").alias("call"), "scope").join(functions, ["file_id", "name"]).drop("name")
    place = F.row_number().over(Window.partitionBy("file_id", "scope").orderBy("node_id")) - 1
    own = nodes.where("node_type = 'parameter' and text not in ('self', 'cls', 'this')").select("file_id", F.col("scope").alias("function"), F.col("node_id").alias("parameter"), place.alias("arg"))
    given = nodes.where("arg is not null").select("file_id", F.col("parent_id").alias("call"), "arg", F.col("node_id").alias("argument"))
    arguments = given.join(calls.drop("scope"), ["file_id", "call"]).join(own, ["file_id", "function", "arg"])
    returns = nodes.where("node_type = 'return_statement' and scope != 0").select("file_id", F.col("scope").alias("function"), F.col("node_id").alias("ret"))
    return {"calls": calls, "arguments": arguments.select("file_id", "argument", "call", "function", "parameter"), "parameters": own.select("file_id", "function", "parameter"), "returns": returns}


def _labelled(rule: Rule) -> bool:
    return any(x.label != Role.label or x.requires for some in rule.roles.values() for x in some)


def flow_nodes(nodes: DataFrame, roles: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, rule_id, node_id, source, labels): sinks that values of sources reach, across functions of a file.

    One row for each sink and source; of rules with labels one for each sink, with the labels that reach it. The edges come from
    joins over all files; they are then grouped by file, and each file's are walked once for each of its rules (see summaries).
    """
    role = lambda x: roles.where(F.col("role") == x)
    both = role("sources").select("file_id", "rule_id").intersect(role("sinks").select("file_id", "rule_id"))
    some = nodes.join(both.select("file_id").distinct(), "file_id", "left_semi")
    tables = call_tables(some)
    fact = lambda df, kind, *cols, rule=F.lit(None), entry=F.lit(None): df.select("file_id", F.lit(kind).alias("kind"), *[(F.col(cols[k]) if k < len(cols) else F.lit(None)).cast("long").alias(n) for k, n in enumerate("abcd")], rule.cast("string").alias("rule"), entry.cast("int").alias("entry"))
    calls = tables["calls"]
    facts = [fact(value_edges(some, calls), "edge", "src", "dst"), fact(tables["arguments"], "argument", "argument", "call", "function", "parameter"), fact(calls, "call", "function", "call", "scope"), fact(tables["parameters"], "parameter", "function", "parameter"), fact(tables["returns"], "return", "function", "ret")]
    facts.append(fact(roles.join(both, ["file_id", "rule_id"], "left_semi"), "role", "node_id", rule=F.concat_ws("\t", "role", "rule_id"), entry=F.col("entry")))
    specs = {r.id: ([(x.label, x.requires) for x in r.roles["sources"]], [x.requires for x in r.roles["sinks"]], _labelled(r), r.dataflow["max_depth"] if r.dataflow.get("bounded") else None) for r in rules}

    def found(rows: list[tuple]) -> Iterator[tuple]:
        program, by_rule = Program(), {}
        for kind, a, b, c, d, rule, entry in rows:
            if kind == "edge":
                program.next[a].append(b)
            elif kind == "argument":
                program.arguments.append((a, b, c, d))
            elif kind == "call":
                program.calls[a].append(b)
                program.called_in[c].add(a)
            elif kind == "parameter":
                program.parameters[a].append(b)
            elif kind == "return":
                program.returns[a].append(b)
            else:
                role, name = rule.split("\t", 1)
                by_rule.setdefault(name, {r: [] for r in ROLES})[role].append((a, entry))
        for name, mine in sorted(by_rule.items()):
            given, wanted, labelled, depth = specs[name]
            sources = sorted(mine["sources"])
            hits = tainted(program, [(n, *given[k]) for n, k in sources], [(n, wanted[k]) for n, k in sorted(mine["sinks"])], {n for n, _ in mine["sanitizers"]}, depth)
            if labelled:
                for node in dict.fromkeys(n for n, _ in hits):
                    yield name, node, None, sorted({given[sources[i][1]][0] for n, bits in hits if n == node for i in bits})
            else:
                for node, source in sorted({(n, sources[i][0]) for n, bits in hits for i in bits}):
                    yield name, node, source, [given[0][0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(owner: pa.Array, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            one = pa.RecordBatch.from_arrays([owner], ["file_id"])
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            return row_batches(one, lambda _: ((0, x) for x in found(rows)), ["file_id", "rule_id", "node_id", "source", "labels"], types)

        now, owner, rows = None, None, []
        for batch in batches:
            for i, (f, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if owner is None or f != now:
                    if owner is not None:
                        yield from leave(owner, rows)
                    now, owner, rows = f, batch.column(0).slice(i, 1), []
                rows.append(row)
        if owner is not None:
            yield from leave(owner, rows)

    kind = nodes.schema["file_id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, facts).repartition("file_id").sortWithinPartitions("file_id").mapInArrow(run, f"file_id {kind}, rule_id string, node_id long, source long, labels array<string>")


def evaluate_flows(files: DataFrame, rules: list[Rule], how: str = "flow", id_col: str = "file_id", text_col: str = "source") -> DataFrame:
    """Findings of rules with a dataflow part: (file_id, rule_id, start_line, end_line, source_line, confidence, labels).

    how="flow": sinks that a source's value reaches, in its own function or through calls of functions of the file; it ends at
    sanitizers, and after the rule's max_depth edges where the rule names one. Of rules with labels, sinks whose
    `requires` the labels that reach them satisfy (source_line is null). how="exists", and rules whose must_flow is false:
    every sink of a file that holds any source, whatever lies between; source_line is null. Rules without a
    dataflow part and disabled ones find nothing, a rule looks at files of its languages only, and files without a source or a sink leave
    before the graph is built.
    """
    active = [r for r in rules if r.enabled and r.dataflow]
    kind = files.schema[id_col].dataType.simpleString()
    if not active:
        return files.sparkSession.createDataFrame([], f"file_id {kind}, rule_id string, start_line int, end_line int, source_line int, confidence double, labels array<string>")
    nodes = flow.saved(parse(files, id_col=id_col, text_col=text_col, detail=True), "nodes")
    roles = flow.saved(role_nodes(nodes, active), "roles")
    at = nodes.select("file_id", "node_id", "start_line", "end_line")
    loose = [r.id for r in active if how == "exists" or not r.dataflow["must_flow"]]
    strict = [r for r in active if r.id not in loose]
    out = []
    columns = ["file_id", "rule_id", "start_line", "end_line", "source_line", "confidence", "labels"]
    if loose:
        mine = roles.where(F.col("rule_id").isin(*loose))
        hit = mine.where("role = 'sinks'").select("file_id", "rule_id", "node_id").distinct().join(mine.where("role = 'sources'").select("file_id", "rule_id").distinct(), ["file_id", "rule_id"], "left_semi")
        out.append(hit.join(at, ["file_id", "node_id"]).withColumns({"source_line": F.lit(None).cast("int"), "confidence": F.lit(1.0), "labels": F.lit(None).cast("array<string>")}).select(columns))
    if strict:
        hit = flow_nodes(nodes, roles.where(F.col("rule_id").isin(*[r.id for r in strict])), strict)
        origin = nodes.select("file_id", F.col("node_id").alias("source"), F.col("start_line").alias("source_line"))
        out.append(hit.join(at, ["file_id", "node_id"]).join(origin, ["file_id", "source"], "left").withColumn("confidence", F.lit(1.0)).select(columns))
    return reduce(DataFrame.unionByName, out)


def context_taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, graph: str | None = None) -> DataFrame:
    """Flows from sources to sinks of the same context (sources and sinks carry `context`; null is a context like others).

    A taint is named by its source and context, so one pass follows all contexts side by side. graph: see taint().
    """
    c = F.coalesce("context", F.lit(""))
    pairs = sources.select(c.alias("context")).intersect(sinks.select(c.alias("context")))
    starts = sources.withColumn("context", c).join(pairs, "context", "left_semi").select("node", F.struct(F.col("node").alias("node"), F.col("context").alias("context")).alias("source"), "vulnerability_type", "confidence", *([graph] if graph else []))
    found = flow.flows(flow.taint(edges, starts, sanitizers, graph), sinks.select("node", "vulnerability_type").distinct(), sanitizers)
    mine = sinks.select(F.col("node").alias("sink"), c.alias("context")).distinct()
    out = found.withColumn("context", F.col("source.context")).join(mine, ["sink", "context"], "left_semi")
    return out.select(F.col("source.node").alias("source"), "sink", "context", "vulnerability_type", "path", "confidence", "vulnerable")


def evaluate_nodes(files: DataFrame, rules: list[Rule], id_col: str = "file_id", text_col: str = "source") -> DataFrame:
    """Nodes that rules match by their classification, in files of their languages; the innermost of those that enclose each other.

    Of a list the positive entries hold for one node, `pattern-not` for none of it, `pattern-inside` and `pattern-not-inside` for it
    or a node above it; bindings that entries share are alike. Conditions of a list act on the bindings.
    """
    nodes = flow.saved(parse(files, id_col=id_col, text_col=text_col, detail=True), "nodes")
    active = [r for r in rules if r.enabled and r.pattern]
    flat, at = _flattened([(r.id, r.languages, r.pattern) for r in active])
    if not flat:
        return nodes.where("false").select("file_id", F.lit("").alias("rule_id"), "node_id", "node_type", "text", "start_line", "end_line")
    by_class = [x for x in flat if x[2] == "simple" and not _by_tokens(x[3][0])]
    known = {x[1] for x in by_class}
    found = node_matches(nodes, [x for x in flat if x[1] not in known])
    if by_class:
        tests = [F.when((F.lit("generic" in langs) | F.col("language").isin(*langs)) & _any([classified_column(t) for t in texts]), F.struct(F.lit(key).alias("rule_id"), F.lit(no).alias("pattern_no"))) for key, no, _, texts, langs in by_class]
        hit = nodes.withColumn("_hit", F.explode_outer(F.array_compact(F.array(*tests)))).where("_hit is not null")
        fields = [F.col("_hit.rule_id"), F.col("_hit.pattern_no"), F.col("node_id"), F.col("post") + F.col("depth") + 1, F.col("start_line"), F.lit(1), F.col("end_line"), F.lit(1), F.col("text"), F.create_map().cast("map<string,string>")]
        found = found.unionByName(hit.select("file_id", *[c.cast(f.split()[1]).alias(f.split()[0]) for c, f in zip(fields, MATCH_FIELDS.split(", "))]))
    kept = evaluate_trees(found, [(r.id, r.pattern) for r in active], at, "file_id", nodes=True)
    hit = kept.select("file_id", "rule_id", F.col("start").alias("node_id"), "bindings").dropDuplicates(["file_id", "rule_id", "node_id"]).join(nodes, ["file_id", "node_id"])
    return child_first(hit, ("file_id", "rule_id")).select("file_id", "rule_id", "node_id", "node_type", "text", "start_line", "end_line", "bindings")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _by_tokens(pattern: str) -> bool:
    """Whether a code pattern is matched by its tokens: it binds metavariables, names arguments, or is a block's head; the
    others (names, literals, imports, calls of any arguments) by what they look for."""
    bare = re.sub(r"^\s*\$[A-Z]\w*(?=[.(])", "", pattern)
    return "$" in bare.replace("$...", "") or _head(pattern) is not None or ("call" in classify(pattern) and not re.search(r"\(\s*\.\.\.\s*\)\s*;?\s*$", pattern))
