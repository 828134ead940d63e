"""Graphs, taint and constants over (src, dst) tables. Every operator is partitioned by its graph column(s)."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.storage import fixpoint, saved

#: Built-in sources (node type, name, kind, confidence), first match wins.
SOURCES = [
    ("call_expression", "request.getParameter", "UserInput", 0.9), ("call_expression", "request.getHeader", "HeaderInput", 0.9), ("call_expression", "request.getCookies", "CookieInput", 0.9),
    ("call_expression", "readFile", "FileInput", 0.8), ("call_expression", "fs.readFileSync", "FileInput", 0.9), ("call_expression", "executeQuery", "DatabaseInput", 0.7),
    ("call_expression", "getenv", "EnvironmentInput", 0.6), ("identifier", "process.env", "EnvironmentInput", 0.7), ("identifier", "sys.argv", "CommandLineInput", 0.8), ("identifier", "process.argv", "CommandLineInput", 0.8),
]
#: Built-in sinks (node type, name, kind, vulnerability, confidence).
SINKS = [
    ("call_expression", "executeQuery", "SqlExecution", "SQL_INJECTION", 0.9), ("call_expression", "query", "SqlExecution", "SQL_INJECTION", 0.8), ("call_expression", "exec", "CommandExecution", "COMMAND_INJECTION", 0.9),
    ("call_expression", "system", "CommandExecution", "COMMAND_INJECTION", 0.9), ("call_expression", "writeFile", "FileOperation", "PATH_TRAVERSAL", 0.8), ("call_expression", "open", "FileOperation", "PATH_TRAVERSAL", 0.7),
    ("call_expression", "innerHTML", "HtmlOutput", "XSS", 0.9), ("call_expression", "document.write", "HtmlOutput", "XSS", 0.9), ("call_expression", "eval", "JavaScriptEvaluation", "CODE_INJECTION", 0.95),
    ("call_expression", "log", "LogOutput", "LOG_INJECTION", 0.6), ("call_expression", "console.log", "LogOutput", "LOG_INJECTION", 0.5),
]
#: Built-in sanitizers (node type, name, kind, effectiveness, vulnerabilities).
SANITIZERS = [
    ("call_expression", "prepareStatement", "SqlParameterBinding", 0.95, ["SQL_INJECTION"]), ("call_expression", "htmlEncode", "HtmlEncoding", 0.9, ["XSS"]), ("call_expression", "escapeHtml", "HtmlEncoding", 0.9, ["XSS"]),
    ("call_expression", "encodeURIComponent", "UrlEncoding", 0.8, ["XSS"]), ("call_expression", "validate", "InputValidation", 0.8, ["INPUT_VALIDATION"]), ("call_expression", "sanitize", "InputValidation", 0.7, ["XSS", "SQL_INJECTION"]),
    ("call_expression", "path.normalize", "PathNormalization", 0.8, ["PATH_TRAVERSAL"]), ("call_expression", "match", "RegexValidation", 0.6, ["INPUT_VALIDATION"]), ("call_expression", "length", "LengthValidation", 0.5, ["BUFFER_OVERFLOW"]),
]
#: Vulnerability kinds (name, CWE, OWASP, severity).
VULNERABILITIES = [
    ("SQL_INJECTION", "SQL Injection", 89, "A03:2021", "Critical"), ("XSS", "Cross-Site Scripting", 79, "A03:2021", "High"), ("COMMAND_INJECTION", "Command Injection", 78, "A03:2021", "Critical"),
    ("PATH_TRAVERSAL", "Path Traversal", 22, "A01:2021", "High"), ("CODE_INJECTION", "Code Injection", 94, "A03:2021", "Critical"),
]


def catalog(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"catalog_ord int, {schema}")


def detect(nodes: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """Nodes of an entry's type whose text contains its name; the first entry of the catalog wins."""
    e = entries.withColumnRenamed("node_type", "_type")
    hit = nodes.join(e, (F.col("node_type") == F.col("_type")) & F.contains("text", "name"))
    w = Window.partitionBy(*key).orderBy("catalog_ord")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_type", "catalog_ord")


def build_edges(nodes: DataFrame) -> DataFrame:
    """Edges of a parsed file: parents to children (control), assignments and returns (data), calls.

    nodes: file_id, node_id, parent_id, sibling_idx, node_type.
    """
    p = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    both = nodes.where("parent_id is not null").join(p, ["file_id", "parent_id"])
    edge = lambda cond, a, b, t: both.where(cond).select("file_id", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("edge_type"))
    control = edge(F.lit(True), "parent_id", "node_id", "control_flow")
    assign = edge((F.col("parent_type") == "assignment") & (F.col("node_type") == "identifier"), "parent_id", "node_id", "data_flow")
    call = edge((F.col("parent_type") == "call_expression") & ~((F.col("node_type") == "identifier") & (F.col("sibling_idx") == 0)), "node_id", "parent_id", "call")
    ret = edge(F.col("parent_type") == "return_statement", "node_id", "parent_id", "return")
    return control.union(assign).union(call).union(ret)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops): every node reached from each start, itself included, with the fewest hops."""
    first = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct()
    step = lambda f: f.join(edges, f["node"] == edges["src"]).select("start", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
    return fixpoint(first, step, ["start", "node"])


def simple_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """All paths without repeated nodes from starts to targets, of at most `most` edges (default: of any length)."""
    paths = starts.select("node", F.array("node").alias("path"))
    out = None
    for _ in itertools.count() if most is None else range(most):
        paths = saved(paths.join(edges, paths["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "paths")
        hit = paths.join(targets.select("node"), "node", "left_semi")
        out = hit if out is None else out.unionByName(hit)
        if paths.isEmpty():
            break
    return out


def taint(edges: DataFrame, sources: DataFrame, sanitizers: DataFrame, graph: str | None = None) -> DataFrame:
    """One taint per (node, source): the shortest path; of these the surest, then the least path.

    edges(src, dst); sources(node, vulnerability_type, confidence, and source where it is not named by its node); sanitizers(node,
    effectiveness, vulnerability_types). Entering a sanitizer that protects the source's
    vulnerability multiplies the confidence by 1 - effectiveness; under 0.1 the taint ends.

    graph: a column of all three tables, such as a file or a user, that every edge stays inside of. Graphs of up to LOCAL edges
    are then walked each in one task, all in one pass grouped by it, and the result has `passed`, the sanitizers of the path. Larger
    graphs, and all where no column is named, go step by step over written tables.
    """
    if graph is None:
        return _stepped(edges, sources, sanitizers)
    sizes = edges.groupBy(F.col(graph).alias("_graph")).count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= LOCAL:
        return _walked(edges, sources, sanitizers, graph)
    large = saved(sizes.where(F.col("count") > LOCAL).select("_graph"), "large-graphs")
    part = lambda df, how: df.join(large, df[graph] == large["_graph"], how)
    near = _walked(*[part(x, "left_anti") for x in (edges, sources, sanitizers)], graph)
    far = _stepped(*[part(x, "left_semi") for x in (edges, sources, sanitizers)])
    return near.unionByName(far.withColumn("passed", F.col("path")))


#: Edges of a graph that one task walks.
LOCAL = 100_000


def _walked(edges: DataFrame, sources: DataFrame, sanitizers: DataFrame, graph: str) -> DataFrame:
    """Taints of graphs that fit a task. A node keeps its predecessor and its rank among the nodes of its step, by which equal
    paths are told apart; paths are read off from the predecessors at the end."""
    source = F.col("source" if "source" in sources.columns else "node").alias("source")
    kind, name = sources.select("node").schema["node"].dataType, sources.select(source).schema["source"].dataType
    fields = {"graph": edges.schema[graph].dataType, "kind": T.IntegerType(), "a": kind, "b": kind, "source": name, "vt": T.StringType(), "number": T.DoubleType(), "vts": T.ArrayType(T.StringType())}
    row = lambda df, given: df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
    facts = row(edges, {"graph": F.col(graph), "kind": F.lit(0), "a": F.col("src"), "b": F.col("dst")})
    facts = facts.unionByName(row(sanitizers, {"graph": F.col(graph), "kind": F.lit(1), "a": F.col("node"), "number": F.col("effectiveness"), "vts": F.col("vulnerability_types")}))
    facts = facts.unionByName(row(sources, {"graph": F.col(graph), "kind": F.lit(2), "a": F.col("node"), "source": source, "vt": F.col("vulnerability_type"), "number": F.col("confidence")}))
    out = T.StructType([T.StructField("node", kind), T.StructField("source", name), T.StructField("vulnerability_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("path", T.ArrayType(kind)), T.StructField("passed", T.ArrayType(kind))])
    arrow = [to_arrow_type(f.dataType) for f in out.fields]

    def walk(rows: list[tuple]) -> Iterator[tuple]:
        after, clean = defaultdict(list), defaultdict(list)
        starts = []
        for kind, a, b, source, vt, number, vts in rows:
            if kind == 0:
                after[a].append(b)
            elif kind == 1:
                clean[a].append((number, vts or ()))
            else:
                starts.append((a, source, vt, number))
        known = set()
        for first, source, vt, sure in starts:
            if (key := (first, repr(source))) in known or first is None:
                continue  # of equal sources one
            known.add(key)
            left = {n: 1 - least for n, cs in clean.items() if (least := min((e for e, vts in cs if vt in vts), default=None)) is not None}
            at, front = {first: (sure, None)}, [first]
            yield first, source, vt, sure, [first], [first] if first in clean else []
            paths = {first: ([first], [first] if first in clean else [])}
            while front:
                best: dict = {}
                for rank, n in enumerate(front):  # in the order of their paths
                    for m in after.get(n, ()):
                        if m in at or m is None:
                            continue
                        c = at[n][0] * left.get(m, 1.0)
                        if c >= 0.1 and (m not in best or (-c, rank) < best[m][0]):
                            best[m] = ((-c, rank), c, n)
                front = sorted(best, key=lambda m: (best[m][0][1], m))
                for m in front:
                    _, c, n = best[m]
                    at[m] = (c, n)
                    path, passed = paths[n]
                    paths[m] = ([*path, m], [*passed, m] if m in clean else passed)
                    yield m, source, vt, c, *paths[m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow)], out.names)

        now, rows, found = None, None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows is None or g != now:
                    for x in walk(rows or []):
                        found.append(x)
                        if len(found) >= 4096:
                            yield pack(found)
                            found = []
                    now, rows = g, []
                rows.append(row)
        for x in walk(rows or []):
            found.append(x)
            if len(found) >= 4096:
                yield pack(found)
                found = []
        yield pack(found)

    return facts.repartition("graph").sortWithinPartitions("graph").mapInArrow(run, out)


def _stepped(edges: DataFrame, sources: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Taints of any graph: each step joins the newest ones with the edges and appends what is new."""
    clean = sanitizers.groupBy(F.col("node").alias("dst")).agg(F.collect_list(F.struct("effectiveness", "vulnerability_types")).alias("clean"))
    edges = saved(edges.select("src", "dst").join(clean, "dst", "left"), "edges")
    source = F.col("source" if "source" in sources.columns else "node").alias("source")
    start = sources.select("node", source, "vulnerability_type", F.col("confidence").cast("double").alias("confidence"), F.array("node").alias("path"))

    def step(f: DataFrame) -> DataFrame:
        # of several sanitizers of a node the weakest counts, as the surest taint is kept
        least = F.array_min(F.transform(F.filter("clean", lambda c: F.array_contains(c["vulnerability_types"], F.col("vulnerability_type"))), lambda c: c["effectiveness"]))
        moved = f.join(edges, f["node"] == edges["src"]).withColumn("confidence", F.col("confidence") * (1 - F.coalesce(least, F.lit(0.0)))).where("confidence >= 0.1")
        moved = moved.select(F.col("dst").alias("node"), "source", "vulnerability_type", "confidence", F.concat("path", F.array("dst")).alias("path"))
        best = F.min_by(F.struct("confidence", "path", "vulnerability_type"), F.struct(F.size("path"), -F.col("confidence"), F.col("path"))).alias("b")
        return moved.groupBy("node", "source").agg(best).select("node", "source", "b.vulnerability_type", "b.confidence", "b.path")

    return fixpoint(start, step, ["node", "source"])


def flows(taints: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Taints that end in sinks: sure enough (> 0.5) before and after the path's sanitizers of the sink's vulnerability."""
    hit = taints.drop("vulnerability_type").where("confidence > 0.5 and size(path) > 1").join(sinks.select("node", "vulnerability_type"), "node")
    on_path = hit.select("node", "source", "vulnerability_type", F.explode("passed" if "passed" in hit.columns else "path").alias("_p"))
    s = sanitizers.select(F.col("node").alias("_p"), "effectiveness", "vulnerability_types")
    used = on_path.join(s, "_p").where(F.array_contains("vulnerability_types", F.col("vulnerability_type"))).groupBy("node", "source", "vulnerability_type").agg(F.sort_array(F.collect_set(F.struct("_p", "effectiveness"))).alias("u"))
    out = hit.join(used, ["node", "source", "vulnerability_type"], "left")
    left = F.aggregate(F.coalesce(F.col("u.effectiveness"), F.array().cast("array<double>")), F.col("confidence"), lambda a, e: a * (1 - e))
    protected = F.exists(F.coalesce(F.col("u.effectiveness"), F.array().cast("array<double>")), lambda e: e > 0.8)
    return out.select("source", F.col("node").alias("sink"), "vulnerability_type", "path", left.alias("confidence"), ((left > 0.5) & ~protected).alias("vulnerable")).where("confidence > 0.5")


def enhanced_step(confidence: Column, length: Column) -> Column:
    """Integer confidence of 0 to 100 after a hop: times 1 - min(0.05 * length, 0.3), cut down to an integer."""
    return F.floor(confidence * (1 - F.least(0.05 * length, F.lit(0.3)))).cast("int")


def tour(parents: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(<id_col>, root, enter, leave) of a forest: a node holds another of its root if enter is greater and leave is less.

    The walk around each tree is a linked list of entering and leaving its nodes; how far each step is from the end is worked out by
    pointer doubling, so a tree of n nodes takes log2(2n) rounds, however deep it is. A node on a cycle has no root and is left out.
    """
    n = parents.select(F.col(id_col).alias("v"), F.col(parent_col).alias("p")).dropDuplicates(["v"])
    known = n.select(F.col("v").alias("p")).withColumn("_in", F.lit(True))
    n = saved(n.join(known, "p", "left").select("v", F.when(F.col("_in"), F.col("p")).alias("p")), "tree")  # a parent outside the table is none
    beside = n.withColumn("after", F.lead("v").over(Window.partitionBy("p").orderBy("v")))
    first = n.where("p is not null").groupBy(F.col("p").alias("v")).agg(F.min("v").alias("child"))
    step = lambda v, down: F.struct(v.alias("v"), F.lit(down).alias("down"))
    enter = n.join(first, "v", "left").select(step(F.col("v"), True).alias("at"), F.when(F.col("child").isNotNull(), step(F.col("child"), True)).otherwise(step(F.col("v"), False)).alias("next"))
    leave = beside.select(step(F.col("v"), False).alias("at"), F.when(F.col("p").isNull(), F.lit(None)).when(F.col("after").isNotNull(), step(F.col("after"), True)).otherwise(step(F.col("p"), False)).alias("next"))
    here = saved(enter.unionByName(leave).withColumns({"far": F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"), "last": F.col("at")}), "tour")
    for _ in range(64):
        if here.where("next is not null").isEmpty():
            break
        # a cycle never comes to an end: after as many doublings as there are bits it is left out
        ahead = here.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"), F.col("last").alias("_last"))
        done = here.where("next is null")
        moved = here.where("next is not null").join(ahead, "next").select("at", F.col("_next").alias("next"), (F.col("far") + F.col("_far")).alias("far"), F.col("_last").alias("last"))
        here = saved(done.unionByName(moved), "tour")
    ends = here.where("next is null").groupBy(F.col("at.v").alias(id_col)).agg(F.max(F.when(F.col("at.down"), F.col("far"))).alias("enter"), F.max(F.when(~F.col("at.down"), F.col("far"))).alias("leave"), F.first("last.v").alias("root"))
    return ends.select(id_col, "root", "enter", "leave")


def resolve_scopes(uses: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses(use_id, scope_id, name) with the symbol of the innermost enclosing scope that defines the name (null: none).

    Scopes become intervals of a walk around their tree (see tour); for each tree and name, definitions and uses are then sorted
    together and one sweep keeps the open definitions as a stack. Of several definitions of one scope the least node's counts.
    """
    at = saved(tour(scopes, "scope_id", "parent_id"), "scopes")
    kind = symbols.schema["node_id"].dataType
    keys = ["root", "name"]
    defined = symbols.groupBy("scope_id", "name").agg(F.min("node_id").alias("node_id")).join(at, "scope_id").select(*keys, "enter", "leave", F.lit(0).alias("kind"), "node_id", F.lit(None).cast(uses.schema["use_id"].dataType).alias("use_id"))
    asked = uses.join(at, "scope_id").select(*keys, "enter", "leave", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("node_id"), "use_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            users, found = [], []
            nodes = batch.column(5).to_pylist()
            for i, (root, name, _, leave, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (root, name) != now:
                    now, open_ = (root, name), []
                while open_ and open_[-1][0] > leave:  # it was left before this scope is
                    open_.pop()
                if k == 0:
                    open_.append((leave, nodes[i]))
                elif open_:
                    users.append(i)
                    found.append(open_[-1][1])
            yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(users, pa.int64())), pa.array(found, to_arrow_type(kind))], ["use_id", "node_id"])

    rows = defined.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, F.desc("enter"), "kind")
    hit = rows.mapInArrow(sweep, T.StructType([T.StructField("use_id", uses.schema["use_id"].dataType), T.StructField("node_id", kind)]))
    return uses.join(hit, "use_id", "left")


def propagate_constants(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(node, value) along edges from nodes of known value; the nearest definition wins, then the least value."""
    def step(f: DataFrame) -> DataFrame:
        return f.join(edges, f["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("value"))

    return fixpoint(known.select("node", "value"), step, ["node"])


def zip_arguments(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments with the parameters of the function of the same name, arity and language; further arguments are cut off."""
    f = functions.select("name", "param_count", "language", "parameters")
    both = calls.withColumn("param_count", F.size("arguments")).join(f, ["name", "param_count", "language"])
    pairs = F.arrays_zip(F.slice("arguments", 1, F.size("parameters")).alias("argument"), F.col("parameters").alias("parameter"))
    return both.select("call_id", "name", F.posexplode(pairs).alias("position", "p")).select("call_id", "name", "position", "p.argument", "p.parameter")


def flow_severity(source_level: Column, sink_level: Column, vulnerable: Column) -> Column:
    """High meets Critical: Critical; High meets High or Medium meets Critical: High; Medium meets High: Medium; else Low; no vulnerability: Info."""
    both = lambda a, b: (source_level == a) & (sink_level == b)
    return F.when(~vulnerable, "Info").when(both("High", "Critical"), "Critical").when(both("High", "High") | both("Medium", "Critical"), "High").when(both("Medium", "High"), "Medium").otherwise("Low")


def describe_flows(flow: DataFrame, spark: SparkSession) -> DataFrame:
    """Flows with their vulnerability's name, CWE, OWASP class and severity; unknown kinds: Unknown, safe flows: Sanitized."""
    dim = catalog(spark, VULNERABILITIES, "vulnerability_type string, vulnerability string, cwe int, owasp string, severity string").drop("catalog_ord")
    out = flow.join(F.broadcast(dim), "vulnerability_type", "left")
    return out.withColumn("category", F.when(~F.col("vulnerable"), "Sanitized").otherwise(F.coalesce("vulnerability", F.lit("Unknown"))))


def enhanced_taint(edges: DataFrame, sources: DataFrame, least: int = 30) -> DataFrame:
    """(node, source, confidence 0 to 100) over edges of all kinds; a hop lowers the confidence by the path's length, in integers."""
    start = sources.select("node", F.col("node").alias("source"), F.col("confidence").cast("int").alias("confidence"), F.lit(1).alias("length"))

    def step(f: DataFrame) -> DataFrame:
        moved = f.join(edges, f["node"] == edges["src"]).select(F.col("dst").alias("node"), "source", enhanced_step(F.col("confidence"), F.col("length")).alias("confidence"), (F.col("length") + 1).alias("length"))
        best = F.max_by(F.struct("confidence", "length"), F.struct("confidence", -F.col("length"))).alias("b")
        return moved.where(F.col("confidence") > least).groupBy("node", "source").agg(best).select("node", "source", "b.*")

    return fixpoint(start, step, ["node", "source"])


def interprocedural(calls: DataFrame, taints: DataFrame) -> DataFrame:
    """(function, source, confidence): taints carried from callers to callees, times 0.9 a call; calls(caller, callee)."""
    start = taints.select("function", "source", F.col("confidence").cast("double").alias("confidence"))

    def step(f: DataFrame) -> DataFrame:
        moved = f.join(calls, f["function"] == calls["caller"]).select(F.col("callee").alias("function"), "source", (F.col("confidence") * 0.9).alias("confidence"))
        return moved.groupBy("function", "source").agg(F.max("confidence").alias("confidence"))

    return fixpoint(start, step, ["function", "source"])


def shortest_call_path(calls: DataFrame, start: DataFrame) -> DataFrame:
    """(function, path) of a shortest chain of calls from any start function; of equals the least path."""
    first = start.select("function", F.array("function").alias("path"))

    def step(f: DataFrame) -> DataFrame:
        moved = f.join(calls, f["function"] == calls["caller"]).select(F.col("callee").alias("function"), F.concat("path", F.array("callee")).alias("path"))
        return moved.groupBy("function").agg(F.min("path").alias("path"))

    return fixpoint(first, step, ["function"])


def branches(taints: DataFrame) -> DataFrame:
    """Each taint once for either branch of a condition."""
    return taints.withColumn("branch", F.explode(F.array(F.lit(True), F.lit(False))))
