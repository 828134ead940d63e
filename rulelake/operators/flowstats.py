"""Figures over flows, graphs, jobs and rule shelves: one aggregation each, no collected lists unless the list is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories of flows from the most severe; the first four are vulnerable.
CATEGORIES = ("Critical", "High", "Medium", "Low", "Info", "Sanitized", "Unknown")
#: Severity of where data comes from and of where it goes.
SOURCE_SEVERITY = {
    "UserInput": "High", "UrlParameterInput": "High", "HeaderInput": "High", "NetworkInput": "High", "ExternalApiInput": "High", "CookieInput": "High",
    "FileInput": "Medium", "DatabaseInput": "Medium", "EnvironmentInput": "Low", "CommandLineInput": "Low",
}
SINK_SEVERITY = {
    "SqlExecution": "Critical", "CommandExecution": "Critical", "JavaScriptEvaluation": "Critical", "FileOperation": "High", "XmlOperation": "High", "LdapOperation": "High",
    "NetworkOperation": "Medium", "HtmlOutput": "Medium", "DatabaseOperation": "Medium", "LogOutput": "Low",
}
#: The vulnerability that a kind of sink stands for.
SINK_VULNERABILITY = {
    "SqlExecution": "SQL_INJECTION", "CommandExecution": "COMMAND_INJECTION", "FileOperation": "PATH_TRAVERSAL", "NetworkOperation": "SSRF", "HtmlOutput": "XSS",
    "JavaScriptEvaluation": "CODE_INJECTION", "LogOutput": "LOG_INJECTION", "DatabaseOperation": "SQL_INJECTION", "XmlOperation": "XML_INJECTION", "LdapOperation": "LDAP_INJECTION",
}


def _mapped(kind: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind]


def source_severity(kind: Column) -> Column:
    return _mapped(kind, SOURCE_SEVERITY)


def sink_severity(kind: Column) -> Column:
    return _mapped(kind, SINK_SEVERITY)


def sink_vulnerability(kind: Column) -> Column:
    return _mapped(kind, SINK_VULNERABILITY)


def flow_statistics(flows: DataFrame, category: str = "category") -> DataFrame:
    """One row: a count of each category, all and vulnerable flows, their rates (0 where there are none), and the highest severity (null: none)."""
    n = {c: F.count_if(F.col(category) == c).alias(f"{c.lower()}_count") for c in CATEGORIES}
    one = flows.agg(*n.values())
    total = sum((F.col(f"{c.lower()}_count") for c in CATEGORIES[1:]), F.col("critical_count"))
    bad = sum((F.col(f"{c.lower()}_count") for c in CATEGORIES[1:4]), F.col("critical_count"))
    rate = lambda x: F.when(total == 0, 0.0).otherwise(x / total)
    highest = F.coalesce(*[F.when(F.col(f"{c.lower()}_count") > 0, c) for c in CATEGORIES[:5]])
    return one.withColumns({"total_flows": total, "vulnerable_flows": bad, "vulnerability_rate": rate(bad), "sanitization_rate": rate(F.col("sanitized_count")), "highest_severity": highest})


def flows_by_category(flows: DataFrame, columns: list[str], category: str = "category") -> DataFrame:
    """Flows listed by category and then by the given columns: rows in order, so that no task holds a whole category."""
    return flows.select(category, *columns).orderBy(category, *columns)


def vulnerable_flows(flows: DataFrame, order: list[str], category: str = "category") -> DataFrame:
    """Flows of the four vulnerable categories, the most severe first."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES[:4])), F.col(category))
    return flows.where(F.col(category).isin(*CATEGORIES[:4])).withColumn("severity_rank", rank.cast("int")).orderBy("severity_rank", *order)


def vulnerability_types(flows: DataFrame) -> DataFrame:
    return flows.select("vulnerability_type").distinct()


def by_confidence(flows: DataFrame, tie: list[str]) -> DataFrame:
    """Flows, the surest first; ties by the given columns."""
    return flows.orderBy(F.desc("confidence"), *tie)


def max_confidence(taints: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest confidence of each key; 0 where all are null."""
    return taints.groupBy(*keys).agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"))


def dataflow_statistics(nodes: DataFrame, edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, flows: DataFrame) -> DataFrame:
    """One row of counts: nodes, edges, sources, sinks, sanitizers, flows and vulnerable flows."""
    tables = {"node": nodes, "edge": edges, "source": sources, "sink": sinks, "sanitizer": sanitizers}
    one = flows.agg(F.count(F.lit(1)).alias("flow_count"), F.count_if("vulnerable").alias("vulnerable_flow_count"))
    for name, t in tables.items():
        one = one.join(t.agg(F.count(F.lit(1)).alias(f"{name}_count")))  # one row beside one row
    return one.select(*[f"{n}_count" for n in tables], "flow_count", "vulnerable_flow_count")


def valid_paths(paths: DataFrame, edges: DataFrame, key: str = "path_id", column: str = "path") -> DataFrame:
    """Paths of at least two nodes of which every hop is an edge(src, dst)."""
    hops = paths.where(F.size(column) >= 2).select(key, F.explode(F.arrays_zip(F.slice(column, F.lit(1), F.size(column) - 1).alias("src"), F.slice(column, F.lit(2), F.size(column) - 1).alias("dst"))).alias("h")).select(key, "h.src", "h.dst")
    broken = hops.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(key).distinct()
    return paths.where(F.size(column) >= 2).join(broken, key, "left_anti")


def matching_flows(flows: DataFrame, sources: list[str], sinks: list[str]) -> DataFrame:
    """Vulnerable flows whose source description contains a source of a rule and whose sink description one of its sinks."""
    any_of = lambda c, words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(c, x))
    return flows.where(F.col("vulnerable") & any_of(F.col("source_description"), sources) & any_of(F.col("sink_description"), sinks))


def job_rates(jobs: DataFrame, keys: list[str] = (), status: str = "status", findings: str = "findings") -> DataFrame:
    """Analyses, findings, completed and failed jobs, the share of completed among those in percent and the findings an analysis (0 where undefined)."""
    done, failed = F.count_if(F.col(status) == "completed"), F.count_if(F.col(status) == "failed")
    n, found = F.count(F.lit(1)), F.coalesce(F.sum(findings), F.lit(0))
    rate = F.when(done + failed > 0, done / (done + failed) * 100).otherwise(0.0)
    mean = F.when(n > 0, found / n).otherwise(0.0)
    return jobs.groupBy(*keys).agg(n.alias("analyses"), found.alias("findings"), done.alias("completed"), failed.alias("failed"), rate.alias("success_rate"), mean.alias("findings_per_analysis"))


def top_operations(timings: DataFrame, by: str = "total", most: int = 10) -> DataFrame:
    """The operations of the greatest total time (or of the most calls): a report of `most` rows."""
    one = timings.groupBy("operation").agg(F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("calls"))
    return one.orderBy(F.desc(by), "operation").limit(most)


def rule_statistics(runs: DataFrame, rule: str = "rule_id") -> DataFrame:
    """Per rule: runs, those that failed, findings in all, seconds in all and a run, and the last run's status by number."""
    n = F.count(F.lit(1))
    return runs.groupBy(rule).agg(n.alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"), F.max_by("status", "run").alias("last_status"))


def tag_index(rules: DataFrame) -> DataFrame:
    """Per tag: how many rules bear it, and the first of them."""
    return rules.select("rule_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("first_rule"))


def mean_rating(ratings: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Mean and number of ratings; those outside the scale count for the number alone."""
    return ratings.groupBy(*keys).agg(F.avg(F.when(F.col("rating").between(low, high), F.col("rating"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def shelf_keys(rules: DataFrame) -> DataFrame:
    """(kind, name): distinct categories and tags of rules(rule_id, category, tags)."""
    return rules.select(F.lit("category").alias("kind"), F.col("category").alias("name")).union(rules.select(F.lit("tag"), F.explode("tags"))).distinct()


def without_rules(rules: DataFrame, removed: DataFrame) -> DataFrame:
    """Rules but for those of the removed ids; categories and tags of theirs stay known through shelf_keys of the former state."""
    return rules.join(removed.select("rule_id").distinct(), "rule_id", "left_anti")


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100, most: int = 500) -> DataFrame:
    """A page of rows in an explicit order; a page has at most `most` rows whatever is asked for."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def page_meta(total: int, offset: int, limit: int) -> dict:
    """What a listing says of its page."""
    return {"page": offset // limit + 1, "per_page": limit, "total": total, "total_pages": -(-total // limit), "has_next": offset + limit < total, "has_prev": offset > 0}


def neighbours(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(node, neighbour, direction, edge_type) of the given nodes: successors and predecessors, of one type or all."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out = nodes.join(e, F.col("node") == F.col("src")).select("node", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"), "edge_type")
    into = nodes.join(e, F.col("node") == F.col("dst")).select("node", F.col("src").alias("neighbour"), F.lit("in").alias("direction"), "edge_type")
    return out.union(into)


def definitions(defs: DataFrame) -> DataFrame:
    """The last definition of each (scope, name), by its node number."""
    return defs.groupBy("scope", "name").agg(F.max("node").alias("node"))


def def_use_paths(defs: DataFrame, uses: DataFrame, paths: DataFrame) -> DataFrame:
    """(scope, name, path): for each symbol, the shortest path from its last definition to each of its uses, uses in order, joined into one.

    paths(src, dst, path); of equally short ones the least; a use without a path adds nothing.
    """
    d = definitions(defs).withColumnRenamed("node", "src")
    first = paths.groupBy("src", "dst").agg(F.min_by("path", F.struct(F.size("path"), F.col("path"))).alias("path"))
    hit = uses.select("scope", "name", F.col("node").alias("dst")).join(d, ["scope", "name"]).join(first, ["src", "dst"])
    return hit.groupBy("scope", "name").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("dst", "path"))), lambda x: x["path"])).alias("path"))


def function_taints(taints: DataFrame, at: str) -> DataFrame:
    """The sorted taints registered at a function's entry or exit."""
    return taints.where(F.col("at") == at).groupBy("function").agg(F.sort_array(F.collect_set("source")).alias("taints"))


def constants_of(constants: DataFrame) -> DataFrame:
    """Per name: whether it is constant (one value and never marked mutable), its last value, and whether it is sensitive."""
    from ..functions.text import sensitive

    last = F.max_by(F.struct("value", "mutable"), "ord")
    one = constants.groupBy("name").agg(last.alias("l"))
    return one.select("name", F.col("l.value").alias("value"), (~F.col("l.mutable")).alias("is_constant"), sensitive(F.col("name"), F.col("l.value")).alias("is_sensitive"))


def drop_repeats(results: DataFrame, keys: list[str], order: list, column: str) -> DataFrame:
    """Results in order without those whose column equals that of the one just before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(column).over(w)
    return results.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(column))).drop("_b")
