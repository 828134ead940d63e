"""Findings as reports: JSON, SARIF, text, Markdown, HTML, editor diagnostics, metrics, and stored jobs.

A report's lines are rows (section, at, line): a section's lines are in the order of `at`. Lines are made where the
findings are; write_report() writes them in order, a range of lines a task, so no task or driver holds a whole report.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import saved

#: SARIF levels and editor numbers of severities.
SARIF_LEVELS = {"critical": "error", "error": "error", "warning": "warning", "info": "note"}
EDITOR = {"error": 1, "warning": 2, "info": 3, "hint": 4}


def mapped(column: Column, table: dict, other) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column], F.lit(other))


def sarif_json(raw_levels: bool = False) -> Column:
    level = F.col("severity") if raw_levels else mapped(F.col("severity"), SARIF_LEVELS, "warning")
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))


def sarif_results(findings: DataFrame, raw_levels: bool = False) -> DataFrame:
    """One SARIF 2.1.0 result a row, as JSON; raw_levels keeps the severity's own name."""
    return findings.select("rule_id", sarif_json(raw_levels).alias("result"))


def sarif_lines(findings: DataFrame, tool: str = "rulelake", version: str = "1.0") -> DataFrame:
    """A whole SARIF 2.1.0 document as lines: the run's envelope around one result a line."""
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": tool, "version": version}) + '}, "results": ['
    return _document(findings, head, "]}]}", sarif_json())


def json_lines(findings: DataFrame, files: int, rules: int, milliseconds: int = 0, statistics: dict | None = None) -> DataFrame:
    """A whole JSON report as lines: findings, then a summary that counts them, then statistics where given."""
    count = findings.agg(F.count(F.lit(1)).alias("n"))
    more = "" if statistics is None else ', "statistics": ' + json.dumps(statistics)
    tail = F.concat(F.lit('], "summary": {"total_findings": '), F.col("n").cast("string"), F.lit(f', "files_analyzed": {files}, "rules_executed": {rules}, "analysis_time_ms": {milliseconds}}}{more}}}'))
    body = _document(findings, '{"findings": [', None, finding_json())
    return body.unionByName(count.select(F.lit(2).alias("section"), F.struct(F.lit("").alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("start_column"), F.lit("").alias("rule_id"), F.lit(0).alias("n")).alias("at"), tail.alias("line")))


#: Columns that order a report's findings.
PLACE = ("path", "start_line", "start_column", "rule_id")


def _at(n=0):
    return F.struct(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("start_column", F.lit(0)).alias("start_column"), F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.lit(n).alias("n"))


def _fixed_lines(spark, section: int, lines: list[str]) -> DataFrame:
    rows = [(section, ("", 0, 0, "", i), x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "section int, at struct<path: string, start_line: int, start_column: int, rule_id: string, n: int>, line string")


def _document(findings: DataFrame, head: str, tail: str | None, value: Column) -> DataFrame:
    """JSON values as lines between a head and a tail: every value but the first of the order has a comma before it."""
    both = findings.select(_at().alias("at"), value.alias("line"))
    first = both.agg(F.min(F.struct("at", "line")).alias("m"))
    body = both.join(F.broadcast(first)).select(  # one row
        F.lit(1).alias("section"), "at", F.when(F.struct("at", "line") == F.col("m"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("line"))
    out = _fixed_lines(findings.sparkSession, 0, [head]).unionByName(body)
    return out if tail is None else out.unionByName(_fixed_lines(findings.sparkSession, 2, [tail]))


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report as text files whose names are in the report's order."""
    lines.orderBy("section", "at", "line").select("line").write.text(path)


def finding_json() -> Column:
    place = F.struct(F.col("path").alias("file"), "start_line", "start_column", "end_line", "end_column").alias("location")
    return F.to_json(F.struct("rule_id", "message", "severity", "confidence", place))


def json_findings(findings: DataFrame) -> DataFrame:
    return findings.select(finding_json().alias("finding"))


def _one_row(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("blocking"))


def _numbered(findings: DataFrame) -> DataFrame:
    """Findings with `number`, from 1 in the report's order: ranks inside ranges of the order, and the ranges' counts before them."""
    parts = findings.repartitionByRange(*PLACE).withColumn("_part", F.spark_partition_id())
    held = saved(parts, "report-order")
    before = held.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*PLACE, "message"))
    return held.withColumn("_rank", rank).join(before, "_part").withColumn("number", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def text_report(findings: DataFrame, files: int, rules: int, seconds: float = 0.0) -> DataFrame:
    """Numbered findings with place, severity, confidence and fix, and a summary."""
    spark = findings.sparkSession
    parts = [F.format_string("%d. %s (%s)", "number", "message", "rule_id"), F.format_string("   File: %s:%d:%d", "path", "start_line", "start_column"), F.format_string("   Severity: %s, Confidence: %s", F.initcap("severity"), F.initcap("confidence")), F.concat(F.lit("   Fix: "), F.col("fix")), F.lit("")]
    body = _numbered(findings).select(F.lit(2).alias("section"), *PLACE, F.posexplode(F.array_compact(F.array(*parts))).alias("n", "line")).select("section", F.struct(*PLACE, "n").alias("at"), "line")
    head = _one_row(findings).select(F.lit(1).alias("section"), _blank(), F.explode(F.when(F.col("n") == 0, F.array(F.lit("No issues found!"), F.lit(""))).otherwise(F.array(F.format_string("Found %d issue(s):", "n"), F.lit("")))).alias("line"))
    top, end = _fixed_lines(spark, 0, ["=== Analysis Results ===", ""]), _fixed_lines(spark, 3, ["=== Summary ===", f"Files analyzed: {files}", f"Rules executed: {rules}", f"Analysis time: {seconds:.3f}s"])
    return top.unionByName(head).unionByName(body).unionByName(end)


def _blank() -> Column:
    return F.struct(F.lit("").alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("start_column"), F.lit("").alias("rule_id"), F.lit(0).alias("n")).alias("at")


def grouped_report(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, rule_id, lines): a block for each file and rule with its message and its source lines in order, a rule between them.

    sources(path, start_line, line) holds the files' lines; a missing one reads <source unavailable>.
    """
    named = findings.join(sources.select("path", "start_line", F.trim("line").alias("line")), ["path", "start_line"], "left")
    row = F.struct("start_line", "start_column", "message", F.coalesce("line", F.lit("<source unavailable>")).alias("line"))
    one = named.groupBy("path", "rule_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(F.lit("           "), x["start_line"].cast("string"), F.lit("┆ "), x["line"])), "\n            ⋮┆" + "-" * 40 + "\n")
    block = F.concat(F.lit("   ❯❯❱ "), F.col("rule_id"), F.lit("\n          "), F.trim(F.get("l", 0)["message"]), F.lit("\n\n"), lines)
    return one.select("path", "rule_id", block.alias("lines"))


def scan_summary(findings: DataFrame, files: int, rules: int) -> DataFrame:
    """One row of lines that end a grouped report; errors alone are blocking."""
    s = lambda n: F.when(n == 1, "").otherwise("s")
    n = F.col("n")
    last = F.concat(F.lit(f"Ran {rules} rule{'' if rules == 1 else 's'} on {files} file{'' if files == 1 else 's'}: "), n.cast("string"), F.lit(" finding"), s(n), F.lit("."))
    return _one_row(findings).select(F.array(F.format_string(" • Findings: %d (%d blocking)", "n", "blocking"), F.lit(f" • Rules run: {rules}"), F.lit(f" • Targets scanned: {files}"), last).alias("lines"))


def html_rows(findings: DataFrame) -> DataFrame:
    """A <div> for each finding, its texts escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.when(F.col("severity").isin("critical", "error"), "error").otherwise(F.col("severity"))
    p = lambda name, value: F.concat(F.lit(f"<p><strong>{name}:</strong> "), value, F.lit("</p>"))
    place = F.format_string("%s:%d:%d", safe("path"), "start_line", "start_column")
    fix = F.when(F.col("fix").isNotNull(), p("Fix", safe("fix"))).otherwise("")
    return findings.select(*PLACE, F.concat(F.lit('<div class="finding '), kind, F.lit('"><h3>'), safe("message"), F.lit("</h3>"), p("Rule", safe("rule_id")), p("File", place), p("Severity", F.initcap("severity")), p("Confidence", F.initcap("confidence")), fix, F.lit("</div>")).alias("html"))


def html_report(findings: DataFrame, files: int) -> DataFrame:
    spark = findings.sparkSession
    head = ["<!DOCTYPE html>", "<html><head><title>Analysis Report</title></head><body>", "<h1>Analysis Report</h1>", "<h2>Summary</h2>"]
    count = _one_row(findings).select(F.lit(1).alias("section"), _blank(), F.concat(F.lit("<p>Total findings: "), F.col("n").cast("string"), F.lit(f"</p><p>Files analyzed: {files}</p>")).alias("line"))
    body = html_rows(findings).select(F.lit(2).alias("section"), _at().alias("at"), F.col("html").alias("line"))
    return _fixed_lines(spark, 0, head).unionByName(count).unionByName(body).unionByName(_fixed_lines(spark, 3, ["</body></html>"]))


def markdown_report(findings: DataFrame, files: int) -> DataFrame:
    spark = findings.sparkSession
    count = _one_row(findings).select(F.lit(1).alias("section"), _blank(), F.explode(F.array(F.format_string("- **Total findings:** %d", "n"), F.lit(f"- **Files analyzed:** {files}"), F.lit(""), F.lit("| severity | rule | file | line | message |"), F.lit("|-|-|-|-|-|"))).alias("line"))
    count = count.withColumn("at", F.struct("at.path", "at.start_line", "at.start_column", "at.rule_id", F.when(F.startswith("line", F.lit("- **T")), 0).when(F.startswith("line", F.lit("- **F")), 1).when(F.col("line") == "", 2).when(F.contains("line", F.lit("severity")), 3).otherwise(4).alias("n")))
    body = findings.select(F.lit(2).alias("section"), _at().alias("at"), _markdown_row().alias("line"))
    return _fixed_lines(spark, 0, ["# Analysis Report", "", "## Summary", ""]).unionByName(count).unionByName(body)


def report(findings: DataFrame, how: str, files: int, rules: int) -> DataFrame:
    """Lines of a report by name: json, sarif, html, markdown; any other name is text, as for xml and yaml."""
    if how == "json":
        return json_lines(findings, files, rules)
    if how == "sarif":
        return sarif_lines(findings)
    if how == "html":
        return html_report(findings, files)
    if how == "markdown":
        return markdown_report(findings, files)
    return text_report(findings, files, rules)


def write_table(findings: DataFrame, how: str, path: str) -> None:
    """Findings as rows: csv, json lines, parquet or orc, by Spark's own writers."""
    flat = findings.drop("bindings", "metadata")
    (flat.write.option("header", "true") if how == "csv" else flat.write).format(how).save(path)


def rule_listing(rules: DataFrame, how: str = "table") -> DataFrame:
    """A line for each rule of rules_frame(): table, json or markdown."""
    languages = F.concat_ws(", ", "languages")
    if how == "json":
        line = F.to_json(F.struct(F.col("rule_id").alias("id"), "name", "severity", "confidence", "languages", "enabled"))
    elif how == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", "rule_id", "name", "severity", languages), F.lit(" |"))
    else:
        line = F.concat_ws("  ", F.rpad("rule_id", 30, " "), F.rpad("severity", 8, " "), F.rpad(languages, 20, " "), "name")
    return rules.select("rule_id", line.alias("line"))


def store_results(findings: DataFrame, job_id: str, path: str) -> None:
    """Append a job's findings to a table of all jobs' results, a directory a job."""
    findings.drop("bindings", "metadata").withColumn("job_id", F.lit(job_id)).write.mode("append").partitionBy("job_id").parquet(path)


def store_jobs(jobs: DataFrame, path: str) -> None:
    """Append rows (job_id, status, created_at, ..) to the job table; the last row of a job is its state."""
    jobs.write.mode("append").parquet(path)


def read_jobs(spark, path: str, status: str | None = None) -> DataFrame:
    """Each job's last state."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("job_id", "created_at")]
    last = rows.groupBy("job_id").agg(F.max(F.struct("created_at", *rest)).alias("l")).select("job_id", "l.*")
    return last if status is None else last.where(F.col("status") == status)


def text_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("%s:%d:%d: %s [%s] %s", "path", "start_line", "start_column", "severity", "rule_id", "message").alias("line"))


def _markdown_row() -> Column:
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("severity", "rule_id", "path", "start_line", "message")]), F.lit(" |"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    return findings.select(_markdown_row().alias("row"))


def diagnostics(findings: DataFrame) -> DataFrame:
    return findings.select("path", F.to_json(F.struct((F.col("start_line") - 1).alias("line"), mapped(F.col("severity"), EDITOR, 3).alias("severity"), F.col("rule_id").alias("code"), "message")).alias("diagnostic"))


def prometheus(counts: DataFrame, name: str = "findings_total", label: str = "severity", value: str = "n") -> DataFrame:
    """(label, value) rows as text exposition lines of one metric."""
    return counts.select(F.format_string(f'{name}{{{label}="%s"}} %s', label, F.col(value).cast("string")).alias("line"))


def prometheus_all(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines of all metrics: jobs by status, findings by severity and by rule."""
    by = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return prometheus(by(jobs, "status"), "jobs_total", "status").union(prometheus(by(findings, "severity"))).union(prometheus(by(findings, "rule_id"), "rule_findings_total", "rule_id"))


def failed(findings: DataFrame) -> bool:
    """Whether any finding is left: the exit status of a run."""
    return not findings.isEmpty()
