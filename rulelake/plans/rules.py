"""Rules: YAML text -> validated Rule objects -> rows for the executors.

A pattern is a tree of PatternNode; leaves are token sequences or regular expressions. Bad
rules are set aside one by one with their errors (a file with one bad rule keeps the others).
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from ..operators.tokens import java_regex

SEVERITIES = {"info": 0, "warning": 1, "error": 2, "critical": 3}
CONFIDENCES = {"low": 0, "medium": 1, "high": 2}
#: Other names of severities.
SEVERITY_ALIASES = {"high": "error", "medium": "warning", "low": "info"}
#: Pattern keys of rule files and the tree's node kinds.
KEYS = {"pattern": "simple", "pattern-regex": "regex", "pattern-either": "either", "patterns": "all", "pattern-all": "all", "pattern-any": "either", "pattern-not": "not", "pattern-inside": "inside", "pattern-not-inside": "not-inside", "pattern-not-regex": "not-regex", "pattern-followed-by": "followed-by", "pattern-preceded-by": "preceded-by"}
CLAUSES = ("metavariable-regex", "metavariable-comparison", "metavariable-name", "metavariable-pattern", "metavariable-analysis", "focus-metavariable", "where", "custom-condition")


@dataclass
class PatternNode:
    kind: str
    text: str | None = None
    parts: list["PatternNode"] = field(default_factory=list)
    conditions: list[dict] = field(default_factory=list)


@dataclass
class Role:
    """An entry of a rule's sources, sinks or sanitizers: what it matches, the label a source gives, the labels it requires."""

    pattern: PatternNode
    label: str = "__SOURCE__"
    requires: tuple | None = None


@dataclass
class Rule:
    id: str
    message: str
    severity: str
    languages: list[str]
    pattern: PatternNode | None
    name: str = ""
    description: str = ""
    confidence: str = "medium"
    fix: str | None = None
    fix_regex: dict | None = None
    paths: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    dataflow: dict | None = None
    enabled: bool = True
    focus: str | None = None
    roles: dict[str, list[Role]] = field(default_factory=dict)


def _load(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def parse_pattern(key: str, value) -> PatternNode:
    """One pattern key with its value, nested lists and mappings included."""
    kind = KEYS[key]
    if isinstance(value, str):
        return PatternNode(kind if kind in ("simple", "regex", "not-regex") else kind, value if kind in ("simple", "regex", "not-regex") else None, [] if kind in ("simple", "regex", "not-regex") else [PatternNode("simple", value)])
    if isinstance(value, dict):
        return PatternNode(kind, None, [parse_entry(value)])
    parts, conditions = [], []
    for entry in value:
        node = parse_entry({"pattern": entry} if isinstance(entry, str) else entry)
        (parts if node.kind != "clause" else conditions).append(node)
    return PatternNode(kind, None, parts, [c for n in conditions for c in n.conditions])


def parse_entry(entry: dict) -> PatternNode:
    """A mapping of a pattern list: a pattern key, clauses, or both."""
    clauses = [{"kind": k, "spec": v} for k, v in entry.items() if k in CLAUSES]
    keys = [k for k in entry if k in KEYS]
    if not keys:
        if not clauses:
            raise ValueError(f"no pattern key in {sorted(entry)}")
        return PatternNode("clause", None, [], clauses)
    node = parse_pattern(keys[0], entry[keys[0]])
    node.conditions += clauses
    return node


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, sort_keys=True)


def parse_requires(text: str) -> tuple:
    """A boolean expression over labels (and, or, not, parentheses) as ("label", name), ("not", x), ("and", [..]) or ("or", [..])."""

    def read(e) -> tuple:
        if isinstance(e, ast.Name):
            return "label", e.id
        if isinstance(e, ast.Constant) and isinstance(e.value, bool):
            return "and" if e.value else "or", []
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            return "not", read(e.operand)
        if isinstance(e, ast.BoolOp):
            return "and" if isinstance(e.op, ast.And) else "or", [read(v) for v in e.values]
        raise ValueError(f"requires: {text!r} is no expression over labels")

    try:
        return read(ast.parse(str(text).strip(), mode="eval").body)
    except SyntaxError:
        raise ValueError(f"requires: {text!r} is no expression over labels") from None


def satisfied(expression: tuple | None, present) -> bool:
    """Whether a set of labels satisfies an expression; without one, whether it holds the label of sources that name none."""
    kind, value = expression or ("label", Role.label)
    if kind == "label":
        return value in present
    if kind == "not":
        return not satisfied(value, present)
    return (all if kind == "and" else any)(satisfied(x, present) for x in value)


def _negates(expression: tuple | None) -> bool:
    kind, value = expression or ("label", "")
    return kind == "not" or (kind != "label" and any(map(_negates, value)))


def parse_role(entry) -> Role:
    """An entry of sources, sinks or sanitizers: a text, or a mapping like that of a pattern list with label and requires."""
    if isinstance(entry, str):
        return Role(PatternNode("simple", entry))
    keys = {k: v for k, v in entry.items() if k in KEYS or k in CLAUSES}
    requires = entry.get("requires")
    return Role(parse_entry(keys), str(entry.get("label", Role.label)), None if requires is None else parse_requires(requires))


def parse_rule(raw: dict) -> Rule:
    top = {k: v for k, v in raw.items() if k in KEYS or k in CLAUSES}
    node = parse_entry(top) if any(k in KEYS for k in top) else None
    flow, roles = None, {}
    if raw.get("mode") == "taint" or "pattern-sources" in raw or "dataflow" in raw:
        spec = raw.get("dataflow", {})
        roles = {k: [parse_role(e) for e in raw.get(f"pattern-{k}", spec.get(k, [])) or []] for k in ("sources", "sinks", "sanitizers")}
        # a depth that the rule does not name bounds nothing
        flow = {k: [r.pattern.text for r in some if r.pattern.text is not None] for k, some in roles.items()}
        flow |= {"must_flow": bool(spec.get("must_flow", True)), "max_depth": int(spec.get("max_depth", 50)), "bounded": "max_depth" in spec}
    focus = [c["spec"] for c in (node.conditions if node else []) if c["kind"] == "focus-metavariable"]
    severity = str(raw.get("severity", "")).lower()
    return Rule(
        id=str(raw["id"]), message=str(raw["message"]), severity=SEVERITY_ALIASES.get(severity, severity), languages=[str(x).lower() for x in raw["languages"]], pattern=node,
        name=str(raw.get("name", raw["id"])), description=str(raw.get("description", raw["message"])), confidence=str(raw.get("confidence", "medium")).lower(), fix=raw.get("fix"), fix_regex=raw.get("fix-regex"),
        paths=raw.get("paths") or {}, metadata={k: _text(v) for k, v in (raw.get("metadata") or {}).items()}, options={k: str(v).lower() for k, v in (raw.get("options") or {}).items()}, dataflow=flow, enabled=bool(raw.get("enabled", True)),
        roles=roles, focus=(focus[0] if isinstance(focus[0], str) else focus[0][0]) if focus else None,
    )


def leaves(node: PatternNode | None):
    if node is None:
        return
    if node.text is not None:
        yield node
    for p in node.parts:
        yield from leaves(p)


def regex_error(pattern: str) -> str | None:
    """What the JVM, which matches them, says against a regular expression; before a session is started, what Python says."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            re.compile(pattern)
        except re.error as e:
            return str(e)
        return None
    try:
        context._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
    except IllegalArgumentException as e:
        return str(e).split("\n")[0]
    return None


def validate(rule: Rule) -> list[str]:
    """What is wrong with a rule; empty if nothing is."""
    errors = []
    if not re.fullmatch(r"[A-Za-z0-9._-]+", rule.id):
        errors.append("id: letters, digits, '.', '_' and '-' only")
    if len(rule.name) > 100:
        errors.append("name: over 100 characters")
    if len(rule.description) > 1000:
        errors.append("description: over 1000 characters")
    if rule.severity not in SEVERITIES:
        errors.append(f"severity: {rule.severity!r}")
    if rule.confidence not in CONFIDENCES:
        errors.append(f"confidence: {rule.confidence!r}")
    if not rule.languages:
        errors.append("languages: none")
    if rule.pattern is None and not rule.dataflow:
        errors.append("no pattern and no dataflow")
    every = [r for some in rule.roles.values() for r in some]
    for r in rule.roles.get("sources", []):
        if _negates(r.requires):
            errors.append("requires: a source's may not negate a label")
    for leaf in [*leaves(rule.pattern), *(leaf for r in every for leaf in leaves(r.pattern))]:
        if leaf.kind in ("regex", "not-regex"):
            if e := regex_error(leaf.text):
                errors.append(f"regex: {e}")
        elif not leaf.text.strip():
            errors.append("pattern: empty")
    if rule.dataflow and not 1 <= rule.dataflow["max_depth"] <= 1000:
        errors.append("max_depth: not in 1..1000")
    if "cwe" in rule.metadata and not str(rule.metadata["cwe"]).lstrip('["').startswith("CWE-"):
        errors.append("cwe: does not start with CWE-")
    return errors


def load_rules(text: str, strict: bool = False) -> tuple[list[Rule], dict[str, list[str]]]:
    """Rules of a YAML (or JSON) text and the errors of those set aside; strict raises on the first error."""
    doc = _load(text) or {}
    good, bad, seen = [], {}, set()
    for i, raw in enumerate(doc.get("rules", []) if isinstance(doc, dict) else doc):
        name = str(raw.get("id", f"rule {i}")) if isinstance(raw, dict) else f"rule {i}"
        try:
            rule = parse_rule(raw)
            errors = validate(rule) + ["id: repeated"] * (rule.id in seen)
        except (KeyError, TypeError, ValueError) as e:
            errors = [f"{type(e).__name__}: {e}"]
        if errors:
            if strict:
                raise ValueError(f"{name}: {errors[0]}")
            bad[name] = errors
        else:
            seen.add(rule.id)
            good.append(rule)
    if not good:
        raise ValueError(f"no valid rule: {bad}")
    return good, bad


#: The rules of each language that has none of its own (id, severity, confidence, message, texts).
DEFAULTS = {
    "java": ("java-system-out", "warning", "high", "Use proper logging instead of System.out", ["System.out.println", "System.out.print"]),
    "javascript": ("js-console-log", "warning", "high", "Remove console statements before production", ["console.log", "console.warn"]),
    "python": ("python-print-usage", "warning", "high", "Use logging instead of print statements", ["print("]),
    "sql": ("sql-select-star", "warning", "medium", "Avoid SELECT * in production queries", ["SELECT *"]),
    "bash": ("bash-unquoted-variable", "warning", "medium", "Quote variables to prevent word splitting", ["echo $"]),
    "php": ("php-sql-injection", "error", "high", "Use prepared statements", ["mysql_query(", "mysqli_query("]),
    "csharp": ("csharp-console-writeline", "warning", "high", "Use proper logging framework", ["Console.WriteLine"]),
    "c": ("c-buffer-overflow", "error", "high", "Use safer alternatives", ["strcpy(", "gets("]),
    "ruby": ("ruby-puts-usage", "warning", "high", "Use proper logging instead of puts", ["puts "]),
    "kotlin": ("kotlin-println-usage", "warning", "high", "Use proper logging instead of println", ["println("]),
    "swift": ("swift-print-usage", "warning", "high", "Use proper logging instead of print", ["print("]),
    "xml": ("xml-best-practices", "warning", "high", "Review XML structure and comments", ["<!--"]),
}
#: Literal texts to look for in each language (id, text, severity, confidence, message, fix).
LITERALS = {
    "java": [
        ("java-sql-injection", ".executeQuery(", "critical", "medium", "Potential SQL injection vulnerability", "Use PreparedStatement instead of Statement"),
        ("java-hardcoded-password", "password", "warning", "low", "Potential hardcoded password", "Use environment variables or secure configuration"),
        ("java-weak-hash-sha1", '"SHA1"', "error", "high", "Use of SHA1 hash algorithm which is considered insecure", "Use SHA-256, SHA-384, or SHA-512 instead of SHA1"),
        ("java-weak-hash-md5", '"MD5"', "error", "high", "Use of MD5 hash algorithm which is considered insecure", "Use SHA-256, SHA-384, or SHA-512 instead of MD5"),
    ],
    "javascript": [
        ("js-eval-usage", "eval(", "critical", "high", "Use of eval() can lead to code injection", "Avoid using eval(), use safer alternatives"),
        ("js-innerhtml", "innerHTML", "warning", "medium", "Potential XSS vulnerability with innerHTML", "Use textContent or sanitize input"),
    ],
    "python": [
        ("python-exec-usage", "exec(", "critical", "high", "Use of exec() can lead to code injection", "Avoid using exec(), use safer alternatives"),
        ("python-sql-format", ".format(", "warning", "low", "Potential SQL injection with string formatting", "Use parameterized queries"),
    ],
    "sql": [("sql-union-injection", "UNION", "critical", "medium", "Potential SQL injection with UNION", "Use parameterized queries")],
    "bash": [("bash-command-injection", "$((", "critical", "medium", "Potential command injection", "Validate and sanitize input")],
}


def read_rule_files(spark: SparkSession, paths: list[str]) -> tuple[list[Rule], dict[str, str]]:
    """(rules, warnings by file) of all .yaml and .yml files at or below the paths, read by Spark from any store.

    A file that cannot be read as rules is a warning and leaves the others; of rules of one id the first file's stays.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    yaml = raw.where("path rlike '(?i)[.]ya?ml$'").selectExpr("path", "decode(content, 'UTF-8') as text").orderBy("path")
    rules: dict[str, Rule] = {}
    warnings: dict[str, str] = {}
    for row in yaml.toLocalIterator():
        try:
            good, bad = load_rules(row.text)
        except Exception as e:  # a file of anything but rules
            warnings[row.path] = f"{type(e).__name__}: {e}"
            continue
        warnings.update({row.path: str(bad)} if bad else {})
        for r in good:
            rules.setdefault(r.id, r)
    return list(rules.values()), warnings


def default_rules(language: str, loaded: list[Rule] = ()) -> list[Rule]:
    """The loaded rules of a language and the general ones; where there are none, the language's built-in rule."""
    mine = [r for r in loaded if language in r.languages or "generic" in r.languages]
    if mine or language not in DEFAULTS:
        return mine
    rule_id, severity, confidence, message, texts = DEFAULTS[language]
    return [Rule(rule_id, message, severity, [language], PatternNode("either", None, [PatternNode("simple", t) for t in texts]), confidence=confidence, description=message)]


def literal_rules(languages: list[str] | None = None) -> list[Rule]:
    """The built-in literal texts as rules."""
    return [
        Rule(rule_id, message, severity, [language], PatternNode("regex", re.escape(text)), confidence=confidence, fix=fix, description=message)
        for language, rows in LITERALS.items() if languages is None or language in languages for rule_id, text, severity, confidence, message, fix in rows
    ]


def select_rules(rules: list[Rule], language: str | None = None, category: str | None = None, enabled: bool | None = None, name: str | None = None, description: str | None = None) -> list[Rule]:
    """Rules by equality of language, category and state, and by parts of name and description without regard to case."""
    return [
        r for r in rules
        if (language is None or language in r.languages) and (category is None or r.metadata.get("category") == category) and (enabled is None or r.enabled == enabled)
        and (name is None or name.lower() in r.name.lower()) and (description is None or description.lower() in r.description.lower())
    ]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table; the pattern tree as JSON."""
    rows = [(r.id, r.name, r.message, r.severity, SEVERITIES[r.severity], r.confidence, CONFIDENCES[r.confidence], r.languages, json.dumps(asdict(r.pattern)) if r.pattern else None, r.fix, r.metadata, r.enabled) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, name string, message string, severity string, severity_ord int, confidence string, confidence_ord int, languages array<string>, pattern string, fix string, metadata map<string,string>, enabled boolean")


def complexity(text: str) -> tuple[float, int]:
    """(complexity, memory) estimates of a rule text: (lines + bytes / 100) / 10 and 2 * bytes + 1024."""
    n = len(text.encode())
    return (len(text.splitlines()) + n / 100) / 10, 2 * n + 1024
