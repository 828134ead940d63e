"""Scalar functions over text, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of each language; the registry of parsers has no XML, .mjs is this library's own.
EXTENSIONS = {
    "java": ["java"], "javascript": ["js", "jsx", "ts", "tsx", "mjs"], "python": ["py", "pyw"], "sql": ["sql", "ddl", "dml"], "bash": ["sh", "bash", "zsh"],
    "php": ["php", "phtml", "php3", "php4", "php5"], "csharp": ["cs", "csx"], "c": ["c", "h"], "ruby": ["rb", "rbw", "rake", "gemspec"], "kotlin": ["kt", "kts"], "swift": ["swift"],
    "xml": ["xml", "xsd", "xsl", "xslt", "svg", "pom"],
}
#: Languages by extension as uploads name them; anything else is text.
UPLOAD_EXTENSIONS = {
    "java": ["java"], "javascript": ["js", "jsx"], "typescript": ["ts", "tsx"], "python": ["py"], "sql": ["sql"], "bash": ["sh", "bash"], "c": ["c"], "cpp": ["cpp", "cc", "cxx"],
    "csharp": ["cs"], "go": ["go"], "rust": ["rs"], "php": ["php"], "ruby": ["rb"], "kotlin": ["kt", "kts"], "swift": ["swift"], "xml": ["xml"],
}


def extension_table(profile: str = "files") -> dict[str, str]:
    """extension -> language: `files` for scans, `parsers` for what has a parser of its own, `uploads` by file names."""
    table = UPLOAD_EXTENSIONS if profile == "uploads" else EXTENSIONS
    return {e: lang for lang, es in table.items() for e in es if not (profile == "parsers" and (lang == "xml" or e == "mjs"))}


#: Other names of languages.
ALIASES = {"js": "javascript", "typescript": "javascript", "ts": "javascript", "py": "python", "sh": "bash", "shell": "bash", "c#": "csharp", "cs": "csharp", "rb": "ruby", "kt": "kotlin"}


def normalize_sql(sql: Column) -> Column:
    """#{..} becomes 1, ${..} becomes T0, white space one blank; trimmed, with an ending semicolon."""
    s = F.regexp_replace(F.regexp_replace(sql, r"#\{[^}]+\}", "1"), r"\$\{[^}]+\}", "T0")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.endswith(s, F.lit(";")), s).otherwise(F.concat(s, F.lit(";")))


def normalize_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a 1-based character position."""
    return 1 + F.regexp_count(F.substring(text, F.lit(1), at - 1), F.lit("\n"))


def column_of(text: Column, at: Column) -> Column:
    """1-based column of a 1-based character position."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), at - 1), "\n", -1)) + 1


def truncate(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - 3)), F.lit("..."))).otherwise(s)


def severity_alias(s: Column) -> Column:
    u = F.upper(s)
    return F.when(u == "HIGH", "error").when(u == "MEDIUM", "warning").when(u == "LOW", "info").otherwise("warning")


def glob_column(path: Column, pattern: str) -> Column:
    """No star: contains; one: prefix and suffix; more: contains what is left without stars."""
    stars = pattern.count("*")
    if stars == 1:
        a, b = pattern.split("*")
        return F.startswith(path, F.lit(a)) & F.endswith(path, F.lit(b))
    return F.contains(path, F.lit(pattern.replace("*", "")))


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include (none given: all) and no exclude."""
    ok = F.lit(not include)
    for p in include:
        ok = ok | glob_column(path, p)
    for p in exclude:
        ok = ok & ~glob_column(path, p)
    return ok


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(name: Column) -> Column:
    """A language's usual name from any of its names, lower case."""
    n = F.lower(name)
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[n], n)


def literal_kind(s: Column) -> Column:
    """integer, string, boolean, null or none: what a constant's text folds to."""
    return F.when(F.regexp(s, F.lit("^-?[0-9]+$")), "integer").when(F.regexp(s, F.lit("^(\".*\"|'.*')$")), "string").when(s.isin("true", "false"), "boolean").when(s == "null", "null").otherwise("none")


def remaining(confidence: Column, effects: Column) -> Column:
    """confidence times the product of 1 - e."""
    return F.aggregate(effects, confidence, lambda a, e: a * (1 - e))


def is_comment(line: Column) -> Column:
    return F.regexp(F.ltrim(line), F.lit(r"^(#|//|/\*)"))


def language_of_path(path: Column, profile: str = "files") -> Column:
    """The language of a path's extension; unknown: null, or text for uploads."""
    pairs = [F.lit(x) for kv in extension_table(profile).items() for x in kv]
    found = F.create_map(*pairs)[extension(path)]
    return F.coalesce(found, F.lit("text")) if profile == "uploads" else found


def replace_placeholders(s: Column, start: str, replacement: str) -> Column:
    """`start`..} by a replacement; one that is never closed swallows the rest."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in start)
    return F.regexp_replace(s, f"(?s){literal}[^}}]*(?:\\}}|$)", replacement.replace("$", "\\$"))


def normalize_sql_loose(s: Column) -> Column:
    """normalize_sql() for snippets cut out by a scanner: placeholders may be empty or unclosed."""
    s = replace_placeholders(replace_placeholders(s, "${", "T0"), "#{", "1")
    s = F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " "))
    return F.when(F.endswith(s, F.lit(";")), s).otherwise(F.concat(s, F.lit(";")))


def unescape_java(s: Column) -> Column:
    """\\n \\r \\t, quotes, backslash and \\uXXXX of a Java string literal; other escaped characters stand for themselves,
    surrogates and bad digits for nothing, a backslash at the end for nothing."""
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)\\u.{0,4}|\\.|\\$|[^\\]++"), F.lit(0))

    def plain(x: Column) -> Column:
        hex_ = F.substring(x, F.lit(3), F.lit(4))
        unit = F.decode(F.unhex(F.lpad(hex_, 4, "0")), "UTF-16BE")
        good = F.regexp(hex_, F.lit("^[0-9A-Fa-f]{1,4}$")) & ~F.regexp(hex_, F.lit("(?i)^d[89a-f]..$"))
        code = F.substring(x, F.lit(2), F.lit(1))
        made = F.when(code == "n", "\n").when(code == "r", "\r").when(code == "t", "\t").when(code == "u", F.when(good, unit).otherwise("")).otherwise(code)
        return F.when(F.startswith(x, F.lit("\\")), made).otherwise(x)

    return F.array_join(F.transform(pieces, plain), "")


def rule_id_with_path(directory: Column, rule_id: Column) -> Column:
    """A rule's id after its file's directory, with dots for slashes; a leading ./ counts for nothing."""
    d = F.replace(F.regexp_replace(directory, r"^\./", ""), F.lit("/"), F.lit("."))
    return F.when(F.coalesce(d, F.lit("")) == "", rule_id).otherwise(F.concat_ws(".", d, rule_id))


def constant_text(kind: Column, value: Column) -> Column:
    """A constant as text: null constants read null, unknown ones have none."""
    return F.when(kind == "null", "null").when(kind.isin("string", "integer", "boolean"), value)


def constant_matches(kind: Column, value: Column, pattern: str) -> Column:
    """A constant's text contains a pattern; null and unknown constants match nothing."""
    return F.coalesce(kind.isin("string", "integer", "boolean") & F.contains(value, F.lit(pattern)), F.lit(False))


#: What marks a constant as sensitive, in its name or its value.
SENSITIVE = ("password", "secret", "token", "api_key", "private_key", "credential")


def sensitive(name: Column, text: Column) -> Column:
    any_of = "|".join(SENSITIVE)
    return F.regexp(F.lower(F.coalesce(name, F.lit(""))), F.lit(any_of)) | F.regexp(F.lower(F.coalesce(text, F.lit(""))), F.lit(any_of))


def editor_glob(path: Column, pattern: str) -> Column:
    """Star alone: all; **/x and *.x: by suffix; one other star: prefix and suffix; else equality."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("**/"):
        return F.endswith(path, F.lit(pattern[3:]))
    if pattern.startswith("*."):
        return F.endswith(path, F.lit(pattern[1:]))
    if pattern.count("*") == 1:
        a, b = pattern.split("*")
        return F.startswith(path, F.lit(a)) & F.endswith(path, F.lit(b))
    return path == pattern


def editor_file_gate(path: Column, patterns: list[str] = (), exclude: list[str] = (), enabled: bool = True) -> Column:
    """Exclusion comes first; without patterns every other file is taken."""
    ok = F.lit(not patterns)
    for p in patterns:
        ok = ok | editor_glob(path, p)
    for p in exclude:
        ok = ok & ~editor_glob(path, p)
    return F.lit(enabled) & ok


def editor_rule_gate(rule_id: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """Not denied, and allowed where there is a list of allowed ones."""
    ok = rule_id.isin(list(allow)) if allow else F.lit(True)
    return ok & ~rule_id.isin(list(deny)) if deny else ok


def sums_before(numbers: str, zero: str = "0", join: str = "{0} + {1}", chunk: int = 128) -> str:
    """SQL: for each element of an array of ints, the sum (or another `join`) of those before it.

    Chunks are joined first and elements inside their chunk after, so that no growing array is copied
    for every element of a long one.
    """
    fold = lambda a, x, at: f"aggregate({a}, named_struct('at', {at}, 'out', cast(array() as array<int>)), (s, {x}) -> named_struct('at', {join.format('s.at', x)}, 'out', concat(s.out, array(s.at))), s -> s.out)"
    chunks = f"transform(sequence(0, greatest(size({numbers}) - 1, 0) div {chunk}), c -> slice({numbers}, cast(c as int) * {chunk} + 1, {chunk}))"
    sums = f"transform(q, x -> aggregate(x, {zero}, (s, v) -> {join.format('s', 'v')}))"
    return f"transform(array({chunks}), q -> flatten(zip_with(q, {fold(sums, 't', zero)}, (x, b) -> {fold('x', 'v', 'b')})))[0]"


def sql_text(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
