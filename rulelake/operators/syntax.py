"""Source text to node tables: line heuristics, SQL statements, Python, XML, and other languages by tokens."""

from __future__ import annotations

import ast as pyast
import re
import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_comment
from .matching import nested
from .tokens import line_col, line_starts, row_batches, tokenize

NODE_FIELDS = "node_id long, post long, parent_id long, sibling_idx int, depth int, node_type string, text string, start_line int, end_line int"
DETAIL_FIELDS = ", language string, scope long, arg int"
#: Words that open a declaration, and verbs of SQL statements.
DECLARING = "int|long|float|double|boolean|char|String|var|let|const|final|static|public|private|protected"
SQL_VERBS = "SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|MERGE|WITH"
#: Words that open a block in brace and shell languages.
STATEMENTS = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "return": "return_statement", "class": "class_declaration", "import": "import_statement", "export": "export_statement", "case": "switch_statement", "try": "try_statement"}
#: Python's own node names and ours.
PYTHON = {"Call": "call_expression", "Assign": "assignment", "AugAssign": "assignment", "Name": "identifier", "Return": "return_statement", "FunctionDef": "function_declaration", "ClassDef": "class_declaration", "If": "if_statement", "For": "for_statement", "While": "while_statement", "Try": "try_statement", "Import": "import_statement", "ImportFrom": "import_statement", "Constant": "literal", "BinOp": "binary_expression", "Attribute": "member_expression", "Expr": "expression_statement", "arg": "parameter", "AsyncFunctionDef": "function_declaration"}


def line_nodes(files: DataFrame, text_col: str = "source") -> DataFrame:
    """A row for each reading of each line that is no comment: call, declaration, assignment, SQL statement; shell lines are calls."""
    lines = files.select("*", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).where(~is_comment(F.col("line")) & (F.trim("line") != ""))
    t = F.trim("line")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("language") == "bash") | (F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))), "call_expression"),
            F.when(F.regexp(t, F.lit(rf"^({DECLARING})\b")), "variable_declaration"),
            F.when(F.contains(t, F.lit("=")) & ~F.contains(t, F.lit("==")) & ~F.contains(t, F.lit("!=")), "assignment"),
            F.when(F.regexp(t, F.lit(rf"(?i)^({SQL_VERBS})\b")), "sql_statement"),
        )
    )
    return lines.select("file_id", (F.col("line_no") + 1).alias("start_line"), F.explode(kinds).alias("node_type"), t.alias("text"))


def sql_statements(statements: DataFrame, column: str = "sql") -> DataFrame:
    """Statements with their verb, columns, table and condition."""
    s = F.regexp_replace(F.trim(column), r";\s*$", "")
    get = lambda p, g=1: F.regexp_extract(s, p, g)
    return statements.withColumns(
        {
            "verb": F.upper(get(r"^\s*([A-Za-z]+)")),
            "columns": F.transform(F.split(get(r"(?is)^\s*select\s+(.*?)\s+from\b"), ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")),
            "table_name": F.coalesce(F.nullif(get(r"(?is)\bfrom\s+([\w.]+)"), F.lit("")), F.nullif(get(r"(?is)\binto\s+([\w.]+)"), F.lit("")), F.nullif(get(r"(?is)^\s*update\s+([\w.]+)"), F.lit(""))),
            "condition": F.nullif(get(r"(?is)\bwhere\s+(.*?)(\s+(?:group|order|having|limit)\b.*)?$"), F.lit("")),
        }
    )


def _error(text: str) -> list[tuple]:
    return [(0, 0, None, 0, 0, "error", text, 1, text.count("\n") + 1)]


def _post_order(rows: list[list]) -> list[tuple]:
    """Rows with their post-order numbers and, where missing, their place among siblings; a child's number follows its parent's."""
    below: dict[int, list[int]] = {}
    for r in rows[1:]:
        mine = below.setdefault(r[2], [])
        r[3] = len(mine)
        mine.append(r[0])
    order, walk = [], [0]
    while walk:
        n = walk.pop()
        order.append(n)
        walk += below.get(n, [])
    for k, n in enumerate(reversed(order)):
        rows[n][1] = k
    return [tuple(r) for r in rows]


def _python(text: str) -> list[tuple]:
    """Nodes of Python's own tree; of what has a body the text is its head. Code that is too deep for the parser is an error node."""
    try:
        tree = pyast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _error(text)
    data = text.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", data))]
    place = lambda line, column: starts[line - 1] + column
    rows: list[list] = [[0, 0, None, 0, 0, "program", text, 1, max(1, len(text.splitlines()))]]
    walk = [(c, 0, 1, None) for c in reversed([c for c in pyast.iter_child_nodes(tree) if hasattr(c, "lineno")])]
    while walk:
        node, parent, depth, arg = walk.pop()
        body = getattr(node, "body", None)
        first = body[0] if isinstance(body, list) and body else None
        if first is not None and getattr(first, "decorator_list", None):
            first = first.decorator_list[0]
        low, high = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
        if first is not None:
            high = max(low, place(first.lineno, first.col_offset))
        me = len(rows)
        part = data[low:high].decode()
        rows.append([me, 0, parent, 0, depth, PYTHON.get(type(node).__name__, type(node).__name__), part.rstrip("@ \t\r\n") if first is not None else part, node.lineno, node.end_lineno, arg])
        places = {id(a): k for k, a in enumerate(node.args)} if isinstance(node, pyast.Call) else {}
        walk += [(c, me, depth + 1, places.get(id(c))) for c in reversed([c for c in _python_children(node) if hasattr(c, "lineno")])]
    return _post_order(rows)


def _python_children(node) -> Iterator:
    """Children in the order of the source for functions (their parameters first), as the tree has them otherwise."""
    for c in pyast.iter_child_nodes(node):
        if isinstance(c, pyast.arguments):
            yield from sorted((a for a in pyast.iter_child_nodes(c) if hasattr(a, "lineno")), key=lambda a: (a.lineno, a.col_offset))
        else:
            yield c


def _xml(text: str) -> list[tuple]:
    """Elements, each with its whole text and the lines of its tags."""
    places: list[list[int]] = []
    inside: list[int] = []
    places_of = expat.ParserCreate()

    def begin(*_) -> None:
        inside.append(len(places))
        places.append([places_of.CurrentLineNumber, 0])

    def end(_) -> None:
        places[inside.pop()][1] = places_of.CurrentLineNumber

    places_of.StartElementHandler, places_of.EndElementHandler = begin, end
    try:
        root = ET.fromstring(text)
        places_of.Parse(text, True)
        rows: list[list] = []
        walk = [(root, None, 0)]
        while walk:
            e, parent, depth = walk.pop()
            me = len(rows)
            tail, e.tail = e.tail, None  # what follows an element is its parent's
            rows.append([me, 0, parent, 0, depth, "element", ET.tostring(e, "unicode"), *places[me]])
            e.tail = tail
            walk += [(c, me, depth + 1) for c in reversed(e)]
        return _post_order(rows)
    except (ET.ParseError, expat.ExpatError, RecursionError):
        return _error(text)


#: Languages whose statements end by a semicolon alone, whose functions need no keyword, and whose comments begin with #.
BY_SEMICOLON = {"java", "c", "cpp", "csharp", "php", "rust", "sql"}
BARE_FUNCTIONS = {"java", "c", "cpp", "csharp", "javascript", "typescript", "bash"}
HASH_COMMENTS = {"bash", "ruby", "python", "php", "yaml"}
#: Words before a parenthesis that are no calls, words after which a statement begins, and pairs of block words.
CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "foreach", "elif", "elsif", "until", "unless", "with", "lock", "using", "when", "return", "guard"}
BEGINS = {"then", "do", "else", "begin", "ensure"}
BLOCK_WORDS = {"bash": ({"if": "fi", "for": "done", "while": "done", "until": "done", "case": "esac"}, set()), "ruby": (dict.fromkeys(("def", "class", "module", "if", "unless", "while", "until", "case", "begin", "for"), "end"), {"do"})}
FUNCTION_WORDS = {"function", "def", "fun", "func", "fn", "sub"}
_OPENERS = {"(": ")", "[": "]", "{": "}"}
#: A line that ends or begins with one of these goes on in the next, or goes on from the one before.
GOES_ON, GOES_ON_FROM = set("+-*/%=<>!&|^~?:,.([") | {"\\"}, set("+*/%=<>&|^?:,.)]") | {"instanceof", "..."}


def _masked(text: str, language: str) -> str:
    """The text with comments blank and the insides of strings filled, place by place, so that neither holds brackets or words."""
    comment = r"//[^\n]*|/\*.*?\*/" if language not in ("bash", "ruby", "sql") else r"--[^\n]*|/\*.*?\*/" if language == "sql" else r"(?!)"
    sharp = r"|(?<![^\s;])#[^\n]*" if language in HASH_COMMENTS else ""
    pattern = rf"(?P<c>{comment}{sharp})|(?P<s>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m["c"] is not None else m[0][0] + re.sub(r"[^\n]", "_", m[0][1:-1]) + m[0][-1]
    return re.sub(pattern, blank, text, flags=re.DOTALL)


def _ends(words: list[str], lines: list[int], language: str) -> tuple[list[int], dict[int, int], list[int]]:
    """(last token of each token's statement, closing token of each opening one, opening token around each).

    One walk with a stack of open brackets and block words. A statement ends at a semicolon, before a closing token, and,
    where the language has it so, at a line break unless the line goes on; inside parentheses a comma ends what it separates.
    """
    n = len(words)
    last, close, around = list(range(n)), {}, [-1] * n
    openers, anywhere = BLOCK_WORDS.get(language, ({}, set()))
    closers = set(openers.values()) | ({"end"} if anywhere else set())
    by_line = language not in BY_SEMICOLON
    # of each open group: its opening token, the tokens of its present statement, its last token, whether it holds statements
    stack: list[list] = [[-1, [], None, True]]

    def finish(group: list, at: int) -> None:
        for k in group[1]:
            last[k] = at
        group[1] = []

    for i, t in enumerate(words):
        if t in _OPENERS.values() or t in closers:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if _closes(words[stack[d][0]], t, openers, anywhere)), 0)
            while depth and len(stack) > depth:
                group = stack.pop()
                finish(group, group[2] if group[2] is not None else group[0])
                close[group[0]] = i if len(stack) == depth else i - 1
        group = stack[-1]
        # elsewhere a line that assigns begins a statement as well, so that code without semicolons is not one statement
        if group[3] and group[2] is not None and lines[i] > lines[group[2]] and words[group[2]] not in GOES_ON and t not in GOES_ON_FROM and (by_line or i + 1 < n and words[i + 1] == "="):
            finish(group, group[2])
        around[i], begins = group[0], not group[1] and group[3] and t not in closers and t not in _OPENERS.values()
        group[1].append(i)
        group[2] = i
        if t == ";" or (t == "," and not group[3]) or (t in BEGINS and (begins or language in BLOCK_WORDS)) or (t == "}" and group[3] and _is_block(words, group[1][0])):
            finish(group, i)
        if t in _OPENERS or (t in openers and begins) or t in anywhere:
            stack.append([i, [], None, t not in "(["])
    while stack:
        group = stack.pop()
        finish(group, n - 1 if group[2] is None else group[2])
        if group[0] >= 0:
            close[group[0]] = n - 1
    return last, close, around


def _closes(opener: str, t: str, openers: dict[str, str], anywhere: set[str]) -> bool:
    return _OPENERS.get(opener) == t or openers.get(opener) == t or (opener in anywhere and t in ("end", "done"))


def _is_block(words: list[str], first: int) -> bool:
    """Whether a statement that a closing brace may end is a block statement: it does not assign what stands in braces."""
    return words[first] in STATEMENTS or words[first] in CONTROL or words[first] == "{" or "=" not in words[first + 1 : first + 4]


def _tokens(text: str, language: str = "generic") -> list[tuple]:
    """Calls, assignments, functions with their parameters and keyword statements below the program node.

    What has a block spans it, and its text is its head up to the block; so all texts together are as long as the source
    times the depth of its calls. Statements end as the language ends them (see _ends).
    """
    spans = tokenize(_masked(text, language))
    words = [t for t, _, _ in spans]
    starts = line_starts(text)
    lines = []
    for _, a, _ in spans:
        at = lines[-1] if lines else 1
        while at < len(starts) and starts[at] <= a:
            at += 1
        lines.append(at)
    last, close, around = _ends(words, lines, language)
    n = len(words)
    commas: list[int] = []  # before each token in its own group
    counted: dict[int, int] = {}
    for k, t in enumerate(words):
        commas.append(counted.get(around[k], 0))
        if t == ",":
            counted[around[k]] = commas[k] + 1
    rows: list[list] = [[0, 0, None, 0, 0, "program", text, 1, len(starts)]]
    openers, _ = BLOCK_WORDS.get(language, ({}, set()))
    ends = set(openers.values())
    word = lambda k: words[k][0].isalpha() or words[k][0] in "_$@"
    open_: list[tuple[int, int]] = [(0, n)]
    calls: dict[int, int] = {}  # opening parentheses of calls
    heads: list[tuple[int, set[int]]] = [(-1, set())]  # end of the present function's head, its parameters

    def block_of(k: int, stop: int) -> tuple[int, int]:
        """(last token of the head, last token of the block) of a statement that begins at a token."""
        if words[k] in openers and k in close:
            return min(max(k, last[min(k + 1, n - 1)]), close[k]), close[k]
        j = k + 1
        while j <= stop:
            if words[j] == "{" and j in close:
                return j, close[j]
            j = close[j] + 1 if words[j] in "([" and j in close else j + 1
        return stop, stop

    def add(kind: str, first: int, head: int, extent: int, own: str | None = None) -> None:
        parent, limit = open_[-1]
        extent = max(first, min(extent, limit))
        a, b = spans[first][1], spans[max(first, head)][2]
        arg, k = None, first
        if parent in calls:
            while k >= 0 and around[k] != calls[parent]:
                k = around[k]
            arg = commas[k] if k >= 0 else None
        rows.append([len(rows), 0, parent, 0, len(open_), kind, text[a:b] if own is None else own, lines[first], lines[extent], arg])
        if extent > first:
            open_.append((len(rows) - 1, extent))

    for i in range(n):
        while i > open_[-1][1]:
            open_.pop()
        t, follow = words[i], words[i + 1] if i + 1 < n else ""
        if not word(i) or (language in BLOCK_WORDS and (t in BEGINS or t in ends)):
            continue
        if i <= heads[-1][0]:
            if i in heads[-1][1]:
                add("parameter", i, i, i)
            continue
        name = i if follow == "(" and language in BARE_FUNCTIONS and t not in CONTROL and t not in FUNCTION_WORDS and _declares(words, close, i) else None
        if t in FUNCTION_WORDS:
            name = next((k for k in range(i + 1, min(i + 8, n)) if words[k] == "(" or lines[k] > lines[i]), None)
        if name is not None or t in FUNCTION_WORDS:
            opening = name if t in FUNCTION_WORDS else i + 1
            if opening is not None and words[opening] != "(":
                opening = None
            head, extent = block_of(i, last[i])
            add("function_declaration", i, head, extent)
            stop = close.get(opening, head) if opening is not None else head
            heads[-1] = (max(i, min(stop, head)), set(_parameters(words, opening, stop)) if opening is not None else set())
        elif t in STATEMENTS:
            head, extent = block_of(i, last[i])
            add(STATEMENTS[t], i, head, extent)
        elif follow == "(" and t not in CONTROL:
            k = i
            while k > 1 and words[k - 1] == "." and (words[k - 2][0].isalpha() or words[k - 2][0] == "_"):
                k -= 2
            end = close.get(i + 1, n - 1)
            calls[len(rows)] = i + 1
            add("call_expression", i, end, end, text[spans[k][1] : spans[end][2]])
        elif follow == "=" and (i + 2 >= n or words[i + 2] not in ("=", ">")):
            end = last[i]
            # an ending comma or closing word is not a part of it
            while end > i and words[end] == ",":
                end -= 1
            add("assignment", i, end, end)
            rows.append([len(rows), 0, len(rows) - 1, 0, len(open_) if end > i else len(open_) + 1, "identifier", text[spans[i][1] : spans[i][2]], lines[i], lines[i]])
        else:
            add("identifier", i, i, i)
    return _post_order(rows)


def _declares(words: list[str], close: dict[int, int], i: int) -> bool:
    """Whether what follows a name and its parentheses is a block, or a list of exceptions and a block."""
    if i and words[i - 1] in (".", "new", "return", "="):
        return False
    k = close.get(i + 1, len(words)) + 1
    while k < len(words) and k < close.get(i + 1, 0) + 12 and (words[k][0].isalpha() or words[k] in ",."):
        k += 1
    return k < len(words) and words[k] == "{"


def _parameters(words: list[str], opening: int, stop: int) -> Iterator[int]:
    """Names of a parameter list: in each part the last word before a colon or a default value."""
    found, done, depth = None, False, 0
    for k in range(opening + 1, stop + 1):
        t = words[k]
        if k == stop or (t == "," and depth == 0):
            if found is not None:
                yield found
            found, done = None, False
            continue
        depth += (t in "([{<") - (t in ")]}>")
        if depth == 0 and t in ("=", ":"):
            done = True
        elif depth == 0 and not done and (t[0].isalpha() or t[0] in "_$"):
            found = k


def build(spark, file_id: int, tree: tuple) -> DataFrame:
    """The node table of a tree written as (node type, text, children): what fixtures and generators start from."""
    rows: list[list] = []
    post = [0]

    def visit(node: tuple, parent: int | None, k: int, depth: int) -> None:
        kind, text, children = (*node, None, ())[:3] if len(node) < 3 else node
        me = len(rows)
        rows.append([file_id, me, 0, parent, k, depth, kind, text, 1, 1])
        for i, c in enumerate(children or ()):
            visit(c, me, i, depth + 1)
        rows[me][2] = post[0]
        post[0] += 1

    visit(tree, None, 0, 0)
    return spark.createDataFrame([tuple(r) for r in rows], f"file_id long, {NODE_FIELDS}")


PARSERS = {"python": _python, "xml": _xml}


def tree_rows(table: dict, language: str | None, text: str, detail: bool) -> Iterator[tuple]:
    """One text's rows of NODE_FIELDS, with detail of DETAIL_FIELDS as well."""
    tree = table[language](text) if language in table else _tokens(text, language or "generic")
    scopes: dict[int, int] = {}
    functions = {r[0] for r in tree if r[5] == "function_declaration"} if detail else ()
    for r in tree:
        if detail:  # a parent's number is less than its children's
            scopes[r[0]] = r[2] if r[2] in functions else scopes.get(r[2], 0)
        yield (*r[:9], *((language, scopes[r[0]], r[9] if len(r) > 9 else None) if detail else ()))


def parse(files: DataFrame, parsers: dict | None = None, id_col: str = "file_id", text_col: str = "source", caps: dict[str, int] | None = None, detail: bool = False) -> DataFrame:
    """The node table of all files, by each language's parser (others by tokens); pre and post order numbers give containment.

    With detail there are further columns: the file's language, `scope`, the function that a node lies in (0: none), and `arg`,
    which argument of its call a node is or lies in (null where the parser does not tell).

    caps: most characters of a text of a language ("" for all others); a longer one is one `error` node without text.
    """
    table = {**PARSERS, **(parsers or {})}
    caps = caps or {}
    if any(v < 1 for v in caps.values()):
        raise ValueError("a size cap cannot be zero")

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), *([pa.string(), pa.int64(), pa.int32()] if detail else [])]

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        for k, (language, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            most = caps.get(language, caps.get(""))
            if most is not None and text is not None and len(text) > most:
                yield k, (0, 0, None, 0, 0, "error", "", 1, text.count("\n") + 1, *((language, 0, None) if detail else ()))
                continue
            for r in tree_rows(table, language, text or "", detail):
                yield k, r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from row_batches(batch, rows_of, ["file_id", *[f.split()[0] for f in fields.split(", ")]], types)

    fields = NODE_FIELDS + (DETAIL_FIELDS if detail else "")
    slim = files.select(F.col(id_col).alias("file_id"), F.col("language").cast("string"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"file_id {slim.schema['file_id'].dataType.simpleString()}, {fields}")


def inside(nodes: DataFrame, inner: str, outer: str, wanted: bool = True) -> DataFrame:
    """Nodes of one type with (without) an ancestor of another: of those before them in pre-order, one that ends later in post-order."""
    of = lambda kind: nodes.where(F.col("node_type") == kind)
    return nested(of(inner), of(outer), ["file_id"], wanted, True, "node_id", "post", strict=True)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"))
