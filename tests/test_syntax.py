"""Statements by line, bracket and block word; linear time and bytes; code that is too deep or no code at all."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulelake.operators import syntax


def nodes(language, text, kinds=("assignment", "function_declaration", "if_statement", "return_statement", "parameter", "call_expression")):
    rows = syntax._python(text) if language == "python" else syntax._tokens(text, language)
    return [(r[5], r[6], r[7], r[8]) for r in rows if r[5] in kinds]


def test_bash_statements_end_with_their_lines():
    assert nodes("bash", 'x=1\ny=$(read a)\nif [ $x ]; then\n  z=2\nfi\nf() {\n  q=3\n  echo "{ k=4" # c { m=5\n}\nw=6') == [
        ("assignment", "x=1", 1, 1), ("assignment", "y=$(read a)", 2, 2), ("call_expression", "$(read a)", 2, 2), ("if_statement", "if [ $x ];", 3, 5),
        ("assignment", "z=2", 4, 4), ("function_declaration", "f() {", 6, 9), ("assignment", "q=3", 7, 7), ("assignment", "w=6", 10, 10),
    ]


def test_kotlin_swift_and_ruby():
    assert nodes("kotlin", "fun f(a: Int, b: String = \"x\"): Int {\n  val c = g(a,\n    b)\n  return c\n}\nval d = f(1)\n") == [
        ("function_declaration", 'fun f(a: Int, b: String = "x"): Int {', 1, 5), ("parameter", "a", 1, 1), ("parameter", "b", 1, 1), ("assignment", "c = g(a,\n    b)", 2, 3), ("call_expression", "g(a,\n    b)", 2, 3),
        ("return_statement", "return c", 4, 4), ("assignment", "d = f(1)", 6, 6), ("call_expression", "f(1)", 6, 6),
    ]
    assert nodes("swift", "let a = b\n  .foo()\nvar c = 1\nfunc g(with a: Int) { return a }", ("assignment", "parameter", "return_statement")) == [("assignment", "a = b\n  .foo()", 1, 2), ("assignment", "c = 1", 3, 3), ("parameter", "a", 4, 4), ("return_statement", "return a", 4, 4)]
    assert nodes("ruby", "def foo(a, b = 1)\n  c = a\n  return c if b\nend\nx = foo(1)\n[1].each do |i|\n  y = i\nend\nz = 2", ("assignment", "function_declaration", "parameter")) == [
        ("function_declaration", "def foo(a, b = 1)", 1, 4), ("parameter", "a", 1, 1), ("parameter", "b", 1, 1), ("assignment", "c = a", 2, 2), ("assignment", "x = foo(1)", 5, 5), ("assignment", "y = i", 7, 7), ("assignment", "z = 2", 9, 9),
    ]


def test_java_and_javascript():
    assert nodes("java", 'int f(String a, int b) throws E { String c = a +\n b; return h(c); } // x = (\nvoid g() { f("{", 1); }') == [
        ("function_declaration", "f(String a, int b) throws E {", 1, 2), ("parameter", "a", 1, 1), ("parameter", "b", 1, 1), ("assignment", "c = a +\n b;", 1, 2), ("return_statement", "return h(c);", 2, 2), ("call_expression", "h(c)", 2, 2),
        ("function_declaration", "g() {", 3, 3), ("call_expression", 'f("{", 1)', 3, 3),
    ]
    assert nodes("javascript", "const o = { a: f(1) }\nlet k = (x) => x\nz = q(f(a = 1, b))", ("assignment",)) == [("assignment", "o = { a: f(1) }", 1, 1), ("assignment", "k = (x) => x", 2, 2), ("assignment", "z = q(f(a = 1, b))", 3, 3), ("assignment", "a = 1", 3, 3)]


def test_python_heads_and_parameters():
    text = "def f(a, *b, c=1):\n    x = 'é' + a\n    return g(x)\nclass A:\n    @d\n    def m(self): pass"
    assert nodes("python", text, ("function_declaration", "class_declaration", "parameter", "assignment", "return_statement")) == [
        ("function_declaration", "def f(a, *b, c=1):", 1, 3), ("parameter", "a", 1, 1), ("parameter", "b", 1, 1), ("parameter", "c", 1, 1), ("assignment", "x = 'é' + a", 2, 2), ("return_statement", "return g(x)", 3, 3),
        ("class_declaration", "class A:", 4, 6), ("function_declaration", "def m(self):", 6, 6), ("parameter", "self", 6, 6),
    ]


@pytest.mark.parametrize("language", ["bash", "javascript", "java", "ruby", "kotlin"])
def test_linear(language):
    text = "\n".join(f"x{i}=foo(y{i}) {{" if i % 7 == 0 else "}" if i % 7 == 6 else f"x{i}=$(cmd a{i})" for i in range(20000))
    began = time.time()
    rows = syntax._tokens(text, language)
    assert time.time() - began < 5 and sum(len(r[6]) for r in rows) < 8 * len(text)


def test_python_is_linear_and_deep_code_is_an_error():
    text = "\n".join(f"def f{i}(a):\n    x{i} = g(a, {i})" for i in range(10000))
    began = time.time()
    rows = syntax._python(text)
    assert time.time() - began < 5 and len(rows) > 50000 and sum(len(r[6]) for r in rows) < 4 * len(text)
    assert syntax._python("+".join(["1"] * 100000))[0][5] == "error" and len(syntax._python("+".join(["1"] * 900))) == 1801
    assert syntax._xml("<a>" * 20000 + "</a>" * 20000)[0][5] == "error"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab=(){}[];,.\n \"'#if$", max_size=60), st.sampled_from(["bash", "java", "javascript", "ruby", "kotlin", "sql", "generic"]))
def test_any_text_gives_a_tree(text, language):
    rows = syntax._tokens(text, language)
    assert sorted(r[1] for r in rows) == list(range(len(rows))) and [r[0] for r in rows] == list(range(len(rows)))
    for me, post, parent, _, depth, kind, own, low, high, *_ in rows[1:]:
        up = rows[parent]
        assert parent < me and post < up[1] and depth == up[4] + 1 and low <= high and (own in text or kind == "error")
        assert post - me + depth >= 0  # descendants


def test_xml_lines():
    rows = syntax._xml("<a>\n <b x='1'>t</b> tail\n <c>\n  <d/>\n </c>\n</a>")
    assert [(r[6], r[7], r[8]) for r in rows[1:]] == [('<b x="1">t</b>', 2, 2), ("<c>\n  <d />\n </c>", 3, 5), ("<d />", 4, 4)] and rows[0][7:] == (1, 6)
