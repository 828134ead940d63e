"""Rules whose anchors are common words, comment marks of lines, and passes whose memory does not follow the size of a batch."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from rulelake import catalog
from rulelake.operators import anchors, syntax, taint_rules, tokens

PIECES = ["ab", "c", "a?", "(bc)", "(?:c[^a])", "[ab]", "[^b]+", "[^a-b]*", "b{2,3}", r"\s+", r"\S+?", r"\b", "a+", "(a|bc)", "(?i:ab)", "c*?", ".", r"\W"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=2, max_size=7), st.lists(st.text("abcA. \0", max_size=14), min_size=4, max_size=4))
def test_a_chain_occurs_wherever_its_pattern_matches(pieces, texts):
    pattern = "".join(pieces)
    chain = anchors.regex_chain(pattern)
    for t in texts:
        if chain and re.search(pattern, t, re.ASCII):
            assert chain[1] in anchors.marked(chain[0], t), (pattern, t, chain)


def test_chains_of_patterns():
    c = anchors.regex_chain
    assert c("of[^A-Za-z]+the[^A-Za-z]+sea") == ("[^A-Za-z]", "of\0the\0sea") and c(r"(?:foo)\s+\bbar{2,3}") == (r"[\s]", "foo\0ba")
    assert c("(?i)a b+c") is None and c("a.*b") is None and c(r"a[^x]+\x00b") is None and c("a[^x]+\0b") is None and c("[a[bc]]x+y") is None


def test_rules_of_common_words_are_tried_where_they_stand_together(spark):
    words = "the of and in a to is it on as".split()
    rng = random.Random(3)
    rules = sorted({"[^A-Za-z]+".join(rng.choices(words, k=4)) for _ in range(400)})
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(50)]
    known = anchors.Anchors([anchors.regex_anchor(r) for r in rules], chains=[anchors.regex_chain(r) for r in rules])
    want = [[i for i, r in enumerate(rules) if re.search(r, t)] for t in texts]
    assert [known.candidates(t) for t in texts] == want and sum(map(len, want)) < 50 * len(rules) / 10
    leaves = [tokens.Leaf(f"r{i}", i, "regex", r, ("generic",)) for i, r in enumerate(rules)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, source string")
    key = lambda df: sorted((r.file_id, r.pattern_no, r.start, r.end, r.matched) for r in df.collect())
    assert key(tokens.match_leaves(files, leaves, language_col=None)) == key(tokens.match_leaves(files, leaves, language_col=None, plain=True))


def test_line_patterns_equal_their_sql_on_odd_lines(spark, tmp_path):
    """A second beginning of the pattern after a comment mark, and a vertical tab, which SQL takes for ink."""
    ends = ["", " x", " x### token = y", " x // token =", " x # tokens", "\x0bx", " x\r# token\t=", " x // a token = "]
    lines = [f"{begin}token {sign}{end}" for begin in ("", "a ", "a # b ", "// ", "  # ", "http://") for sign in ("=", "\t =", "\x0b=") for end in ends]
    lines += [f"{a}under the{x}Apache{x}License{b}" for a in ("", "# ", "a # ") for x in (" ", "\x0b", " \x0b ") for b in ("", " # under the B License")]
    rows = [(k, t) for k, t in enumerate([*lines, "\n".join(lines), "", None])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("line_pattern", "line_captures"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 3, name


@pytest.fixture
def passes(monkeypatch):
    """The functions handed to mapInArrow, in their order; the plans are made as ever."""
    made, plain = [], DataFrame.mapInArrow

    def kept(self, run, *args, **kwargs):
        made.append(run)
        return plain(self, run, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", kept)
    return made


def _batches(run, columns):
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))])))
    assert max(b.num_rows for b in out) <= 4096 and max(b.nbytes for b in out) < 16 << 20
    return sum(b.num_rows for b in out)


def test_many_programs_in_one_batch_leave_in_bounded_parts(spark, passes):
    files = spark.createDataFrame([(1, "javascript", "")], "file_id long, language string, source string")
    text = "v1 = read();\nv2 = clean(v1);\nrun(v2);\n"
    for detail in (False, True):
        syntax.parse(files, detail=detail)
        nodes = _batches(passes.pop(), {"file_id": range(3000), "language": ["javascript"] * 3000, "_text": [text] * 3000})
        assert nodes == 3000 * sum(1 for _ in syntax.tree_rows({}, "javascript", text, False)) and nodes > 20000
        assert _batches_of_one(spark, passes, files, text * 4000, detail) > 20000


def _batches_of_one(spark, passes, files, text, detail):
    syntax.parse(files, detail=detail)
    # the root alone holds the text
    return sum(b.num_rows for b in passes.pop()(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["javascript"]), pa.array([text])], ["file_id", "language", "_text"])])))


def test_matches_of_long_texts_leave_in_bounded_parts(spark, passes):
    files = spark.createDataFrame([(1, "")], "file_id long, source string")
    tokens.match_leaves(files, [tokens.Leaf("r", 0, "simple", "the ... of", ("generic",))], language_col=None)
    # every "the" reaches to the only "of": the matched texts together are far longer than the text
    long = "the " * 4000 + "of"
    assert _batches(passes.pop(), {"_id": [1, 2], "_text": [long, long], "_language": [None, None]}) == 8000


def test_node_matches_leave_in_bounded_parts(spark, passes):
    nodes = syntax.parse(spark.createDataFrame([(1, "javascript", "")], "file_id long, language string, source string"), detail=True)
    passes.clear()
    taint_rules.node_matches(nodes, [("a", 0, "simple", ["run($X)"], ("generic",)), ("b", 1, "simple", ["run(...)"], ("generic",))])
    n = 9000
    assert _batches(passes.pop(), {"file_id": [1] * n, "node_id": range(n), "end": range(n), "text": ["run(v1)"] * n, "language": ["javascript"] * n, "start_line": [1] * n, "end_line": [1] * n}) == 2 * n
