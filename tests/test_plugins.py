"""The table function and the archive format of Spark SQL."""

import io
import tarfile
import zipfile

import pytest

from rulelake.operators import syntax
from rulelake.sources import files as src
from rulelake.sources import plugins


def test_parse_code_in_sql(spark):
    plugins.register(spark, {"lines": lambda text: [(0, len(text.split("\n")), None, 0, 0, "program", text, 1, 1)] + [(i + 1, i, 0, i, 1, "line", t, i + 1, i + 1) for i, t in enumerate(text.split("\n"))]})
    files = src.inline(spark, [("javascript", "function f(x) { return g(x, 1) }\nf(2)"), ("python", "def f(a):\n    return a\nf(1)"), ("lines", "a\nb"), ("bash", "x=1")])
    files.createOrReplaceTempView("files_to_parse")
    key = lambda df, cols: sorted(map(str, df.select("file_id", *cols).collect()))
    plain = [f.split()[0] for f in syntax.NODE_FIELDS.split(", ")]
    got = spark.sql("select f.file_id, n.* from files_to_parse f, lateral parse_code(f.language, f.source) n where f.language != 'lines'")
    assert key(got, plain) == key(syntax.parse(files.where("language != 'lines'")), plain)
    more = spark.sql("select f.file_id, n.* from files_to_parse f, lateral parse_code(f.language, f.source, true) n where f.language != 'lines'")
    every = [*plain, "language", "scope", "arg"]
    assert key(more, every) == key(syntax.parse(files.where("language != 'lines'"), detail=True), every)
    assert [r.text for r in spark.sql("select n.text from files_to_parse f, lateral parse_code(f.language, f.source) n where n.node_type = 'line' order by 1").collect()] == ["a", "b"]
    assert spark.sql("select * from parse_code('python', cast(null as string))").count() == 0
    with pytest.raises(Exception, match="source is a text"):
        spark.sql("select * from parse_code('python', 1)").collect()


def test_archives_in_sql(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"src/F{i}.java", f"class F{i} {{}}")
        z.writestr("empty/", "")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name in ("x.py", "y.py"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"a=1"))
    plugins.register(spark)
    both = f"{tmp_path}/a.zip, file://{tmp_path}/b.tar.gz"
    table = spark.read.format("archive").load(both)
    want = sorted((r.path, bytes(r.content)) for r in src.archives(spark, [str(tmp_path)]).collect())
    assert sorted((r.path, bytes(r.content)) for r in table.collect()) == want and len(want) == 7
    assert table.rdd.getNumPartitions() == 6  # a member of the zip each, and the tar
    spark.sql(f"create temporary view members using archive options (path '{tmp_path}/a.zip')")
    assert spark.sql("select count(*) from members where path like 'src/%' and decode(content, 'UTF-8') like 'class%'").first()[0] == 5
