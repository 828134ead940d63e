"""normalize_sql keeps every document, those its SQL leaves out too."""

import pandas as pd

from rulelake import catalog


def test_normalize_sql_keeps_every_document(spark, tmp_path):
    texts = ["select #{id}  from ${table};", "a\n\tb", None, "", "#{x", "y" * 2_000_001]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = dict(catalog.normalize_sql(spark, str(tmp_path)).select("doc_id", "sql").collect())
    assert got == {0: "select 1 from T0;", 1: "a b;", 2: None, 3: ";", 4: "#{x;", 5: "y" * 2_000_001 + ";"}
