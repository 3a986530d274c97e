import pytest

from shirabe.llm import queries
from tests.oracle import DIR, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert same(spark, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.01") > 0  # the smallest tables hold no secret


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_covers_its_whole_table(spark, name):
    rows = queries.QUERIES[name](spark, DIR).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    if name in ("op3_toxicity", "op5_byte_bpe", "op6_telephony_audio", "op9_document_fingerprints", "op10_token_counts"):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    elif name == "op7_chat_prefix_tree":
        convs = spark.read.parquet(f"{DIR}/conversations.parquet")
        assert sorted(c for r in rows for c in r.ends) == sorted(r.conv_id for r in convs.select("conv_id").distinct().collect())
    else:
        assert rows and {r.doc_id for r in rows} <= docs
