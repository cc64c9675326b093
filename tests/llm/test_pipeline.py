"""The pipeline stage by stage against plain versions, and the queries with SQL against DuckDB."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import credentials, prefix_bpe, quality, queries, training_order
from tests.compare import difference, duck, spark_result, sql_result
from tests.llm.test_documents import ASSIGN, bag

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_with_sql(spark, name):
    assert difference(spark_result(queries.queries()[name](spark, SF_DIR)), sql_result(duck(SF_DIR), queries.oracle_sql()[name])[0]) is None


def test_run_is_what_plain_stages_give(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}
    rows = [r for r in sorted(docs.collect(), key=lambda r: r.doc_id) if verdict[r.doc_id]]
    bags, parent = [bag(r.text) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    items = [set(bag(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    encode, want = training_order._encoding(prefix_bpe.public_tokenizers.path(prefix_bpe.VOCABULARY)).encode_ordinary, {}
    for i, r in enumerate(rows):
        if root(i) == i and not any(x and len(x & set(bags[i])) >= 0.8 * len(x) for x in items):
            text = credentials.redacted(r.text, credentials.all_spans(r.text)[1])
            assert not any(len(m[2]) >= 12 for m in ASSIGN.finditer(text)) and not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", text)
            ids = encode(text)
            want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs.where("false"), SF_DIR)
        assert found.columns == docs.columns and found.count() == 0
