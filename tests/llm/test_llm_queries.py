"""Every query of the subpackage that has SQL against it, and the others for whole results."""

import pytest

from cellweave.llm.workloads import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(matches_sql, name):
    matches_sql(QUERIES[name], ORACLE[name])


def test_queries_without_sql_are_whole(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n = docs.count()
    ids = QUERIES["p8_ids"](spark, SF_DIR)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == n and ids.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
    packed = QUERIES["p9_containers"](spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == n
    assert packed.filter("container_id IS NOT NULL").groupBy("container_id").sum("n_tokens").filter("`sum(n_tokens)` > 2048").isEmpty()
    assert QUERIES["p10_found"](spark, SF_DIR).columns == ["doc_id"]
    assert QUERIES["p1_found"](spark, SF_DIR).columns == ["pattern"]
    judged = QUERIES["p6_surprising"](spark, SF_DIR)
    assert judged.count() == QUERIES["p6_counts"](spark, SF_DIR).count() and judged.filter("log10_p > 0 OR expected <= 0").isEmpty()
    assert QUERIES["p10_report"](spark, SF_DIR).count() > 0
