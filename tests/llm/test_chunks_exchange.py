"""Chunks are dealt by digest once, for their counts and the join."""

from lectern.llm import chunks
from tests.llm.conftest import COLUMNS, prose


def test_the_chunks_are_shuffled_once(spark):
    docs = spark.createDataFrame([(n, prose(60, n % 3), None, None, None) for n in range(6)], COLUMNS)
    found = chunks.repeated_chunks(docs)
    assert found.count() > 0 and [f.name for f in found.schema["first"].dataType] == ["doc_id", "th", "start"]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    by_digest = [x for x in plan.splitlines() if "Exchange hashpartitioning(hi" in x and "REPARTITION" in x and "Reused" not in x]
    assert len(by_digest) == 1, plan
