"""Keyword rules with their word boundaries asked for last."""

import itertools
import re

from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.functions.text import js


def test_boundaries_last_match_the_same_texts():
    parts = ["cp", "cap k", "shell", "shells", "plan", "pics", "foo", "_", "9", "é", "-", " ", "a priori"]
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(parts, repeat=n)]
    for pattern in (*(p for _, p in labels.TYPE_RULES), r"\bfoo*\b", r"\bfo+\s\b", r"\b(cp|plan)\b", r"-\b"):
        one, two = re.compile(js(pattern)), re.compile(labels.boundaries_last(pattern))
        assert all(bool(one.search(t)) == bool(two.search(t)) for t in texts), pattern
    assert labels.boundaries_last(r"\bplan\b").startswith("plan")


def test_a_text_is_prepared_once(spark):
    rows = spark.createDataFrame([("the Plan has a BRINK",), ("planet",), (None,)], "t string")
    column = labels.argument_types(F.col("t"))
    assert [r[0] for r in rows.select(column).collect()] == [["da", "policy"], ["none"], ["none"]]
    assert rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
