"""Tags by keyword rules: a text is asked for all of them at once, and fits what it fits rule by rule."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import argument_tags as A
from lectern.plans.all_queries import ORACLE_SQL

RULES = {"econ da": A.ECONOMY, **{label: p for label, _, p in A.RULES}}


def examples(pattern: str) -> list[str]:
    """A text for each of the pattern's alternatives."""
    parts = re.split(r"\|(?![^(]*\))", pattern)
    plain = lambda p: re.sub(r"\\b", "", re.sub(r"\.\*", " x ", re.sub(r".\?|\[.*?\]\?", "", re.sub(r"\((\w+)[^)]*\)\??", r"\1", re.sub(r"\.\?", "-", re.sub(r"\\\.", "\0", p)))))).replace(".", "-").replace("\0", ".")
    return [plain(p) for p in parts]


@pytest.fixture(scope="module")
def texts():
    found = [x for p in (*RULES.values(), A.ECONOMY_BODY, A.NAMES_DISAD) for x in examples(p)]
    odd = [None, "", " ", "GDP", "the disad: x" + " y" * 40 + " recession", "capitalism neoliberal", "neoliberal", "neoliberals", "xai ai", "_ai", "éai", "no\nfirst\nuse", "no\rfirst use", "states' cp", "states x\ncp", "\bAI ", "a priori" * 30, "Cap K"]
    return found + [x + "s" for x in found] + ["x" + x for x in found] + [f"{x.upper()}, {y}" for x, y in zip(found, found[7:])] + [f"{'word ' * 30}{x}" for x in found] + odd


def test_every_alternative_has_an_example(texts):
    assert [k for k, p in RULES.items() if not any(re.search(p, x) for x in examples(p))] == []


def test_tags_are_those_of_the_sql(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["tags"] for r in docs.repartition(3).select("doc_id", F.array_join(A.argument_tags(F.substring("text", 1, 60), F.col("text")), ",").alias("tags")).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = dict(duck.execute(ORACLE_SQL["lbl_04_argument_tags"]).fetchall())
    assert {i: (texts[i], got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert {label for tags in got.values() for label in tags.split(",")} >= set(RULES)


def test_a_text_is_prepared_once_for_all_rules(spark):
    plan = spark.range(1).select(A.argument_tags(F.lit("x"), F.col("id").cast("string")).alias("tags"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("lower(") <= 2 and "RLIKE" not in plan
