"""The pipeline's stages on a small corpus, each on what its predecessor kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm.common import written
from lectern.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import COLUMNS, prose
from tests.llm.test_toxicity import corpus


def test_stages(spark, tmp_path):
    docs, labels = corpus(300)
    docs = [(i, t, lang, f"src{i % 20}", len(t)) for i, t, lang, _, _ in docs]
    docs += [(1000 + k, docs[7][1], "en", "src1", 1) for k in range(5)] + [(2000, f"{prose(40, 5000)} mail bob.1@mail.example.com or +1 (988) 555-2485 {prose(10, 5001)}", "en", "src2", 1), (2001, None, None, None, None)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("copy", "shuffle_key", "toxicity", "base", "pii", "fp", "component_id"):
        d = d.withColumn(name, F.lit("own"))
    columns, kept = d.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        d = written(stage(spark, d, str(tmp_path)), name)
        assert n == len(corpus_pipeline.STAGES) - 1 or d.columns == columns
        kept[name] = d.toPandas()
        assert n == len(corpus_pipeline.STAGES) - 1 or (kept[name]["toxicity"] == "own").all() and (kept[name]["pii"] == "own").all()
    toxic = {i for i, _, t in labels if t}
    left = set(kept["toxicity"]["doc_id"])
    assert not toxic & left and len(left) == len(docs) - len(toxic)
    once = kept["simhash_near_dedup"]
    assert set(range(1000, 1005)) & set(once["doc_id"]) == set() and 7 in set(once["doc_id"]) and once["doc_id"].is_unique
    text = kept["pii"].set_index("doc_id").loc[2000, "text"]
    assert "<EMAIL>" in text and "<PHONE>" in text and not re.search("@|555", text)
    assert kept["pii"].set_index("doc_id").loc[2000, "n_chars"] == len(text)
    assert set(kept["mixing"]["doc_id"]) <= set(once["doc_id"])
    packed = kept["packing"]
    assert len(packed) == len(kept["mixing"]) and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
