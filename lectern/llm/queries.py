"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bytebpe, chunks, infill, mixing, packing, pii, quality, simhash, spelling, tokencount, toxicity, urls
from lectern.llm.common import table


#: Wanted shares of the sources: the large first one at a tenth, the others alike.
WEIGHTS = {"src0": 0.1} | {f"src{k}": 0.9 / 19 for k in range(1, 20)}

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.fold("doc_id") == 0
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)), F.sha2(pii.told(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.told(F.col("pii")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", "lang", "text", "copy", "shuffle_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(table(spark, sf_dir, "documents")).drop("th")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).drop("blocked")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), slips=199))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = bytebpe.decode(encoded.select("doc_id", "ids"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("data")).alias("decoded_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50)
    restored = infill.restore(done.drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_toxicity, op4_ann, op5_pii, op6_mixing, op7_simhash, op8_urls, op9_token_counts, op10_substring_dedup, op11_spelling, op12_byte_bpe, op13_infill)}
ORACLE_SQL: dict[str, str] = {"op1_quality": quality.judge_sql(), "op6_mixing": mixing.mix_sql(WEIGHTS), "op13_infill": infill.transform_sql()}
