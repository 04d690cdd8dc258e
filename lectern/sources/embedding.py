"""Which texts need an embedding, and embedding them in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 64


def to_embed(cards: DataFrame, done: DataFrame, least: int = 20) -> DataFrame:
    """Canonical highlighted cards, the first of each text, without those in done (id, text_hash)."""
    rows = cards.filter(F.col("is_canonical") & F.col("has_highlight") & (F.length(F.trim("body_plain")) >= least)).withColumn("text_hash", F.col("fingerprint"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("text_hash").orderBy("id"))).filter("_n = 1").drop("_n")
    return first.join(done.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def hashing_vectors(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Words hashed to signed dimensions, unit length: a stand-in for a model's vectors."""
    out = np.zeros((len(texts), dims))
    for row, t in zip(out, texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            row[h % dims] += 1 if h >> 63 else -1
        row /= np.linalg.norm(row) or 1.0
    return out.tolist()


def embed(df: DataFrame, column: str, embed_fn: Callable[[list[str]], list[list[float]]] = hashing_vectors, batch: int = BATCH) -> DataFrame:
    """df with embedding; embed_fn gets at most `batch` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[column].fillna("").tolist()
            yield f.assign(embedding=[v for at in range(0, len(texts), batch) for v in embed_fn(texts[at : at + batch])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, embedding array<double>")
