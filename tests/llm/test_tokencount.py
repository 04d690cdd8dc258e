import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import tokencount
from lectern.llm.tokens import WordIds, public_tokenizer, word_ids
from tests.llm.conftest import COLUMNS, odd_rows


def test_counts_are_the_tokenizers(odd, none):
    t = Tokenizer.from_file(public_tokenizer())
    want = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    for block in (7, 64, 1 << 18):
        got = Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(odd, block=block).collect())
        assert got == want, block
    assert tokencount.token_counts(none).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_scan_of_binary_files(spark, tmp_path, width):
    """Files of several ranges, with ids cut by ranges and blocks; with and without a last byte 10; with a byte-order mark; with a half id at the end."""
    rng = np.random.default_rng(5)
    want = {}
    for f in range(6):
        ids = rng.integers(0, 3000, 40_000 + f).astype(f"<u{width}")
        ids[rng.random(len(ids)) < 0.01] = 9
        if f == 1:
            ids[-1] = 10 << 8 * (width - 1)
        if f == 2:
            ids[:2] = [0xBBEF, 0x00BF] if width == 2 else [0x00BFBBEF, 7]
        if f == 3:
            ids[:2], ids[-1] = ([0xBBEF, 0x00BF] if width == 2 else [0x00BFBBEF, 7]), 10 << 8 * (width - 1)
        if f == 4:
            ids[:20_000] = 0x0A0A if width == 2 else 0x0A0A0A0A
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes() + (b"\x07" if f == 5 else b""))
        at = [-1, *np.flatnonzero(ids == 9)]
        want[f] = [int(b - a - 1) for a, b in zip(at, at[1:])]
        rest = len(ids) - at[-1] - 1
        want[f] += [rest] if rest else []
    (tmp_path / "9.bin").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for block, piece in ((100, "9973"), (5000, "30001"), (1 << 18, old)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        try:
            rows = tokencount.scan(tokencount.read_blocks(spark, str(tmp_path), width, block), end_id=9, width=width).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        got = {}
        for r in sorted(rows, key=lambda r: (r["file"], r["doc"])):
            got.setdefault(int(r["file"].rsplit("/", 1)[1][0]), []).append(r["n_tokens"])
        assert got == want, (block, piece)


def test_ids_that_dont_fit_are_an_error(spark):
    path = public_tokenizer()
    docs = spark.createDataFrame([(1, "some words here", None, None, None)], COLUMNS)
    want = len(Tokenizer.from_file(path).encode("some words here", add_special_tokens=False).ids)
    assert tokencount.scan(tokencount.write_flat(docs, 40_000, tokenizer=path, width=4), 40_000, 4).collect()[0]["n_tokens"] == want
    with pytest.raises(OverflowError):
        tokencount.write_flat(docs, 1 << 20, tokenizer=path, width=2)


def test_a_worker_holds_few_words_and_few_texts(spark, monkeypatch):
    """Of one task on many different words: the ids of how many texts are asked for at once, and what the cache may hold."""
    asked = []
    monkeypatch.setattr(WordIds, "encode_batch", lambda self, texts: asked.append((self.most, len(texts))) or [self.encode(t) for t in texts])
    made = {}
    docs = spark.range(1).selectExpr("id AS doc_id", "'a b' AS text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.setdefault("run", f))
    monkeypatch.setattr(tokencount, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    tokencount.write_flat(docs, width=2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"word{n} and more" for n in range(3000)])], ["doc_id", "text"])
    rows = [r for b in made["run"](iter([batch])) for r in b.to_pylist()]
    assert [d for r in rows for d in r["ids"]] == list(range(3000))
    assert max(n for _, n in asked) <= 300 and max(most for most, _ in asked) <= 150_000
    word_ids.cache_clear()
