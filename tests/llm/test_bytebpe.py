import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import bytebpe
from lectern.llm.queries import op12_byte_bpe

from .conftest import COLUMNS, prose

ODD = [
    "", " ", "  ", "\n", " \n", "\n \n", "a", " a", "a ", "a  b", "a   b ", "a\n b", "a\n  b", "x\n \nb", "a \nb", "\t a\t\tb  \t", "a b  c", "it's they'LL we're I'm'd 'tis", "12 345abc6", "¿qué?  —¡no!…", "日本語 テキスト", "🙂🙂 👩‍👩‍👧 é\u0085 x\u0085y", "\x1c\x1d a\x1fb", "  a b",
    "<|endoftext|> a<|endoftext|>", "x" * 3000, " " * 500 + "a" + " " * 500, "é" * 700, "aaaa" * 99 + " " + "-=" * 300, "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    alphabet = "aaabestz  \n\t''’sdé日🙂19.,-_  \u0085" + chr(0x301)
    return ODD + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(3000)]


def bpe():
    return bytebpe.byte_bpe(public_tokenizers.path(bytebpe.RANKS))


def test_ids_are_those_of_the_ranks(plain):
    some = texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe().encode_batch(some)] == plain.encode_ordinary_batch(some)


def test_long_texts_are_cut_without_a_trace(plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "STEP", 700)
    small = bytebpe.ByteBpe(public_tokenizers.path(bytebpe.RANKS), most=500, longest=9)
    some = [prose(4000, 1), "\n ".join(texts()), "x" * 5000, None, "  " + prose(900, 2) + "  "]
    got = small.encode_batch(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode_ordinary(t or "") for t in some]
    assert len(small.known) <= 500 + 700 and max(map(len, small.known)) <= 9


def test_offsets_are_the_characters_of_each_id():
    for text in texts():
        e = bpe().tokenizer.encode(text, add_special_tokens=False)
        starts, ends = bpe().offsets(text, np.array(e.ids, "<u4"))
        assert list(zip(starts.tolist(), ends.tolist())) == e.offsets


def test_round_trip_with_offsets_and_other_columns(spark, odd, none):
    done = bytebpe.encode(odd.withColumn("ids", odd["n_chars"]), offsets=True)
    assert done.columns == [*odd.columns, "ids", "starts", "ends"]
    back = bytebpe.decode(done.withColumnRenamed("text", "was"))
    for r in back.collect():
        assert r["text"] == (r["was"] or "") and r["data"].decode() == r["text"] and len(r["starts"]) == len(r["ends"]) == len(r["ids"]) and r["key"] == "clash"
    assert back.count() == odd.count()
    assert bytebpe.decode(bytebpe.encode(none, offsets=True)).count() == 0


def test_decoding_of_odd_ids(spark):
    smile = np.frombuffer(bpe().encode_batch(["a🙂"])[0], "<u4").tolist()
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 64, -1, 10**9]), (4, smile[:2]), (5, smile)], "k int, ids array<int>")
    got = {r["k"]: r for r in bytebpe.decode(df).collect()}
    assert [got[k]["text"] for k in range(1, 6)] == ["", "", "�a��", "a�", "a🙂"]
    assert got[4]["data"] == "a🙂".encode()[: len(got[4]["data"])]


def test_parts_join_to_the_text(spark):
    """Ids cut anywhere: a split character goes to the part with its last byte."""
    r, rows = random.Random(4), []
    for k, text in enumerate(["日本語🙂 naïve — café", "🙂" * 9, "", "plain"]):
        ids = np.frombuffer(bpe().encode_batch([text])[0], "<u4").tolist()
        cuts = sorted(r.choices(range(len(ids) + 1), k=4))
        rows.append((text, [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]))
    rows.append(("", None))
    for row in bytebpe.decode_parts(spark.createDataFrame(rows, "whole string, parts array<array<int>>")).collect():
        assert "".join(row["texts"] or []) == row["whole"] and "�" not in row["whole"]
        assert row["parts"] is None or len(row["texts"]) == len(row["parts"])


def test_query_matches_the_ranks(spark, tmp_path, plain):
    docs = [(k, t, "en", "a", 1) for k, t in enumerate(ODD)] + [(None, "a b", None, None, None), (7, None, "en", "a", 0), (7, None, "en", "a", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_byte_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc, text, *_ in docs:
        ids = plain.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
