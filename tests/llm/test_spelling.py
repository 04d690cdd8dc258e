import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import spelling
from lectern.llm.queries import op11_spelling

from .conftest import COLUMNS

FORM = "word string, n long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, shortest=6, fewest=5, slips=199):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if slips and h % slips == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            seen[low] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= fewest}


def plain_variants(found, times=5):
    partners = {w: [] for w in found}
    for a, b in itertools.combinations(found, 2):
        if near(a, b):
            partners[a].append(b)
            partners[b].append(a)
    forms = {}
    for w, some in partners.items():
        best = min(some, key=lambda x: (-found[x], x), default=None)
        forms[w] = best if best is not None and found[best] >= times * found[w] else None
    out = set()
    for w in found:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, found[w], len(partners[w]), found[forms[w]] if forms[w] else None))
    return out


def made(seed, many, letters="eatsé×", least=1, most=9):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(least, most))): r.choice([1, 2, 5, 9, 30, 200, 5000]) for _ in range(many)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("depth, most", [(3, 200_000), (0, 60), (2, 8), (16, 3)])
def test_variants_match_all_pairs(spark, depth, most):
    found = made(depth, 300) | {"x" * 3000: 7, "x" * 2999: 70, "y" + "x" * 2999: 3}
    df = spark.createDataFrame(list(found.items()), FORM).repartition(3)
    assert rows(spelling.variants(df, depth=depth, most=most)) == sorted(plain_variants(found), key=repr)


def test_pairs_of_one_cell_come_once(spark):
    """All words have one vector, so shares of the cell meet each other."""
    found = {"".join(p): 1 for p in itertools.product("mpg", "bhf", "mpg", "eat")}
    pairs = spelling.near_pairs(spark.createDataFrame(list(found.items()), FORM), most=7).select("a", "b").collect()
    assert len({frozenset(p) for p in pairs}) == len(pairs) == sum(near(a, b) for a, b in itertools.combinations(found, 2))


def test_chains_lead_to_the_last_form(spark):
    chain = [("abcdef" + "x" * k, 5**k) for k in range(9)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(chain, FORM)).collect()}
    assert {r["root"] for r in got.values()} == {chain[-1][0]} and got[chain[0][0]]["form"] == chain[1][0] and got[chain[-1][0]]["form"] is None


def test_words_with_slips(spark):
    r = random.Random(5)
    some = ["Kompass", "KOMPASS", "Übermut", "übermut", "straße", "déjàvu", "a×b÷cdef", "short", "ﬁnesse"]
    docs = [(k if k % 7 else None, " ".join(r.choices(some, k=90)) + "\n" + "Z" * 40, "en", "a", 1) for k in range(120)] + [(3, None, None, None, None), (4, "", "en", "a", 0)] + [(9, "twelve " * 7, "en", "a", 1)] * 3
    got = spelling.words(spark.createDataFrame(docs, COLUMNS), slips=7)
    assert dict(map(tuple, got.collect())) == plain_words([d[:2] for d in docs], slips=7)
    assert "twelve" in plain_words([d[:2] for d in docs])


def test_query_matches_all_pairs(spark, tmp_path):
    r = random.Random(1)
    words = ["harvest", "harbour", "Harbor", "lantern", "lanterns", "quietly", "mountain", "Ärmelkanal"]
    docs = [(k, " ".join(r.choices(words, weights=[99, 50, 5, 30, 3, 9, 20, 4], k=200)), "en", "a", 1) for k in range(80)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_spelling(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = plain_variants(plain_words([d[:2] for d in docs]))
    assert rows(got) == sorted(want, key=repr) and any(w[1] for w in want)


def test_odd_rows_and_empty(spark, odd, none):
    assert spelling.variants(spelling.words(none)).count() == 0
    found = spelling.words(odd, fewest=1, slips=199)
    assert dict(map(tuple, found.collect())) == plain_words([(d["doc_id"], d["text"]) for d in odd.collect()], fewest=1)
    assert spelling.variants(found).count() == found.count()
