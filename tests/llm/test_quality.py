from collections import Counter, defaultdict

import pytest

from lectern.llm import quality
from tests.llm.conftest import COLUMNS, odd_rows, prose

WS = " \t\n\x0b\x0c\r"


def split(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    w = split(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if split(x)]
    n_rep = len(hit)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n_rep, len(w) < 10 or 100 * n_rep > 20 * len(w))


def test_base_counts(spark, odd):
    extra = ["a b c d e f a b c d e f a b c d e", "line one\nline one\n \nline two\nline one", "x # * $ % & | < > y", "a b c d e " * 40, "one two three four five six seven eight nine ten", "a b c d e a b c d e z"]
    rows = [*odd_rows(), *((1000 + n, t, "en", "a", 1) for n, t in enumerate(extra))]
    got = quality.measures(spark.createDataFrame(rows, COLUMNS)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)


def test_frequent_lines_and_depletion(spark):
    banner = "Subscribe to our 24 letters and read on every day of the year"
    rows = [(n, f"{banner}\n{prose(30, n)}", "en", "a", 1) for n in range(12)] + [(50 + n, f"{banner}\nshort own text {n} here", "en", "a", 1) for n in range(3)] + [(100 + n, f"{banner}\n{prose(30, 60 + n)}", "en", "b", 1) for n in range(4)] + [(200, prose(40, 99), "en", "a", 1)] * 30
    got = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, COLUMNS)).collect()}
    n = len(banner.split())
    assert all(got[k] == (n, True) for k in range(12))
    assert all(got[50 + k] == (n, False) for k in range(3))  # little is left
    assert all(got[100 + k] == (0, True) for k in range(4))  # too few documents of host b
    assert got[200] == (0, True)  # copies are one document
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(cleaned) == {k for k, (_, kept) in got.items() if kept}
    assert all(cleaned[n] == prose(30, n) for n in range(12)) and all(cleaned[r[0]] == r[1] for r in rows if 100 <= r[0] < 104)


def test_a_line_of_many_documents_goes_from_a_host_of_any_size(spark):
    rows = [(n, f"{prose(20, n)}\n{'the same words at the end' if n < 30 else prose(5, 9000 + n)}", "en", "a", 1) for n in range(400)]
    docs = spark.createDataFrame(rows, COLUMNS)
    removed = lambda **limits: {r["doc_id"] for r in quality.judge(docs, **limits).filter("n_removed_words > 0").collect()}
    assert removed(min_share=0.5) == set() and removed(min_share=0.5, most_docs=30) == set(range(30)) and removed() == set(range(30))


def test_odd_input(odd, none):
    rows = quality.judge(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd_rows())
    assert all(not r["kept"] for r in rows if r["n_words"] < 10)
    assert quality.judge(none).count() == 0 and quality.clean(none).count() == 0
    assert quality.clean(odd).columns == odd.columns and quality.clean(odd).count() == sum(r["kept"] for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(tuple(r))
    assert len(by[2]) == 1 and len(by[7]) == 2


def test_copies_count_each_or_once(spark):
    copies = [(n, prose(40, 7), "en", "a", 1) for n in range(12)]
    rows = [*copies, (None, prose(40, 7), "en", "a", 1), *((100 + n, prose(40, 100 + n), "en", None if n % 2 else "a", 1) for n in range(20))]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = lambda **limits: Counter(r["doc_id"] for r in quality.judge(docs, **limits).filter("kept").collect())
    assert kept() == Counter(r[0] for r in rows if (r[0] or 0) >= 100)
    assert kept(copies="once") == Counter(r[0] for r in rows)
    assert kept(min_docs=14) == Counter(r[0] for r in rows)  # 13 documents, the one without an id among them
    with pytest.raises(ValueError):
        quality.judge(docs, copies="twice")
