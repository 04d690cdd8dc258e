"""Split words in tags are put together by a table of words, and nothing else is."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.operators import tags

WORDS = ["domain", "belief", "legal", "realistic", "its", "san", "than", "on", "ant", "the", "constitutional", "being", "sees", "threats"]
#: Tags and what they are with those words.
PAIRS = [
    ("1. China will rise", "China will rise"), ("2] Arms race", "Arms race"), ("4--- heg", "Heg"), ("T: Topicality VI", "Topicality VI"), ("* bullet tag", "Bullet tag"), ("d omain", "Domain"), ("b elief system", "Belief system"),
    ("a cat", "A cat"), ("a nt farm", "A nt farm"), ("i ts own", "I ts own"), ("It’s an epistemic constraint", "It’s an epistemic constraint"), ("It's an apple", "It's an apple"), ("l egal framework", "Legal framework"), ("realisti c threat", "Realistic threat"),
    ("Con stitutional crisis", "Con stitutional crisis"), ("heg good --- extinction", "Heg good---extinction"), ("the d omain and the l egal realisti c", "The domain and the legal realistic"), ("(d omain)", "(domain)"), ("d omain2 d\tomain", "D omain2 domain"), ("see s threat s", "Sees threats"),
    ("x yz d omain", "X yz domain"), ("t h an", "T h an"), ("t han d omain d omain", "Than domain domain"), ("realisti c's", "Realisti c's"), ("", ""), (None, None), ("D OMAIN", "DOMAIN"), ("be a ing d omaine", "Be a ing d omaine"), ("2.", "2."),
]


@pytest.fixture
def cards(spark):
    return spark.createDataFrame([(n % 20 or None, tag, "kept") for n, (tag, _) in enumerate(PAIRS)], "id int, tag string, place string")


@pytest.mark.parametrize("small", [500_000, 3])
def test_split_words(spark, cards, monkeypatch, small):
    monkeypatch.setattr(tags, "SMALL", small)
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = tags.normalised(cards, words)
    assert got.columns == ["id", "tag", "place", "normal_tag"]
    assert sorted(((r["tag"], r["normal_tag"]) for r in got.collect()), key=repr) == sorted(PAIRS, key=repr)


def test_repeated_rows_and_no_words(spark, cards):
    words = spark.createDataFrame([(w,) for w in WORDS * 2], "word string")
    twice = cards.unionByName(cards)
    assert tags.normalised(twice, words).count() == 2 * len(PAIRS)
    none = words.limit(0)
    plain = [tuple(r) for r in cards.select("id", "tag", labels.normal_tag(F.col("tag"))).collect()]
    for w in (none, None):
        assert sorted((tuple(r) for r in tags.normalised(cards, w).select("id", "tag", "normal_tag").collect()), key=repr) == sorted(plain, key=repr)
    assert tags.normalised(cards.limit(0), words).count() == 0


def test_changes_and_renormalised(spark):
    c = spark.createDataFrame([(1, "d omain", "x"), (2, "Plain", "y"), (3, None, "z"), (4, "", "w")], "id int, tag string, other string")
    words = spark.createDataFrame([("domain",)], "word string")
    assert [tuple(r) for r in tags.changes(c, words).collect()] == [(1, "d omain", "Domain")]
    assert {tuple(r) for r in tags.renormalised(c, words).collect()} == {(1, "Domain", "x"), (2, "Plain", "y"), (3, None, "z"), (4, "", "w")}


def test_vocabulary(spark):
    docs = spark.createDataFrame([("Cat cat a CAT élan dog",), ("dog",), (None,)], "text string")
    assert {r["word"] for r in tags.vocabulary(docs, "text", 2).collect()} == {"cat", "dog"}


def test_second_pass(spark):
    """One card is told by the first classifier, one by the second, and one by none."""
    from lectern.sources import classify

    def first(f):
        return f.assign(types=[[" K", "odd"] if "one" in t else ["what"] for t in f["tag"]], topics=[["AI War", "x"]] * len(f))

    def second(f):
        assert not f["tag"].str.contains("one").any()
        return f.assign(types=[["policy"] if "two" in t else [] for t in f["tag"]], topics=[["nfu"]] * len(f))

    cards = spark.createDataFrame(
        [(i, t, "b", '["none"]', "[]", "Old", "Old", None) for i, t in (("a", "one"), ("b", "two"), ("c", "three"))] + [("d", "new", "b", "[]", "[]", "Kept", "Kept", None)],
        "id string, tag string, body_plain string, argument_types string, argument_tags string, type_label string, topic_label string, topic_bucket string",
    )
    told = classify.in_passes(cards.filter("id <> 'd'"), [first, second])
    got = {r["id"]: (r["argument_types"], r["argument_tags"], r["type_label"], r["topic_label"]) for r in classify.reclassified(cards, told).collect()}
    assert got == {"a": ('["k"]', '["ai war","x"]', "K", "AI War"), "b": ('["policy"]', '["nfu"]', "Policy", "NFU"), "c": ('["none"]', '["ai war","x"]', "", "AI War"), "d": ("[]", "[]", "Kept", "Kept")}
    assert classify.in_passes(cards.limit(0), [first, second]).count() == 0


def test_all_latin_letters_fold(spark):
    import unicodedata

    from lectern.operators import search

    pairs = []
    for c in map(chr, range(0xC0, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if unicodedata.name(c, "").startswith("LATIN") and len(plain) == 1 and plain.isascii():
            pairs.append((c, plain.lower()))
    rows = spark.createDataFrame([(a, unicodedata.normalize("NFD", a), b) for a, b in pairs], "letter string, apart string, plain string")
    bad = rows.filter((search.fold(F.col("letter")) != F.col("plain")) | (search.fold(F.col("apart")) != F.col("plain"))).collect()
    assert len(pairs) > 400 and not bad
    assert search.query_terms("Ga\u0308rten CAFÉ Łódź", 1) == ["garten", "cafe", "łodz"]


def test_capitals_are_one_code_point(spark):
    rows = spark.createDataFrame([("ßheit gut",), ("ŉa",), ("éa",), ("ﬁn",), ("",), ("a",)], "t string")
    assert [r[0] for r in rows.select(labels.normal_tag(F.col("t"))).collect()] == ["ẞheit gut", "ŉa", "Éa", "ﬁn", "", "A"]


def test_mending_alone_leaves_the_ends(spark):
    rows = spark.createDataFrame([("1", "a "), ("2", "d omain x"), ("3", ""), ("4", None)], "id string, tag string")
    words = spark.createDataFrame([("domain",)], "word string")
    assert dict(map(tuple, tags.normalised(rows, words, tidy=False).select("id", "normal_tag").collect())) == {"1": "A ", "2": "Domain x", "3": "", "4": None}
    assert dict(map(tuple, tags.normalised(rows, words).select("id", "normal_tag").collect()))["1"] == "A"
    assert {r["id"]: r["after"] for r in tags.changes(rows, words, tidy=False).collect()} == {"1": "A ", "2": "Domain x"}
    assert dict(map(tuple, tags.renormalised(rows, words, tidy=False).collect())) == {"1": "A ", "2": "Domain x", "3": "", "4": None}
