import random
from collections import defaultdict

from lectern.llm import chunks
from tests.llm.conftest import COLUMNS, prose


def test_boundaries_cover_and_move_with_the_content():
    data = prose(2000, 1).encode()
    ends = chunks.boundaries(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends)) <= 512
    moved = chunks.boundaries(data[:100] + b"an insertion" + data[100:])
    same = {e + 12 for e in ends if e > 300} & set(moved)
    assert len(same) >= 0.95 * sum(e > 300 for e in ends)
    assert chunks.boundaries(b"") == [] and chunks.boundaries(b"ab") == [2]
    assert chunks.boundaries(b"a" * 2000)[-1] == 2000


def test_gear_hash_is_the_rolling_one():
    data = prose(30, 2).encode()
    h, want = 0, []
    for n, b in enumerate(data):
        h = (2 * h + int(chunks.GEAR[b])) & 0xFFFF
        want.append(h)
    cuts = [n + 1 for n, h in enumerate(want) if h >> 11 == 0]
    at, ends = 0, []
    for c in cuts:
        if c - at >= 16:
            at = c
            ends.append(c)
    if at < len(data):
        ends.append(len(data))
    assert chunks.boundaries(data) == ends


def test_shared_passages_are_found_and_clean_documents_left_alone(spark):
    passage = prose(55, 77)
    rows = [(n, f"{prose(40 + n, n)} {passage} {prose(30, 200 + n)}", None, None, None) for n in range(5)] + [(100 + n, prose(120, 300 + n), None, None, None) for n in range(20)]
    got = {r["doc_id"]: r for r in chunks.repeats(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(got) == set(range(5))
    assert got[0]["n_removed"] == 0 and all(got[n]["n_removed"] > 0 and got[n]["first_docs"] == [0] for n in range(1, 5))
    for doc, text, *_ in rows[:5]:
        for p in got[doc]["passages"]:
            assert text.encode()[p["start"] : p["stop"]].decode() == passage


def test_passages_against_all_sequences_of_words(spark):
    """The documents that share 51 words in a row with another place, and no document that shares 50."""
    rng, rows = random.Random(3), []
    for k in range(160):
        n = rng.choice([20, 35, 45, 50, 51, 52, 55, 60, 80, 200])
        passage = prose(n, 9000 + k)
        rows += [(len(rows) + j, f"{prose(rng.randrange(3, 40), 100_000 + 10 * k + j)} {passage} {prose(rng.randrange(3, 40), 200_000 + 10 * k + j)}", None, None, None) for j in range(rng.choice([2, 2, 3]))]
    rows += [(5000, f"{(p := prose(70, 1))} {prose(30, 2)} {p}", None, None, None), (5001, prose(300, 3), None, None, None)]
    places = defaultdict(set)
    for doc, text, *_ in rows:
        w = text.split()
        for i in range(len(w) - 50):
            places[tuple(w[i : i + 51])].add((doc, i))
    want = {doc for at in places.values() if len(at) > 1 for doc, _ in at}
    text = {r[0]: r[1].encode() for r in rows}
    got = {r["doc_id"]: r for r in chunks.repeats(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(got) <= want and len(want - set(got)) <= 0.01 * len(want), (len(want), sorted(want - set(got)))
    for doc, r in got.items():
        assert r["n_passages"] == len(r["passages"]) and all(len(text[doc][p["start"] : p["stop"]].split()) >= 51 for p in r["passages"])
        others = [t for d, t in text.items() if d != doc]
        if doc != 5000:
            assert all(any(text[doc][p["start"] : p["stop"]] in t for t in others) for p in r["passages"])
        assert (r["n_removed"] == 0) == (r["first_docs"] == [doc]) or doc == 5000
        assert r["removed_bytes"] <= sum(p["stop"] - p["start"] for p in r["passages"])


def test_words_in_common():
    assert chunks.in_common(b"a bcd ef", b"xx bcd ef", 0) == (2, 6) and chunks.in_common(b"bcd ef", b"bcd eff", 1) == (1, 3)
    assert chunks.in_common(b"", b"a", 0) == (0, 0) and chunks.in_common(b"abc", b"zabc", 0) == (0, 0) and chunks.in_common(b"ab c", b"ab c", 1) == (2, 4)
    data = prose(500, 4).encode()
    assert len(chunks.around(data, len(data), 0, 51).split()) == 51 and len(chunks.around(data, 0, 1, 51).split()) == 51 and chunks.around(data, 0, 0, 5) == b""
    assert chunks.around(b"x" * 5000 + b" y", 5002, 0, 1) == b"y" and chunks.around(b"x" * 5000 + b" y", 5002, 0, 2) == b"x" * 5000 + b" y"


def test_odd_input(odd, none):
    got = chunks.repeats(odd).collect()
    assert {r["doc_id"] for r in got} >= {1, 2, 7}
    assert 3 not in {r["doc_id"] for r in got}
    assert chunks.repeats(none).count() == 0
