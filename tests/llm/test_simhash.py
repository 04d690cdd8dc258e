import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import written
from tests.llm.conftest import COLUMNS, odd_rows, prose


def brute_fingerprint(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = [x for x in w.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd):
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.with_fingerprints(odd).collect()}
    assert got == {(r[0], brute_fingerprint(r[1])) for r in odd_rows()}


def test_near_duplicates_against_all_pairs(spark):
    base = prose(400, 5).split()
    rows = [(n, " ".join(base[:n] + ["changed"] + base[n + 1 :]), None, None, None) for n in range(60)] + [(n + 100, prose(50, n), None, None, None) for n in range(40)] + [(200, rows_text, None, None, None) for rows_text in [" ".join(base)] * 3]
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps)
    ids = [r[0] for r in rows]
    smallest = {}
    for i, c in enumerate(comp):
        smallest[c] = min(smallest.get(c, ids[i]), ids[i])
    assert got == {ids[i]: (fps[i] - (1 << 64 if fps[i] >> 63 else 0), smallest[comp[i]]) for i in range(len(rows))}


def test_crowded_buckets_lose_no_link(spark):
    fps = [0x123456789ABCDEF0 ^ (1 << i) ^ (1 << j) for i in range(0, 24) for j in range(i)] + [5, 7, -1, -3]
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")

    def components(crowded):
        return {(r["v"], r["label"]) for r in simhash.smallest_labels(simhash.links(df, crowded)).collect()}

    assert components(3) == components(10_000)


def test_variants_are_not_broadcast(spark, monkeypatch):
    """They are 64 times as many rows as what their size is told from."""
    plans = []
    monkeypatch.setattr(simhash, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, label))
    found = simhash.links(spark.createDataFrame([(5,), (7,), (1 << 40,)], "fp long"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert [tuple(r) for r in found.collect()] == [(5, 7)]


def test_odd_input(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    zero = {r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {3}  # blank and null texts are linked with each other
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted({r["component_id"] for r in rows if r["component_id"] is not None})
    assert kept.filter(F.col("doc_id").isNull()).count() == 2


def jaccard(x, y, width=5):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(width)))) for t in (x, y))
    return len(a & b) / len(a | b)


def changed(text, rate, rng):
    return " ".join(prose(1, rng.randrange(1 << 30)) if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize("partitions", [1, 3, 5])
def test_a_text_is_kept_though_its_id_has_another_one_too(spark, partitions):
    a, b = prose(50, 31), prose(50, 32)
    rows = [(1, a, "en", "x", 1), (7, a, "en", "x", 1), (7, b, "en", "x", 1), (7, b, "en", "x", 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, COLUMNS).repartition(partitions)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (7, b)]


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [prose(n, 1000 + k) for k, n in enumerate([120, 300, 60, 200, 400])]
    texts = [*texts, *(changed(t, rng.uniform(0.002, 0.03), rng) for t in texts for _ in range(24)), *(prose(150, 5000 + k) for k in range(60)), "one two", "One  two", "three"]
    rows = [(n, t, None, None, None) for n, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    similar = [(i, j) for i, j in combinations(range(len(texts) - 3), 2) if jaccard(texts[i], texts[j]) >= 0.8] + [(len(texts) - 3, len(texts) - 2)]
    for i, j in similar:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    docs, first = spark.createDataFrame(rows, COLUMNS), None
    for partitions, rounds in ((3, 2), (1, 0)):
        got = {r["doc_id"] for r in simhash.keep_first(docs.repartition(partitions), rounds=rounds).select("doc_id").collect()}
        assert want <= got and len(got - want) <= 0.05 * (len(texts) - len(want)), (len(want), len(got))
        first = first or got
        assert got == first  # whatever the partitions, and however much was linked before the prefix filter


def test_prefixes_meet_few_pairs_that_are_not_similar(spark):
    """Texts of a large group that are nearly similar: all similar pairs meet, of the others few."""
    rng = random.Random(7)
    sets = {v: set(range(85)) | set(rng.sample(range(100, 2100), 15)) for v in range(120)}
    for v in range(0, 120, 10):
        sets[v + 1] = sets[v] - set(rng.sample(sorted(sets[v]), 6))
    all_pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
    similar = {p for p, j in all_pairs.items() if j >= 0.8}
    held = spark.createDataFrame([(v, v) for v in sets], "v long, label long")
    shingles = spark.createDataFrame([(v, sorted(s)) for v, s in sets.items()], "v long, s array<long>")
    found = spark.createDataFrame([(v, [0]) for v in sets], "v long, fp array<long>")
    met = [(r["a"], r["b"]) for r in simhash._met_by_prefix(held, shingles, found, 0.8).collect()]
    assert len(met) == len(set(met)) and similar <= set(met)
    assert 12 <= len(similar) and len(met) <= len(all_pairs) // 4, (len(met), len(similar), len(all_pairs))
