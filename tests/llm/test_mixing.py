import hashlib
import math
from collections import Counter

import pytest

from lectern.llm import mixing
from tests.llm.conftest import COLUMNS, odd_rows


def brute_copies(doc_id, rate, seed="mix-1"):
    parts = max(1, math.ceil(rate / mixing.PART))
    return sum(brute_part(f"{doc_id}/{k}" if k else doc_id, rate / parts, seed) for k in range(parts))


def brute_part(name, rate, seed):
    u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) / 2**52
    n, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        n += 1
        term *= rate / n
        total += term
    return n


def test_copies_follow_the_inverse_distribution(spark):
    rows = [(n, f"t{n}", "en", "big" if n % 3 else "small", 1) for n in range(3000)]
    weights = {"big": 0.25, "small": 0.75}
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got = mixing.mix(docs, weights).collect()
    rate = {"big": 3000 * 0.25 / 2000, "small": 3000 * 0.75 / 1000}
    want = {r[0]: brute_copies(r[0], rate[r[3]]) for r in rows}
    assert Counter(r["doc_id"] for r in got) == Counter({k: n for k, n in want.items() if n})
    assert all(sorted(r["copy"] for r in got if r["doc_id"] == k) == list(range(want[k])) for k in list(want)[:50])
    share = sum(r["source"] == "small" for r in got) / len(got)
    assert abs(share - 0.75) < 0.03 and len({r["shuffle_key"] for r in got}) == len(got)


def test_a_small_source_with_a_large_weight(spark):
    rows = [(n, f"t{n}", "en", "few" if n % 100 == 0 else "many", 1) for n in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, COLUMNS).repartition(3), {"few": 0.9, "many": 0.1}, rows=4000).collect()
    want = {n: brute_copies(n, 4000 * 0.9 / 20) for n in range(0, 2000, 100)}  # 180 copies each
    assert Counter(r["doc_id"] for r in got if r["source"] == "few") == want
    assert abs(sum(want.values()) - 3600) < 4 * 60 and len({r["shuffle_key"] for r in got}) == len(got)


def test_odd_input(odd, none):
    out = mixing.mix(odd, {"a": 1.0, "missing": 3.0})
    assert out.columns[:5] == odd.columns[:5]
    others = Counter(r["doc_id"] for r in out.collect() if r["source"] != "a")
    assert others == Counter(r[0] for r in odd_rows() if r[3] != "a")  # once each
    assert mixing.mix(none, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": -1.0})
    with pytest.raises(ValueError):
        mixing.thresholds(1000.0)
