import zlib

import numpy as np

from lectern.llm import toxicity
from tests.llm.conftest import COLUMNS, odd_rows, prose


def brute_segments(scores, gap):
    """All maximal segments by their definition: take the best one, then what lies to its left and right."""
    s = [x if x else -gap for x in scores]

    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            t = 0
            for b in range(a, hi):
                t += s[b]
                if t > 1e-12 and (top is None or t > top[2] + 1e-12 or abs(t - top[2]) <= 1e-12 and b - a < top[1] - top[0]):
                    top = (a, b, t)
        if top is None:
            return []
        return best(lo, top[0]) + [top] + best(top[1] + 1, hi)

    return best(0, len(s))


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = np.where(rng.random(14) < 0.4, rng.integers(1, 6, 14) + rng.random(14), 0.0)
        got = toxicity.segments(scores, 1.3)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores, 1.3)]
        assert np.allclose([x for *_, x in got], [x for *_, x in brute_segments(scores, 1.3)])


def corpus(n=600):
    docs, labels = [], []
    for i in range(n):
        words = prose(80, i).split()
        toxic = i % 5 == 0
        if toxic:
            at = 10 + i % 40
            words[at:at] = ["scumbag", "idiotic", "trashy"][: 2 + i % 2] + [f"lowei{i % 13}"]
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_passages(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    rows = toxicity.score(d, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    for r in held:  # the documents that nothing was learnt from
        passages = [r["text"][p["start"] : p["stop"]] for p in r["toxic_passages"]]
        assert any("scumbag" in p and "lowei" in p for p in passages) == (r["doc_id"] % 5 == 0)
    swapped = spark.createDataFrame([(i, 1, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, 1, t) for i, _, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, swapped).weight == model.weight  # held-out labels are never looked at


def test_the_law_is_calibrated_and_scores_dont_tie(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    # lambda solves its equation over the scores of words of the last fold's other documents
    tune = [t for (i, t, *_), (_, _, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5 == 4 and not y]
    scores, n = [], 0
    for t in tune:
        w = toxicity.WORD.findall(t.lower())
        s = toxicity.once_in_a_row(w, [model.word(x) for x in w])
        scores, n = scores + s[s > 0].tolist(), n + len(w)
    draws = scores + list(model.weight.values())
    mass = [1.0] * len(scores) + [0.5 / len(model.weight)] * len(model.weight)
    rate = min(sum(mass) / (n + 1), 0.2)
    assert abs((1 - rate) * np.exp(-model.lam * model.gap) + rate * sum(m * np.exp(model.lam * x) for m, x in zip(mass, draws)) / sum(mass) - 1) < 1e-6
    assert 1e-6 <= model.k <= 1
    scorer = toxicity.Scorer(model)
    p = [scorer.probability(best, 3) for best in (1, 5, 20, 29, 31, 40, 60, 200)]
    assert p == sorted(p) and len(set(p)) == len(p)


def test_odd_input(spark, odd, none):
    docs, labels = corpus(200)
    lab = spark.createDataFrame([*labels, (None, None, None), (1, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, COLUMNS), lab)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["toxicity"] <= 1 for r in rows) and all(r["label"] == "clash" for r in rows)
    assert all(r["toxicity"] < 0.5 for r in rows if not r["text"])
    empty = toxicity.train(none, lab.limit(0))
    assert {round(r["toxicity"], 6) for r in toxicity.score(odd, empty).collect()} == {0.1}
    assert toxicity.score(none, empty).count() == 0


def test_places_are_those_of_the_text_as_it_is():
    text = "".join(map(chr, range(0x250))) + "İstanbul ẞ ΣΑΣ"
    assert len(toxicity.lowered(text)) == len(text) and toxicity.lowered("İA") == "ia" and toxicity.lowered(None) == ""
    assert all(len(toxicity.lowered(chr(c))) == 1 for c in range(0x110000))
