import random
import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.tokens import WordIds, public_tokenizer
from tests.llm.conftest import COLUMNS, odd_rows

ODD_TEXTS = ["", " ", "a@b.c It's l'été İstanbul ÉCOLE, x\u0301 e\u0301t  ", "12 3.4\t\r\n\x0b end<|endoftext|> ok", "日本語。 ÀÈ!? don't we've 'll ...", "x" * 300, "ß ẞ ſ Œuvre,,, a.b", "\u00a0\u2003wide\u3000space"]


def test_ids_are_the_librarys():
    path = public_tokenizer()
    plain, cached = Tokenizer.from_file(path), WordIds(path, most=50)
    random.seed(3)
    texts = ODD_TEXTS + ["".join(random.choice("aAéÉ zß.,' \n\t1%日́") for _ in range(60)) for _ in range(300)]
    for _ in range(2):
        for t, got in zip(texts, cached.encode_batch(texts)):
            ids = plain.encode(t, add_special_tokens=False).ids
            assert got == b"".join(i.to_bytes(4, "little") for i in ids), t


def test_plan_places_every_piece_and_is_tight():
    rng = random.Random(1)
    for n, size in ((1, 16), (400, 64), (3000, 128)):
        lengths = [min(size, 1 + int(rng.expovariate(4 / size))) for _ in range(n)]
        done = packing.plan(dict(Counter(lengths)), size)
        assert all(sum(f) <= size for f, _ in done)
        held = Counter()
        for f, times in done:
            for x in f:
                held[x] += times
        assert held == Counter(lengths)
        assert sum(t for _, t in done) <= -(-sum(lengths) // size) * 1.03 + 1
    assert packing.plan({}, 16) == []


def test_pack_against_the_tokenizer(odd, none):
    size = 64
    rows = packing.pack(odd, size=size).collect()
    t = Tokenizer.from_file(public_tokenizer())
    want = Counter()
    for doc, text, *_ in odd_rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[doc, piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(none).count() == 0


def test_plan_reaches_the_bound_on_skewed_lengths():
    """Few lengths, none of which fill a sequence alone: the volume is no guide to the optimum."""
    rng = random.Random(5)
    for size, lengths in ((4096, [1400, 1500, 2100, *range(1365, 1386)]), (1000, [501, 270, 251, 252, 240]), (100, [51, 27, 26, 23, 49, 48])):
        histogram = {k: rng.randint(2000, 9000) for k in lengths}
        counts = packing.np.zeros(size + 1)
        for k, n in histogram.items():
            counts[k] = n
        used, bound = packing.reweighted(counts, 0.001)
        covered = Counter()
        for has, times in used.items():
            assert sum(k * n for k, n in has) <= size
            for k, n in has:
                covered[k] += n * times
        assert all(covered[k] >= n - 1e-6 * n for k, n in histogram.items())
        assert bound <= sum(used.values()) <= bound * 1.001
        done = packing.plan(histogram, size)
        assert sum(t for _, t in done) <= bound * 1.001 + len(histogram)


def test_plan_ends_on_many_lengths_with_an_open_gap():
    """The bound on the work stops the re-weighting; what it has by then covers all pieces."""
    rng = random.Random(5)
    histogram = {k: rng.randint(20, 400) for k in range(180, 690)}
    counts = packing.np.zeros(1025)
    for k, n in histogram.items():
        counts[k] = n
    used, bound = packing.reweighted(counts, 0.0, work=1e7)
    covered = Counter()
    for has, times in used.items():
        assert sum(k * n for k, n in has) <= 1024
        for k, n in has:
            covered[k] += n * times
    assert all(covered[k] >= n - 1e-6 * n for k, n in histogram.items())
    assert 0 < bound <= sum(used.values())


def test_the_number_of_salts_changes_no_length(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "word " * (n % 7), None, None, None) for n in range(900)], COLUMNS)
    monkeypatch.setattr(packing, "SALTS", 1)
    totals = []
    for part in (100_000, 10, 1):
        monkeypatch.setattr(packing, "PART", part)
        rows = packing.pack(docs, size=16).collect()
        slots = {(r["sequence_id"], at) for r in rows for at in range(r["offset"], r["offset"] + r["length"])}
        assert len(slots) == sum(r["length"] for r in rows) and all(at < 16 for _, at in slots)
        totals.append((len(rows), len({s for s, _ in slots})))
    assert len(set(totals)) == 1
