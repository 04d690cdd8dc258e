import re

from pyspark.sql import functions as F

from lectern.llm import pii
from tests.llm.conftest import COLUMNS, odd_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail bob.42@mail8.example.com, or a@b.c%d@e.f.g", "x@@y.com x@y@z.com @a.b a@b", "IPs 1.2.3.4 300.1.2.3.4 1.2.3.4.5.6.7.8.9 00012.0.0.255 256.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4785380592391139 4041894974608795", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
    "call +1 (988) 555-2485 or +49-30-1234567 or +1234 or +1 22 333 4444 55555 666", "+1.2.3.4.5.6.7.8.9.0 and 10.20.30.40", "é日本 +44 (0)20 7946 0958 ü x@y.zz", "9" * 3000, "a." * 3000 + "@b.c", "1." * 2000, "+" * 50 + "1-2-3-4-5-6-7-8-9-0", "18-digit 123456789012345675", "", "none here",
]


def luhn(d):
    return sum((v - 9 if v > 9 else v) for i, c in enumerate(reversed(d)) for v in [int(c) * (2 if i % 2 else 1)]) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rows = [(n, t, None, None, None) for n, t in enumerate(TEXTS)]
    got = pii.find(spark.createDataFrame(rows, COLUMNS), pii.Model(None, {})).collect()
    for r in got:
        assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == brute(r["text"]), r["text"][:80]
        assert r["pii"] == r["base"]


def test_trees_add_what_looks_alike_and_redaction(spark):
    rows = [(n, f"word call +1 (9{n % 90 + 10}) 555-{2000 + n} now", None, None, None) for n in range(150)] + [(1000 + n, f"total 12 of {n} items and {n * 7 % 1000} more in row 55-{n} x", None, None, None) for n in range(150)]
    rows += [(2000 + n, f"order number 4{(n * 7919) % 10**15:015d} is here", None, None, None) for n in range(200)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = pii.train(docs)
    found = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    for doc, text, *_ in rows:
        base = {(x["s"], x["k"], x["e"]) for x in found[doc]["base"]}
        assert base == set(brute(text)) and base <= {(x["s"], x["k"], x["e"]) for x in found[doc]["pii"]}
        assert not (1000 <= doc < 2000 and found[doc]["pii"])  # clean documents are left alone
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[0] == "word call <PHONE> now" and clean[1001] == rows[151][1]


def test_odd_input(odd, none):
    model = pii.train(odd)
    out = pii.redact(odd, model)
    assert out.count() == len(odd_rows()) and set(out.columns) >= {"doc_id", "text", "source"}
    assert pii.find(none, pii.train(none)).count() == 0
    told = pii.find(odd, model).select(pii.told(F.col("base")).alias("t")).collect()
    assert {r["t"] for r in told} == {""}


def test_loose_forms_are_added_and_redacted(spark):
    """Trained on strict forms and on numbers that are none, the trees find forms that the strict patterns miss."""
    rows = []
    for n in range(240):
        wrong = next(x for x in range(1000, 1010) if not luhn(f"{n + 1000}{n + 2000}{n + 3000}{x}"))
        card = next(c for c in (f"4{n * 7919 % 10**14:014d}{x}" for x in range(10)) if luhn(c))
        rows += [
            (10 * n, f"write to name{n}.x@host{n}.example.com about it", None, None, None), (10 * n + 1, f"call +1 (9{n % 90 + 10}) 555-{2000 + n} now", None, None, None), (10 * n + 2, f"server 10.{n}.{n % 7}.12 is up", None, None, None),
            (10 * n + 3, f"card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} was charged", None, None, None), (10 * n + 4, f"part {n + 1000}.{n + 2000}.{n + 3000}.{wrong} in stock and version 999.{n}.3.4 too", None, None, None), (10 * n + 5, f"on {2000 + n % 20}-11-{n % 18 + 10} 12 item {n * 977 + 100000000} x", None, None, None),
        ]
    loose = {"anna (at) inbox (dot) example (dot) org": "EMAIL", "ben [at] corp.example": "EMAIL", "1 (955) 555-7788": "PHONE", "(955) 555-7788": "PHONE", "10 . 20 . 30 . 40": "IP", "4111.1111.1111.1111": "CARD"}
    before = {"EMAIL": "write to", "PHONE": "call", "IP": "server", "CARD": "card"}
    rows += [(9000 + n, f"{before[k]} {m} now", None, None, None) for n, (m, k) in enumerate(loose.items())]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = pii.train(docs)
    assert model.held_back and all(n > 0 and 0.95 * n <= right <= there for n, right, there in model.held_back.values())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert [clean[9000 + n] for n in range(len(loose))] == [f"{before[k]} <{k}> now" for k in loose.values()]
    changed = [clean[doc] for doc, text, *_ in rows if doc < 9000 and doc % 10 > 3 and clean[doc] != text]
    assert not changed


def test_every_candidate_of_every_document_counts(spark):
    text = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("call +1 (955) 555-"), (F.col("doc_id") % 9000 + 1000).cast("string"), F.lit(" now"))).otherwise(F.concat(F.lit("total 999."), (F.col("doc_id") % 7).cast("string"), F.lit(".3.4 of it")))
    docs = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("text", text).repartition(4)
    there = docs.filter("doc_id % 2 = 1").filter(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0).count()
    model = pii.train(docs)
    assert model.held_back[pii.KINDS.index("phone")][2] == there
