import hashlib
import random
import re

import duckdb
import pytest

from lectern.llm import infill
from lectern.llm.queries import ORACLE_SQL, op13_infill

from .conftest import COLUMNS


def plain(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    d = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(2)
    pieces = ["\n", "\n", "a", "é", "日本", "🙂", "\r", "<", ">", "P>", "<S", "<M", "word ", "x" * 40]
    some = ["", "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "a<S>\nb", "<M", "<P", ">", "S>\n", None, "<" * 9 + "\n" + ">" * 9, "line\n" * 3000]
    return some + ["".join(r.choices(pieces, k=r.randint(0, 25))) for _ in range(600)]


def check(df, **kw):
    done = infill.restore(infill.transform(df, **kw)).collect()
    for r in done:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], **kw)
        assert r["restored"] == (r["text"] or "")
    return done


@pytest.mark.parametrize("step, block", [(1 << 22, 1 << 20), (300, 7), (1, 3)])
def test_matches_plain_cutting(spark, monkeypatch, step, block):
    monkeypatch.setattr(infill, "STEP", step)
    monkeypatch.setattr(infill, "BLOCK", block)
    docs = [(k if k % 9 else None, t, "en", "a", 1) for k, t in enumerate(texts())]
    if step == 1:
        docs = docs[:60]
    df = spark.createDataFrame(docs, COLUMNS)
    # in this process, so that the sizes above hold
    import numpy as np
    import pyarrow as pa

    hashed = df.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(infill.draws(df["doc_id"], 7)))).toArrow()
    for b in hashed.to_batches():
        b = b.set_column(1, "text", b["text"].fill_null(""))
        for s in infill.steps(b, infill.sizes_of(b["text"]), step):
            draw = np.stack([s[f"h{k}"].to_numpy() for k in range(4)], 1)
            made = infill._scatter(s["text"], draw, 100, 50)
            want = [plain(d, t) for d, t in zip(s["doc_id"].to_pylist(), s["text"].to_pylist())]
            assert list(zip(*(m.to_pylist() for m in made))) == want
            assert infill._gather(made[4], made[1].to_pylist()).to_pylist() == s["text"].to_pylist()
            assert infill._gather(pa.concat_arrays([made[4], made[4]])[1:], (made[1].to_pylist() * 2)[1:]).to_pylist() == (s["text"].to_pylist() * 2)[1:]


@pytest.mark.parametrize("kw", [{}, {"seed": 3, "rate": 40, "spm": 0}, {"rate": 0}, {"spm": 100}])
def test_operator(spark, kw):
    docs = [(k if k % 9 else None, t, "en", "a", 1) for k, t in enumerate(texts())]
    forms = {r["form"] for r in check(spark.createDataFrame(docs, COLUMNS).repartition(3), **kw)}
    assert forms == {"plain"} if kw.get("rate") == 0 else len(forms) > 1


def test_odd_rows_and_empty(spark, odd, none):
    from pyspark.sql import functions as F

    clashing = odd.withColumns({c: F.lit(1) for c in ("form", "output", "restored", "middle_chars")})
    assert len(check(clashing)) == odd.count()
    assert infill.restore(infill.transform(none)).count() == 0


def test_output_without_its_marks_is_an_error(spark):
    with pytest.raises(Exception, match="without its mark"):
        infill.restore(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")).collect()


def test_query_matches_sql(spark, tmp_path):
    docs = [(k if k % 9 else None, t, "en", "a", 1) for k, t in enumerate(texts())]
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_infill(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op13_infill']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kinds = dict(r[:2] for r in c.execute(f"DESCRIBE {ORACLE_SQL['op13_infill']}").fetchall())
    assert [kinds[x] for x in got.columns] == ["BIGINT", "BIGINT", "VARCHAR", "BIGINT", "BIGINT", "VARCHAR", "VARCHAR"]
