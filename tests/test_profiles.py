"""Linked users' entries, users' files and the progress of imports."""

import io
import zipfile

import pytest

from lectern.operators import profiles as P
from lectern.sources import files
from lectern.sources.archive import W
from lectern.streaming import jobs

CODES = "tourn_id int, name string, start_date string, end_date string, team_code string, school_name string, event_abbr string, entry_id long"


def code(t, start, team, event="LD", end=""):
    return (t, f"T{t}", start, start if end == "" else end, team, "S", event, t * 10)


@pytest.fixture
def codes(spark):
    rows = [code(t, f"2024-{t:02d}-01", team) for t in range(1, 13) for team in ("A", "B")] + [code(20, "2024-02-01", "A", "PF", None), code(2, "2024-02-01", "A")]
    return spark.createDataFrame(rows, CODES)


def test_each_user_has_a_list_of_their_own(spark, codes):
    links = spark.createDataFrame([("u", "A"), ("u", "A"), ("v", "A"), ("v", "B"), ("w", "none"), (None, "A")], "user_id string, team_code string")
    got = [(r["user_id"], r["nth"], r["tourn_id"], r["team_code"]) for r in P.upcoming_of(links, codes, "2024-10-01", 3).collect()]
    assert sorted(x[1:] for x in got if x[0] == "u") == [(1, 10, "A"), (2, 11, "A"), (3, 12, "A")]
    assert sorted(x[1:] for x in got if x[0] == "v") == [(1, 10, "A"), (2, 10, "B"), (3, 11, "A")] and not [x for x in got if x[0] == "w"]
    ballots = spark.createDataFrame([(20, "PF", 1, 200, 1, "1", "prelim", "W", None)], "tourn_id int, event_abbr string, round_id int, entry_id long, ballot_id long, round_name string, round_type string, result string, opponent_entry_id long")
    past = {(r["nth"], r["tourn_id"]): r["prelim_wins"] for r in P.past_of(links.filter("user_id = 'u'"), codes, ballots, "2024-03-15", 4).collect()}
    assert past == {(1, 3): 0, (2, 2): 0, (3, 20): 1, (4, 1): 0}
    assert P.upcoming_of(links.limit(0), codes, "2024-01-01").count() == 0


def docx(*paras, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(f"<w:p>{p}</w:p>" for p in paras)}</w:body></w:document>')
    return out.getvalue()


def test_files_of_all_kinds(spark):
    run = "<w:r><w:t>{}</w:t></w:r>".format
    rows = [
        ("a/x.TXT", "one two\r\n\n three é".encode()), ("a/bad.txt", b"\xff ok"), ("a/y.docx", docx(run("Split") + run("word &amp; more"), "<w:r><w:tab/></w:r>", "<w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r>")), ("a/empty.docx", docx()),
        ("a/broken.docx", docx("x")[:-20]), ("a/other.docx", docx("x", name="word/none.xml")), ("a/no.pdf", b"%PDF"), ("a/null.txt", None), ("a/null.docx", None),
    ]
    got = {r["name"]: (r["kind"], r["content"], r["word_count"], r["problem"]) for r in files.context_rows(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["x.TXT"] == ("txt", "one two\n three é", 4, None) and got["bad.txt"][1] == "� ok" and got["y.docx"] == ("docx", "Splitword & more\na b", 5, None)
    assert got["empty.docx"] == ("docx", "", 0, None) and got["null.txt"] == ("txt", "", 0, None) and len(got) == len(rows)
    assert got["broken.docx"][3].startswith("BadZipFile") and got["other.docx"][3].startswith("KeyError") and got["no.pdf"][3] and got["null.docx"][3]
    assert files.paragraphs_of(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_a_stopped_import_goes_on_and_its_log_with_it(spark, tmp_path):
    src, target, log, ck = (str(tmp_path / x) for x in ("src", "target", "log", "ck"))
    df = spark.createDataFrame([(n, f"f{n}") for n in range(40)], "id long, fingerprint string")
    for k in range(4):
        df.filter(df["id"] % 4 == k).coalesce(1).write.mode("append").parquet(src)

    def stop(n):
        if n == 1:
            raise ValueError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        jobs.import_with_progress(spark, src, df.schema, target, log, ck, per_trigger=1, after=stop)
    assert sorted(r["percent"] for r in spark.read.parquet(log).collect()) == [25.0, 50.0]
    jobs.import_with_progress(spark, src, df.schema, target, log, ck, per_trigger=1)
    assert sorted((r["batch"], r["files"], r["files_done"], r["percent"]) for r in spark.read.parquet(log).collect()) == [(0, 1, 1, 25.0), (1, 1, 2, 50.0), (2, 1, 3, 75.0), (3, 1, 4, 100.0)]
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(40))
    # another file comes later
    df.limit(3).coalesce(1).write.mode("append").parquet(src)
    jobs.import_with_progress(spark, src, df.schema, target, log, ck, per_trigger=1)
    assert spark.read.parquet(log).filter("percent = 100").count() == 2 and spark.read.parquet(target).count() == 40
