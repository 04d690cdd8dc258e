"""Queries over profiles' tournaments and arguments, linked users, users' files, and the progress of imports."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import profiles as P
from lectern.plans.registry import query
from lectern.plans.tournament_queries import BET, REC, ROUND_RESULTS
from lectern.sources import files, scratch
from lectern.sources.archive import W
from lectern.streaming import jobs

RECORD = ", ".join(f"coalesce({c}, 0) AS {c}" for c in P.RECORD)


@query(f"""WITH {ROUND_RESULTS}, {REC} SELECT t.season, e.event_abbr, e.team_key, row_number() OVER (PARTITION BY t.season, e.event_abbr, e.team_key ORDER BY t.start_date, e.tourn_id, e.entry_id)::INT AS nth, e.tourn_id, t.name, t.start_date, t.end_date, e.entry_id, e.earned_bid, r.place, r.final_rank::INT AS final_rank, {RECORD}
FROM fx_entries e JOIN fx_tournaments t USING (tourn_id) LEFT JOIN fx_results r USING (tourn_id, event_abbr, entry_id) LEFT JOIN rec USING (tourn_id, event_abbr, entry_id)""", *BET, "fx_results")  # fmt: skip
def agg_30_team_tournaments(v):
    return P.team_tournaments(v.fx_entries, v.fx_tournaments, v.fx_results, v.fx_ballots)


@query("""WITH l AS (SELECT r.season, r.event_abbr, r.team_key, min(w.id) AS team_id FROM fx_ratings r JOIN fx_wiki_teams w ON lower(w.school) = lower(r.school_name) AND contains(' ' || lower(r.display_name) || ' ', ' ' || lower(w.code) || ' ') GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY read_count DESC, id)::INT AS nth FROM fx_wiki_arguments) SELECT season, event_abbr, team_key, team_id, a.id AS argument_id, name, side, read_count, nth FROM l JOIN a USING (team_id) WHERE nth <= 2""", "fx_ratings", "fx_wiki_teams", "fx_wiki_arguments")  # fmt: skip
def agg_30_top_arguments(v):
    return P.top_arguments(v.fx_ratings, v.fx_wiki_teams, v.fx_wiki_arguments, 2)


LINKED = "l AS (SELECT DISTINCT team_key AS user_id, display_name AS team_code FROM fx_entries), c AS (SELECT DISTINCT user_id, tourn_id, name, start_date, end_date, team_code, school_name, event_abbr, entry_id FROM fx_codes JOIN l USING (team_code))"


def _links(v):
    return v.fx_entries.select(F.col("team_key").alias("user_id"), F.col("display_name").alias("team_code"))


@query(f"WITH {LINKED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date, tourn_id, event_abbr, team_code, entry_id)::INT AS nth FROM c WHERE start_date >= '1996-01-01') x WHERE nth <= 20", "fx_entries", "fx_codes")
def join_12_upcoming_of_users(v):
    """The next entries of every team, each linked with itself."""
    return P.upcoming_of(_links(v), v.fx_codes, "1996-01-01")


@query(f"WITH {LINKED}, {ROUND_RESULTS}, {REC} SELECT x.*, {RECORD} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, tourn_id, event_abbr, team_code, entry_id)::INT AS nth FROM c WHERE end_date IS NULL OR end_date < '1996-01-01') x LEFT JOIN rec USING (tourn_id, event_abbr, entry_id) WHERE nth <= 10", "fx_ballots", "fx_entries", "fx_codes")
def join_12_past_of_users(v):
    return P.past_of(_links(v), v.fx_codes, v.fx_ballots, "1996-01-01")


def _documents(frames):
    """Texts as files: every third one is plain text, a document, or a document that has lost its end."""
    for f in frames:
        rows = []
        for k, body in zip(f["doc_id"], f["text"]):
            if k % 3 == 0:
                rows.append((f"u/{k}.txt", body.encode()))
                continue
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                paras = "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in body.split("\n"))
                z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{paras}</w:body></w:document>')
            rows.append((f"u/{k}.docx", out.getvalue() if k % 3 == 1 else out.getvalue()[:-30]))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(r"""SELECT CASE WHEN doc_id % 3 = 0 THEN concat(doc_id, '.txt') ELSE concat(doc_id, '.docx') END AS name, CASE WHEN doc_id % 3 = 0 THEN 'txt' ELSE 'docx' END AS kind, CASE WHEN doc_id % 3 = 2 THEN '' ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) END AS content,
  CASE WHEN doc_id % 3 = 2 THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) END AS word_count, CASE WHEN doc_id % 3 = 2 THEN 'BadZipFile: not a document' END AS problem FROM documents""")  # fmt: skip
def src_25_context_rows(v):
    made = scratch.written(v.documents.select("doc_id", "text").mapInPandas(_documents, "path string, content binary"), "files")
    return files.context_rows(made).drop("path")


class _Stopped(Exception):
    pass


@query("SELECT 6 AS n_batches, 6 AS files_done, 6 AS files_known, 100.0::DOUBLE AS percent, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM documents")
def src_19_progress(v):
    """An import of six files that stops after its second batch, and is taken up again."""
    path, target, log, checkpoint = (scratch.fresh(v._spark, x) for x in ("files", "imported", "log", "checkpoint"))
    docs = v.documents.select("doc_id", "text")
    docs.repartition(6).write.parquet(path)

    def stop(n: int) -> None:
        if n == 1:
            raise _Stopped

    try:
        jobs.import_with_progress(v._spark, path, docs.schema, target, log, checkpoint, "doc_id", 1, stop)
    except Exception as e:  # the stream reports it as its own
        if "_Stopped" not in str(e):
            raise
    jobs.import_with_progress(v._spark, path, docs.schema, target, log, checkpoint, "doc_id", 1)
    last = v._spark.read.parquet(log).agg(F.count("*").cast("int").alias("n_batches"), F.max("files_done").cast("int").alias("files_done"), F.max("files_known").cast("int").alias("files_known"), F.max("percent").alias("percent"))
    return last.crossJoin(v._spark.read.parquet(target).agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs")))
