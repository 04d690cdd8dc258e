"""Archives of word-processor documents: entries, paragraphs, cards and uncited prose."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text

#: Paragraphs of a frame that a task gives back, at least; archives made at once, at most.
FRAME_ROWS, FRAME_ARCHIVES = 5000, 200

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file: one file is one row, so an archive is at most as large as a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def entries(archives: DataFrame, suffix: str = ".docx") -> DataFrame:
    """archive, entry, size from each archive's directory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i.filename, i.file_size) for p, c in zip(f["path"], f["content"]) for i in zipfile.ZipFile(io.BytesIO(c)).infolist() if i.filename.lower().endswith(suffix) and not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "entry", "size"])

    return archives.mapInPandas(run, "archive string, entry string, size long")


def profile(paths: DataFrame, schools: int = 12, teams: int = 20) -> DataFrame:
    """kind, label, n: the schools and teams with the most entries."""
    part = lambda n: F.coalesce(F.nullif(F.get(F.split("entry", "/"), F.lit(n)), F.lit("")), F.lit("Unknown"))
    top = lambda kind, label, n: paths.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n).select(F.lit(kind).alias("kind"), "label", "n")
    return top("school", part(1), schools).unionByName(top("team", F.concat_ws("/", part(1), part(2)), teams))


def _runs(p: ElementTree.Element) -> list[tuple[str, bool, bool, bool]]:
    out = []
    for r in p.iter(f"{W}r"):
        t = "".join(x.text or "" for x in r.iter(f"{W}t"))
        if t:
            out.append((t, r.find(f".//{W}u") is not None, r.find(f".//{W}b") is not None, r.find(f".//{W}highlight") is not None))
    return out


def _marked(runs: list[tuple[str, bool, bool, bool]]) -> str:
    parts = []
    for t, underlined, bold, lit in runs:
        clean = re.sub(r"\s+", " ", t)
        if not clean.strip():
            parts.append(t)
            continue
        body = f"**<u>{clean}</u>**" if bold and (underlined or lit) else f"<u>{clean}</u>" if underlined else clean
        parts.append(f"=={body}==" if lit and (underlined or bold) else body)
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def paragraphs(archives: DataFrame) -> DataFrame:
    """entry, pos, style, text, markdown of the paragraphs with text of each document in each archive."""

    columns = ["entry", "pos", "style", "text", "markdown"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for f in frames:
            for content in f["content"]:
                z = zipfile.ZipFile(io.BytesIO(content))
                for name in z.namelist():
                    if not name.lower().endswith(".docx"):
                        continue
                    root, pos = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(z.read(name))).read("word/document.xml")), 0
                    for p in root.iter(f"{W}p"):
                        style, runs = p.find(f".//{W}pStyle"), _runs(p)
                        joined = re.sub(r"\s+", " ", " ".join(t for t, *_ in runs)).strip()
                        if joined:
                            rows.append((name, pos, style.get(f"{W}val", "") if style is not None else "", joined, _marked(runs)))
                            pos += 1
                    if len(rows) >= FRAME_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return archives.mapInPandas(run, "entry string, pos int, style string, text string, markdown string")


def sessions(paras: DataFrame) -> DataFrame:
    """paras with card (number of headings so far) and cite_pos (the first citation of the card)."""
    heading = F.col("style") == "Heading4"
    so_far = Window.partitionBy("entry").orderBy("pos")
    out = paras.withColumn("card", F.sum(heading.cast("bigint")).over(so_far))
    cite = ~heading & (F.col("card") > 0) & (text.short_cite(F.col("text")) != "")
    return out.withColumn("cite_pos", F.min(F.when(cite, F.col("pos"))).over(Window.partitionBy("entry", "card")))


def cards_from_paragraphs(paras: DataFrame) -> DataFrame:
    """entry, card, tag, cite, body: a heading opens a card, its first citation is kept, what follows is the body."""
    s = sessions(paras).filter("card > 0")
    heading, body = F.col("style") == "Heading4", (F.col("style") != "Heading4") & (F.col("pos") > F.col("cite_pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("pos", "text")))), lambda x: x["text"])
    out = s.groupBy("entry", "card").agg(F.max(F.when(heading, F.col("text"))).alias("tag"), F.max(F.when(F.col("pos") == F.col("cite_pos"), F.col("text"))).alias("cite"), F.array_join(ordered, " ").alias("body"), F.count_if(body).alias("_n"))
    return out.filter("_n > 0").drop("_n")


def analytics_from_paragraphs(paras: DataFrame, least: int = 30) -> DataFrame:
    """entry, title, content, word_count of files with enough prose; only the citations that open a card are left out."""
    s = sessions(paras)
    kept = s.filter("cite_pos is null or pos <> cite_pos")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    first = s.groupBy("entry").agg(F.coalesce(F.min_by(F.when(F.col("style") == "Heading4", F.col("text")), F.when(F.col("style") == "Heading4", F.col("pos"))), F.min_by("text", "pos")).alias("title"))
    out = kept.groupBy("entry").agg(content.alias("content")).withColumn("word_count", text.n_words(F.col("content"))).filter(F.col("word_count") >= least)
    return out.join(first, "entry").select("entry", "title", "content", "word_count")


def as_archives(paras: DataFrame) -> DataFrame:
    """path, content: one archive for each entry, with the entry's paragraphs (entry, pos, style, text) as a document; the reverse of `paragraphs`."""
    from xml.sax.saxutils import escape

    def one(name: str, rows: list) -> bytes:
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(p["style"])}"/></w:pPr><w:r><w:t>{escape(p["text"])}</w:t></w:r></w:p>' for p in rows)
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr(name, inner.getvalue())
        return outer.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FRAME_ARCHIVES):
                some = b.slice(at, FRAME_ARCHIVES)
                names = some["entry"].to_pylist()
                made = [one(name, rows) for name, rows in zip(names, some["p"].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([f"{n.replace('/', '_')}.zip" for n in names]), pa.array(made, pa.binary())], ["path", "content"])

    held = paras.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", "style", "text"))).alias("p"))
    return held.mapInArrow(run, "path string, content binary")
