"""Users' own files as a table function: one file, many rows.

`FileText` reads plain text and word-processor documents in a lateral join, a row for each paragraph with text. A file that can't
be read is a row that says why, and stops nothing.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.sources.archive import W

TEXT, DOCUMENT = (".txt", ".md"), (".docx",)


class FileText:
    """eval(path, content): pos, text, problem."""

    def eval(self, path: str, content: bytes):
        name = (path or "").lower()
        if name.endswith(TEXT):
            for pos, line in enumerate(bytes(content or b"").decode("utf-8", "replace").split("\n")):
                if line.strip():
                    yield pos, line.rstrip("\r"), None
        elif name.endswith(DOCUMENT):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, EOFError, RuntimeError, NotImplementedError) as e:
                yield 0, None, f"{type(e).__name__}: not a document"
                return
            for pos, p in enumerate(root.iter(f"{W}p")):
                # a tab and a break are white space
                joined = "".join(t.text or "" if t.tag == f"{W}t" else " " for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
                if joined.strip():
                    yield pos, joined, None
        else:
            yield 0, None, "not a kind that is read"


def paragraphs_of(files: DataFrame) -> DataFrame:
    """path, pos, text, problem of files (path, content)."""
    read = F.udtf(FileText, returnType="pos int, text string, problem string")
    return files.select("path", "content").lateralJoin(read(F.col("path").outer(), F.col("content").outer())).select("path", "pos", "text", "problem")


def context_rows(files: DataFrame) -> DataFrame:
    """path, name, kind, content, word_count, problem: one row for each file. path names one file; one without text has no words."""
    p = files.select("path").join(paragraphs_of(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"), F.max("problem").alias("problem")), "path", "left")
    kept = F.transform(F.filter("x", lambda x: x["text"].isNotNull()), lambda x: x["text"])
    name = F.substring_index("path", "/", -1)
    content = F.coalesce(F.array_join(kept, "\n"), F.lit(""))
    return p.select("path", name.alias("name"), F.lower(F.substring_index(name, ".", -1)).alias("kind"), content.alias("content"), text.n_words(content).alias("word_count"), "problem")
