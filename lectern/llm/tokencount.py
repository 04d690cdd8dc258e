"""Token counts by a separator scan over flat token files.

A flat file is a run of unsigned ids of 16 or 32 bits (whichever the vocabulary needs) without an index; documents
end at an end-of-document id and may span any number of blocks. `write_flat` lays out tokenised documents so, as rows
of (file, block, data), one file for each task; `read_blocks` makes such rows of binary files of any size
that are already there, from Spark's own byte ranges of them. The scan finds the separators of a block with one vector
comparison and gives the lengths between them; a prefix sum of the separators of earlier blocks of
the file numbers the documents, so the parts of a document that spans blocks meet under one number.

`read_blocks` reads files as lines that end at byte 10 and puts that byte back, so it needs no file system but Spark's,
and a file's ranges are read side by side. Prefix sums of what the ranges hold tell where each block begins, and so
which bytes of an id that is cut in two go to the next block. The limit is the reader's: no 2 GB without a byte 10.

Defined results: a null or empty text is a document of no ids; the tail of a file that has no closing
separator is a document with `closed` false if it has ids; a text that has the separator itself in it
is not split (its id there is written as `unknown_id`); an id that is wider than its file's is an error; bytes after a
file's last whole id are left out; repeated rows are counted as often as they come; columns of other names are left
alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.tokens import public_tokenizer, word_ids

END = 49407
BLOCK = 1 << 18
#: Entries of a worker's caches of words; a worker holds blocks beside them.
WORDS = 120_000
#: Texts whose ids are held at once.
TEXTS = 256
#: Bytes that a reader of text drops at the beginning of a file.
MARK = b"\xef\xbb\xbf"


def kind(width: int) -> str:
    """The numpy type of ids of that many bytes."""
    return {2: "<u2", 4: "<u4"}[width]


def width_of(tokenizer: str) -> int:
    """Bytes that every id of the vocabulary fits into."""
    return 2 if word_ids(tokenizer, WORDS).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_flat(docs: DataFrame, end_id: int = END, unknown_id: int = 0, block: int = BLOCK, tokenizer: str | None = None, width: int | None = None) -> DataFrame:
    """Rows (file, block, data, ids): ids are the doc_ids whose documents end in the block, in order. width: bytes of an id.

    The ids are what a writer knows and a flat file doesn't say; the scan makes no use of them.
    """
    path = tokenizer or public_tokenizer()
    dtype = kind(width or width_of(path))
    closing = np.array([end_id], dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n, held, size, ended = TaskContext.get().partitionId(), 0, [], 0, []

        def row(data: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])

        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for doc, raw in zip(b["doc_id"].to_pylist(), word_ids(path, WORDS).encode_batch(b["text"].to_pylist()), strict=True):
                ids = np.frombuffer(raw, "<u4")
                if len(ids) and ids.max() > np.iinfo(dtype).max:
                    raise ValueError(f"the id {ids.max()} is too wide for {dtype}")
                ids = ids.astype(dtype)
                ids[ids == end_id] = unknown_id
                held += [ids, closing]
                size += len(ids) + 1
                if size >= block:
                    flat = np.concatenate(held)
                    while len(flat) >= block:
                        part, flat = flat[:block], flat[block:]
                        inside = int((part == end_id).sum()) - len(ended)
                        yield row(part, ended + ([doc] if inside > 0 else []))
                        n, doc_done = n + 1, inside > 0
                        ended = []
                    held, size = [flat], len(flat)
                    ended = [doc] if len(flat) else []
                    if doc_done and not len(flat):
                        ended = []
                else:
                    ended.append(doc)
        if size:
            yield row(np.concatenate(held), ended)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file int, block long, data binary, ids array<long>")


def read_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Rows (file, block, data) of the binary files at path: whole ids, in order of block; about `block` ids each, more where there is no byte 10."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    most = block * width

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of one range, a block at a time."""
        key, held, n, part = None, [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([part], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["file", "range", "size", "part", "data"])

        for b in batches:
            for k, line in zip(zip(*(b[c].to_pylist() for c in ("file", "range", "size"))), b["line"].to_pylist(), strict=True):
                if key is not None and (k != key or n >= most):
                    yield row()
                    part = part + 1 if k == key else 0
                    held, n = [], 0
                key = k
                held += [line, b"\n"]
                n += len(line) + 1
        if key is not None:
            yield row()

    parts = written(lines.mapInArrow(gather, "file string, range long, size long, part long, data binary"), "parts")
    # a row of a window's partition is about a block, so a file of a billion ids is some 4000 narrow rows
    order = Window.partitionBy("file").orderBy("range", "part")
    sizes = parts.select("file", "range", "part", "size", F.octet_length("data").cast("long").alias("n"), F.substring("data", -width, width).alias("end"))
    # all but the last line had its byte 10; a mark at the beginning was dropped
    sizes = sizes.withColumn("more", F.col("size") - F.sum("n").over(Window.partitionBy("file")))
    head = F.when((F.row_number().over(order) == 1) & (F.col("more") >= len(MARK) - 1), len(MARK)).otherwise(0)
    sizes = sizes.withColumn("head", head).withColumn("last", F.lead("n").over(order).isNull())
    sizes = sizes.withColumn("n", F.col("n") + F.col("head") - F.when(F.col("last") & F.col("more").isin(-1, len(MARK) - 1), 1).otherwise(0))
    at = F.sum("n").over(order)
    sizes = sizes.withColumns({"before": F.pmod(at - F.col("n"), F.lit(width)).cast("int"), "past": F.pmod(at, F.lit(width)).cast("int")})
    # the bytes of a cut id that earlier blocks have; a block may be as short as one byte
    ends = F.concat(*(F.coalesce(F.lag("end", n).over(order), F.lit(b"")) for n in range(width - 1, 0, -1)))
    sizes = sizes.withColumn("carried", ends).withColumn("block", F.row_number().over(order) - 1)
    found = parts.join(sizes.select("file", "range", "part", "n", "head", "before", "past", "carried", "block"), ["file", "range", "part"])
    data = F.concat(F.when(F.col("head") > 0, F.lit(MARK)).otherwise(F.lit(b"")), F.col("data"))
    data = F.substring(data, F.lit(1), F.col("n").cast("int"))
    carried = F.when(F.col("before") > 0, F.substring("carried", -F.col("before"), F.col("before"))).otherwise(F.lit(b""))
    data = F.concat(carried, data)
    return found.select("file", F.col("block").cast("long").alias("block"), F.substring(data, F.lit(1), F.octet_length(data) - F.col("past")).alias("data"))


def _numbered(blocks: DataFrame, n: Column) -> DataFrame:
    """blocks (file, block, ...; written) with first: the sum of n over the blocks before it in its file.

    The sums run over (file, block, n) alone: a block is 2**18 ids, so a file of a billion ids is some 4000 such rows.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("file", "block", n.cast("long").alias("_n"))
    first = narrow.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("first"))
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("block").eqNullSafe(F.col("_block"))
    return blocks.join(first, same).drop("_file", "_block")


def scan(blocks: DataFrame, end_id: int = END, width: int = 2) -> DataFrame:
    """(file, doc, n_tokens, closed) for each document of flat files; doc counts from 0 in a file.

    blocks: file, block (in order), data (unsigned ids of `width` bytes, little-endian).
    """
    dtype = kind(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block at a time, since a batch has all blocks of a task
        for b in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            ids = np.frombuffer(b["data"][0].as_buffer(), dtype)
            at = np.flatnonzero(ids == end_id)
            lengths = np.diff(at, prepend=-1, append=len(ids)) - 1  # the last is what follows the last separator
            lists = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths, pa.int32()))
            yield pa.RecordBatch.from_arrays([b["file"], b["block"], pa.array([len(at)], pa.int64()), lists], ["file", "block", "n_ends", "lengths"])

    file, order = blocks.schema["file"].dataType.simpleString(), blocks.schema["block"].dataType.simpleString()
    found = blocks.select("file", "block", "data").mapInArrow(run, f"file {file}, block {order}, n_ends long, lengths array<int>")
    parts = _numbered(written(found, "ends"), F.col("n_ends")).select("file", "n_ends", "first", F.posexplode("lengths").alias("k", "n"))
    parts = parts.select("file", (F.col("first") + F.col("k")).alias("doc"), F.col("n").cast("long").alias("n"), (F.col("k") < F.col("n_ends")).alias("closed"))
    return parts.groupBy("file", "doc").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed")).filter("closed or n_tokens > 0")


def token_counts(docs: DataFrame, end_id: int = END, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens: the documents are written to flat files and counted by the scan."""
    width = width_of(tokenizer or public_tokenizer())
    flat = written(write_flat(docs, end_id, block=block, tokenizer=tokenizer, width=width), "flat")
    names = _numbered(flat.select("file", "block", "ids"), F.size("ids"))
    names = names.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("doc"), "doc_id")
    return names.join(scan(flat, end_id, width), ["file", "doc"]).select("doc_id", "n_tokens")
