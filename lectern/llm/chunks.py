"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of each whole text: h = 2 h + gear[byte], so a few of its bits
depend on the last 16 bytes alone. A chunk ends where those bits are zero, so boundaries move with
the content: after an insertion they fall into step again within a chunk or two. Chunks are keyed by a
128-bit digest; the first occurrence by (doc_id, start) stays, later ones are repeats. Neighbouring
repeated chunks make a run. A shared passage goes on for a part of a chunk or two at either end of its run, so runs
of `seed_words` or more that aren't long enough by themselves are compared word by word with the text around the
first and the last other occurrence of their outer chunks; a run with at least `min_words` whole words is a passage.

Digests that many chunks have are found on a bounded sample and met by broadcast (at most 1000 can each have more
than a thousandth of it); all others are dealt once by digest, for counting and joining alike. Wrong guesses
of the sample cost time only.

Defined results: null and empty texts have no chunks; copies repeat in full; within a document, the
second occurrence of a passage counts too; ties in doc_id are told apart by a hash of the text, and
wholly identical rows count as one; columns of other names are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import join_spread, written

WINDOW = 16
#: One number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: bytes, bits: int = 5, least: int = 16, most: int = 512) -> list[int]:
    """Ends of the chunks of data: 2**bits bytes past `least` on average, `most` at most."""
    if not data:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # after each step h sums twice as many bytes
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    cuts = (np.flatnonzero((h >> np.uint16(WINDOW - bits)) == 0) + 1).tolist()
    ends, at, n = [], 0, len(data)
    for cut in cuts:
        while cut - at > most:
            at += most
            ends.append(at)
        if cut - at >= least:
            at = cut
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, its hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))


def chunked(docs: DataFrame, bits: int = 5, least: int = 16, most: int = 512) -> DataFrame:
    """doc_id, th (hash of the text), start and length in bytes, words begun, and the digest (hi, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, th in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["th"].to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                ends = boundaries(data, bits, least, most)
                if not ends:
                    continue
                parts = [data[s:e] for s, e in zip([0, *ends[:-1]], ends)]
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), ">i8").astype(np.int64).reshape(-1, 2)
                n, stop = len(parts), np.array(ends, np.int64)
                start = np.concatenate([[0], stop[:-1]])
                raw = np.frombuffer(data, np.uint8)
                space = (raw == 32) | ((raw >= 9) & (raw <= 13))
                begun = np.cumsum(~space & np.concatenate([[True], space[:-1]]))
                words = np.diff(begun[stop - 1], prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array(np.full(n, th, np.int64)), pa.array(start.astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1]))],
                    ["doc_id", "th", "start", "len", "words", "hi", "lo"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fewer, larger batches."""
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return _texts(docs).mapInArrow(joined, "doc_id long, th long, start int, len int, words int, hi long, lo long")


def repeated_chunks(docs: DataFrame, sampled: int = 1_000_000, **sizes: int) -> DataFrame:
    """The chunks whose digest occurs more than once, with its first and last occurrence: structs of doc_id, th, start."""
    chunks = written(chunked(docs, **sizes), "chunks")
    key = ["hi", "lo"]
    share = min(1.0, sampled / max(1, chunks.count()))
    some = chunks.filter(F.pmod(F.xxhash64("doc_id", "th", "start"), F.lit(1 << 30)) < int(share * (1 << 30)))
    hot = written(some.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > max(1, sampled // 1000)).select(*key), "hot")
    # all columns, so that the count and the join read the same exchange
    whole = F.struct("doc_id", "th", "start", "len", "words")
    place = lambda c: F.struct(f"{c}.doc_id", f"{c}.th", f"{c}.start").alias(c)
    summed = lambda rows: rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(whole).alias("first"), F.max(whole).alias("last")).filter("n > 1").select(*key, place("first"), place("last"))
    often = chunks.join(F.broadcast(hot), key)
    rest = chunks.join(F.broadcast(hot), key, "left_anti").repartition(*key)  # dealt once, for the counts and the join
    return often.join(F.broadcast(summed(often)), key).unionByName(rest.join(summed(rest).hint("merge"), key))


def runs(chunks: DataFrame, seed_words: int) -> DataFrame:
    """Runs of repeated chunks with at least seed_words words begun: doc_id, th, start, stop, words, what is removed, and both outer chunks."""
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("start") == F.col("first.start"))
    found = chunks.select("doc_id", "th", "start", (F.col("start") + F.col("len")).alias("stop"), "words", "first", "last", (~first).alias("later"))
    # one shuffle by document serves all that follows; a document has no more chunks than its text holds
    rows = found.repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "start"])
    w = Window.partitionBy("doc_id", "th").orderBy("start")
    begins = F.coalesce(F.col("start") > F.lag("stop").over(w), F.lit(True)).cast("int")
    outer = F.struct("start", "stop", F.col("first").alias("p"), F.col("last").alias("q"))
    return (
        rows.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(w))
        .groupBy("doc_id", "th", "run")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.sum(F.col("later").cast("long")).alias("n_later"), F.sum(F.when(F.col("later"), F.col("stop") - F.col("start")).otherwise(0)).alias("later_bytes"),
            F.collect_set("first.doc_id").alias("firsts"), F.min_by(outer, "start").alias("head"), F.max_by(outer, "start").alias("tail"),
        )
        .drop("run").filter(F.col("words") >= seed_words)
    )


def _space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def around(data: bytes, pos: int, side: int, n: int) -> bytes:
    """What stands before (side 0) or after pos, n words far: it begins with a word, or ends with one, or reaches the text's end."""
    reach = 16 * n
    while True:
        part = data[max(0, pos - reach) : pos] if side == 0 else data[pos : pos + reach]
        blank = _space(np.frombuffer(part, np.uint8))
        edge = np.ones(1, bool)
        at = np.flatnonzero(~blank & np.concatenate([edge, blank[:-1]])) if side == 0 else np.flatnonzero(~blank & np.concatenate([blank[1:], edge])) + 1
        whole = pos <= reach if side == 0 else pos + reach >= len(data)
        if whole or len(at) > n:  # the outermost word may be cut off
            if side == 0:
                return part[at[-n] :] if len(at) > n else part
            return part[: at[n - 1]] if len(at) > n else part
        reach *= 2


def in_common(own: bytes, other: bytes, side: int) -> tuple[int, int]:
    """Whole words, and bytes up to the last of them, that both have from the position on."""
    m = min(len(own), len(other))
    if not m:
        return 0, 0
    x, y = (np.frombuffer(d[len(d) - m :] if side == 0 else d[:m], np.uint8) for d in (own, other))
    x, y = (x[::-1], y[::-1]) if side == 0 else (x, y)
    differ = np.flatnonzero(x != y)
    same = int(differ[0]) if len(differ) else m

    def ends(d: bytes) -> np.ndarray:
        """Distances from the position at which a word is whole."""
        raw = np.frombuffer(d[::-1] if side == 0 else d, np.uint8)
        blank = _space(raw)
        return np.flatnonzero(~blank & np.concatenate([blank[1:], np.ones(1, bool)])) + 1

    both = np.intersect1d(ends(own), ends(other), assume_unique=True)
    both = both[both <= same]
    return len(both), int(both[-1]) if len(both) else 0


def extended(docs: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """For runs of doc_id, th, start: words (whole ones) and the bytes by which they go on to the left and to the right."""

    def side(n: int, outer: str, pos: Column) -> Column:
        others = F.array_distinct(F.filter(F.array(f"{outer}.p", f"{outer}.q"), lambda x: ~(x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["th"] == F.col("th")) & (x["start"] == F.col(f"{outer}.start")))))
        shifted = F.transform(others, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["th"].alias("th"), (x["start"] + (F.lit(0) if n == 0 else F.col(f"{outer}.stop") - F.col(f"{outer}.start"))).alias("pos")))
        return F.struct(F.lit(n).alias("side"), pos.alias("pos"), shifted.alias("others"))

    edges = written(found.select("doc_id", "th", "start", "words", F.explode(F.array(side(0, "head", F.col("start")), side(1, "tail", F.col("stop")))).alias("e")).select("doc_id", "th", "start", "words", "e.*"), "edges")
    pairs = edges.select("doc_id", "th", "start", "words", "side", "pos", F.explode("others").alias("o"))
    place = ["doc_id", "th", "side", "pos"]
    asked = edges.select(*place).union(pairs.select("o.doc_id", "o.th", "side", "o.pos")).groupBy(*place).agg(F.count("*").alias("n"))
    by_text = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("side", "pos", "n")).alias("asked"))
    text = _texts(docs)
    held = text.join(by_text, text["doc_id"].eqNullSafe(by_text["doc_id"]) & (text["th"] == by_text["th"])).select(text["doc_id"], text["th"], "text", "asked")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, text, places in zip(*(b[c].to_pylist() for c in ("doc_id", "th", "text", "asked")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    at = p["pos"]
                    cut = p["side"] == 1 and not data[at - 1 : at].isspace() and not data[at : at + 1].isspace() and 0 < at < len(data)
                    out.append((doc, th, p["side"], at, p["n"], around(data, at, p["side"], min_words), cut))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], [*place, "n", "near", "cut"])

    # wholly identical rows of docs give a place twice, which the maxima below don't see
    near = written(held.mapInArrow(show, "doc_id long, th long, side int, pos int, n long, near binary, cut boolean"), "near")
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k_doc"), "th", "side", "pos"]
    own = edges.withColumn("k_doc", key[0]).join(near.select(*key, F.col("near").alias("own"), "cut"), ["k_doc", "th", "side", "pos"]).drop("k_doc", "pos")
    asks = own.withColumn("o", F.explode_outer("others")).select(F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"), "start", "words", "side", "own", "cut", F.coalesce("o.doc_id", F.lit(-(1 << 63))).alias("k_doc"), F.coalesce("o.th", F.lit(0)).alias("th"), F.coalesce("o.pos", F.lit(-1)).alias("pos"))
    alone, met = asks.filter("pos < 0").withColumn("other", F.lit(None).cast("binary")), asks.filter("pos >= 0")
    met = join_spread(written(met, "asks"), near.select(*key, F.col("near").alias("other"), "n"), ["k_doc", "th", "side", "pos"]).drop("n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, size = zip(*(in_common(x or b"", y or b"", s) for x, y, s in zip(b["own"].to_pylist(), b["other"].to_pylist(), b["side"].to_pylist(), strict=True))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("a_doc", "a_th", "start", "words", "side", "cut")), pa.array(words, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "th", "start", "words", "side", "cut", "more", "bytes"])

    cols = ["a_doc", "a_th", "start", "words", "side", "cut", "own", "other"]
    each = met.select(*cols).unionByName(alone.select(*cols)).mapInArrow(compare, "doc_id long, th long, start int, words long, side int, cut boolean, more long, bytes long")
    best = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)).otherwise(0))
    one = each.groupBy("doc_id", "th", "start", "words").agg(best(0, "more").alias("left"), best(1, "more").alias("right"), best(0, "bytes").alias("before"), best(1, "bytes").alias("after"), F.max(F.col("cut").cast("int")).alias("cut"))
    return one.select("doc_id", "th", "start", (F.col("words") - F.col("cut") + F.col("left") + F.col("right")).alias("words"), F.col("before").cast("int").alias("before"), F.col("after").cast("int").alias("after"))


def repeats(docs: DataFrame, min_words: int = 51, seed_words: int = 10, **sizes: int) -> DataFrame:
    """A row for each document that shares a passage of at least min_words words.

    doc_id; n_passages, shared_words; n_removed and removed_bytes of the chunks that repeat an earlier
    occurrence; passages: array of (start, stop) in bytes (up to the last whole chunk, where chunks alone are long
    enough); first_docs: the documents, in order, in which the passages' chunks occur first.
    """
    found = written(runs(repeated_chunks(docs, **sizes), seed_words), "runs")
    long, short = found.filter(F.col("words") > min_words), found.filter(F.col("words") <= min_words)
    more = extended(docs, short, min_words).filter(F.col("words") >= min_words)
    own = short.drop("words").join(more.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (short["th"] == more["th"]) & (short["start"] == more["start"]))
    own = own.select("doc_id", short["th"], (short["start"] - F.col("before")).alias("start"), (F.col("stop") + F.col("after")).alias("stop"), "words", "n_later", "later_bytes", "firsts")
    passages = long.select(*own.columns).unionByName(own)
    return passages.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_passages"), F.sum("words").alias("shared_words"), F.sum("n_later").alias("n_removed"), F.sum("later_bytes").alias("removed_bytes"),
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("passages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs"),
    )
