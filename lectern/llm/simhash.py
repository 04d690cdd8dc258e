"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has one bit for each bit of the shingle hashes: set if it is set in over half of
them. Fingerprints are cut into segments; each is indexed under every variant of every segment with one bit
made a wildcard, variants are joined by equality, and candidates are verified.

`near_duplicates` links two texts if their 64-bit fingerprints differ in at most two bits: of two segments
of 32 bits, at least one then differs by at most one bit, so no link is missed. Copies share a fingerprint
and are one vertex from the start. A bucket of more than `crowded` fingerprints isn't compared pair by pair:
its fingerprints are indexed once more with every choice of two wildcard bits, where all members of a group
are linked by construction, so a minimum is enough. Both ways are exact.

`keep_first` keeps one of each group of near copies: texts whose sets of five-word shingles are similar by
Jaccard to at least 0.8. That is some ten bits of a 64-bit fingerprint, too many for segments that one can
still look up, so its candidates come from fingerprints of `segments` x 32 bits over word pairs, and the
similarity itself is then computed. What fraction of similar pairs shares a bucket is measured in the tests and
stated in the README; none of those is lost, whatever the size of its bucket (see `near_copies`).

Components of fingerprints are smallest labels, spread along links and shortened by pointer jumping until none moves,
with each round written to the shared folder; those of texts are alternating stars (`lectern.operators.components`).

Defined results: null and blank texts have the fingerprint zero and are linked like any other;
rows with a null doc_id get a fingerprint and the component of their fingerprint, but don't name a
component (null, if there is no other id); repeated rows come out as often as they go in; columns of
other names are left alone; an empty table gives no rows. For `keep_first`, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, join_spread, words, written
from lectern.operators.components import components

SEED = 42
BITS = 64
HALF = 32


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits, as bytes, that are set in over half of the hashes (rows of bytes)."""
    total = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256], axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        total += bits[:full].reshape(-1, 255, len(total)).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little")


def _shingles(text: str | None, width: int) -> list[bytes]:
    """Words are what lies between ASCII white space, in ASCII lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < width:
        return [b" ".join(found)] if found else []
    return [b" ".join(s) for s in zip(*(found[k:] for k in range(width)))]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Of a whole text, from the XXH64 hashes of its shingles, repeats included."""
    shingles = _shingles(text, width)
    if not shingles:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    return int(_majority(hashes.view(np.uint8).reshape(-1, 8)).view(np.uint64)[0])


def segments_of(text: str | None, segments: int = 10, width: int = 2) -> list[int]:
    """A fingerprint of segments x 32 bits over the distinct shingles of a whole text, by segment."""
    shingles = set(_shingles(text, width))
    if not shingles:
        return [0] * segments
    raw = b"".join(xxhash.xxh3_128_digest(s, k) for s in shingles for k in range(-(-segments // 4)))
    return _majority(np.frombuffer(raw, np.uint8).reshape(len(shingles), -1)).view(np.uint32)[:segments].tolist()


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id long and fp long (the 64 bits as a signed number) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _without(fp: Column, bit: Column) -> Column:
    """fp with one bit cleared."""
    return fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): key is the segment's number, the wildcard bit and the segment without it."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    segment = F.when(F.col("bit") < HALF, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", HALF))
    return v.select((_without(segment, F.col("bit") % HALF) + F.col("bit").cast("long") * F.lit(1 << HALF)).alias("key"), "fp")


def links(fps: DataFrame, crowded: int = 512) -> DataFrame:
    """(a, b) of different fingerprints in `fps` (fp, distinct) that connect all that differ in at most two bits.

    Every such pair is given, but within crowded buckets, where a star of links stands for the pairs
    of a group that all lie within two bits of each other.
    """
    v = variants(fps)
    met = v.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # an explode's size is taken for that of its input, so 64 variants of each would be broadcast if that is small
    shared = written(v.join(met.hint("merge"), "key"), "buckets")
    few = shared.filter(F.col("n") <= crowded)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = x.join(y.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (_differing(F.col("a"), F.col("b")) <= 2)).select("a", "b")

    many = shared.filter(F.col("n") > crowded).select("fp").distinct()
    two = (
        many.select("fp", F.explode(F.sequence(F.lit(1), F.lit(BITS - 1))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
        .select("fp", (F.col("i") * BITS + F.col("j")).alias("bits"), _without(_without(F.col("fp"), F.col("i")), F.col("j")).alias("rest"))
        # at most four fingerprints share all but two bits
        .groupBy("bits", "rest").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    )
    stars = two.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(stars).distinct()


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of `edges` (a, b): the smallest vertex that each one reaches.

    Each round takes the smallest label among a vertex and its neighbours and then that label's own
    label, so labels travel twice as far each time. Rounds end when no label moves: labels only fall, so they do.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("v").alias("b"), F.col("label").alias("theirs"))
        near = both.join(of, "b").groupBy(F.col("a").alias("v")).agg(F.min("theirs").alias("near"))
        stepped = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        moved = written(stepped.join(jump, "next").select("v", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "round")
        labels = moved.select("v", "label")
        if moved.filter("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 3, crowded: int = 512) -> DataFrame:
    """doc_id, fp long, component_id (the smallest doc_id of all documents reachable over links)."""
    rows = written(with_fingerprints(docs, width), "fingerprints")
    vertices = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "vertices")
    labels = smallest_labels(links(vertices.select("fp"), crowded))
    grouped = written(vertices.join(labels.withColumnRenamed("v", "fp"), "fp").select("fp", "label", "first_id"), "labelled")
    first = written(grouped.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "firsts")
    linked = join_spread(grouped.select("fp", "label"), first, ["label"]).select("fp", "component_id")
    by_fp = written(vertices.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n"), "components")
    return join_spread(rows, by_fp, ["fp"]).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def texts(docs: DataFrame, segments: int = 10) -> DataFrame:
    """A row for each distinct text: v (a number for it), t (its digest), first_id and fp, its segments; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [segments_of(x, segments) for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t"], pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "t", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_id(F.col("text")).alias("t")).mapInArrow(run, "doc_id long, t binary, fp array<long>")
    one = written(rows, "segments").groupBy("t").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"))
    return written(one.withColumn("v", F.monotonically_increasing_id()), "texts")


def buckets(found: DataFrame) -> DataFrame:
    """(key, v, n): the variants of the segments of texts (v, fp) that n > 1 texts share; written."""
    at = found.select("v", F.posexplode("fp").alias("seg", "bits")).select("v", "seg", "bits", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("bit"))
    key = _without(F.col("bits"), F.col("bit")) + (F.col("seg") * HALF + F.col("bit")).cast("long") * F.lit(1 << HALF)
    index = at.select(key.alias("key"), "v")
    met = written(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    return written(join_spread(index, met, ["key"]).select("key", "v", "n"), "buckets")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = 5) -> DataFrame:
    """(v, s): the hashes of the distinct shingles of the wanted texts (v, t, first_id); written."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_id(F.col("text")).alias("t"))
    # the row that has a text's smallest id stands for all of its copies
    held = own.join(wanted, (own["t"] == wanted["t"]) & own["doc_id"].eqNullSafe(wanted["first_id"])).select("v", "text")
    w = words(F.translate(F.col("text"), UPPER, LOWER))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(width))))
    some = F.when(F.size("w") >= width, each).when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(F.array().cast("array<bigint>"))
    return written(held.select("v", w.alias("w")).select("v", F.array_distinct(some).alias("s")).groupBy("v").agg(F.first("s").alias("s")), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, most: int = 1000) -> DataFrame:
    """The pairs (a, b; written) whose sets are that similar by Jaccard; sets without a shingle are alike.

    A text of many pairs is sent once for every `most` of them, so its pairs are no one task.
    """
    uses = written(pairs.groupBy("a").agg(F.count("*").alias("n")), "uses")
    share = F.pmod(F.xxhash64("b"), F.floor(F.col("n") / most) + 1)
    x = sets.join(uses, sets["v"] == uses["a"]).select("a", F.col("s").alias("x"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / most))).alias("share"))
    dealt = join_spread(pairs, uses, ["a"]).select("a", "b", share.cast("long").alias("share"))
    both = dealt.join(x.withColumn("share", F.col("share").cast("long")), ["a", "share"]).join(sets.select(F.col("v").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y") - shared).alias("all"))
    return counted.filter((F.col("n") == F.col("all")) | (F.col("n") / F.col("all") >= similarity)).select("a", "b")


def _met_by_prefix(held: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of texts in held (v, label) with different labels: all that share a variant and can be that similar.

    Of two such sets, each one's rarest shingles, as many as the other may lack and one more, have one in common. At the
    rarest that they share, nothing before it is shared, so what comes after it bounds what else they can share.
    """
    one = held.join(sets, "v").select("v", "label", F.size("s").alias("size"), F.explode("s").alias("h"))
    rare = one.join(one.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h", "left")
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.coalesce("n", F.lit(1)), "h"))
    first = rare.select("h", "v", "label", "size", "n", (F.col("size") - nth).alias("after"))
    first = first.filter((F.col("after") >= F.ceil(F.col("size") * similarity - 1e-6) - 1) & (F.col("n") > 1))
    prefix = written(first.select("h", "v", "label", "size", "after"), "prefixes")
    x, y = (prefix.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "label", "size", "after"))) for side in "ab")
    alike = (F.col("v_a") < F.col("v_b")) & (F.col("label_a") != F.col("label_b"))
    alike &= (1 + F.least("after_a", "after_b")) * (1 + similarity) >= (F.col("size_a") + F.col("size_b")) * similarity - 1e-6
    pairs = x.join(y, (x["h"] == y["h"]) & alike).select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()
    fps = found.select("v", "fp")
    both = pairs.join(fps.toDF("a", "fp_a"), "a").join(fps.toDF("b", "fp_b"), "b")
    return both.filter(F.exists(F.zip_with("fp_a", "fp_b", _differing), lambda d: d <= 1)).select("a", "b")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, segments: int = 10, rounds: int = 2) -> DataFrame:
    """t, first_id and label for each distinct text: texts with one label are connected by similar pairs.

    In each round a text stands for every bucket that isn't one component yet, and the bucket's texts of other
    components are compared with it: first the text with the most company, for each text only the first such one,
    later one by hash. What is in open buckets then meets by an exact prefix filter. So every similar pair that shares a
    bucket is linked or in one component already, whatever the sizes of buckets, and groups don't depend on the rounds.
    """
    found = texts(docs, segments)
    shared = buckets(found)
    company = written(shared.groupBy("v").agg(F.sum("n").alias("d")), "company")
    sets = shingle_sets(docs, found.join(company, "v").select("v", "t", "first_id"), width)
    rows = written(shared.join(company, "v").select("key", "v", "d", F.col("v").alias("label")), "ranked")
    linked = compared = None

    def opened(order: Column) -> DataFrame:
        agg = (F.min_by(F.struct("v", "d", "label"), order).alias("one"), F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("greatest"))
        kept = written(rows.groupBy("key").agg(*agg).filter("least < greatest").select("key", "one", "n"), "ones")
        return written(join_spread(rows, kept, ["key"]), "open")

    def relabelled(labels: DataFrame) -> DataFrame:
        return written(rows.select("key", "v", "d").join(labels, "v", "left").select("key", "v", "d", F.coalesce("label", "v").alias("label")), "labelled")

    def link(pairs: DataFrame) -> DataFrame:
        nonlocal linked, compared
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        now = written(pairs, "pairs")
        compared = now if compared is None else compared.union(now)
        similar = written(_similar(now, sets, similarity), "similar")
        linked = similar if linked is None else linked.union(similar)
        return components(linked)

    for k in range(rounds):
        rows = opened(F.struct(-F.col("d"), "v") if k < 2 else F.struct(F.xxhash64("v", F.lit(k)), "v"))
        star = rows.filter("label <> one.label")
        if k == 0:
            star = star.groupBy("v").agg(F.min_by("one", F.struct(-F.col("one.d"), "one.v")).alias("one"))
        labels = link(star.select(F.least("v", "one.v").alias("a"), F.greatest("v", "one.v").alias("b")).distinct())
        rows = relabelled(labels)
    held = written(opened(F.struct("v")).select("v", "label").distinct(), "held")
    labels = link(_met_by_prefix(held, sets, found, similarity))
    return found.join(labels, "v", "left").select("t", "first_id", F.coalesce("label", "v").alias("label"))


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, segments: int = 10, rounds: int = 2) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id (of its texts, the smallest digest).

    Defined results: null and blank texts are copies of one another; rows with a null doc_id stay, since nothing
    names them; of rows with one doc_id, each text is judged for itself; of rows with one doc_id and text, one stays
    (the smallest by a hash of all columns); columns of other names are left alone; an empty table gives no rows.
    """
    named = near_copies(docs, width, similarity, segments, rounds).filter("first_id is not null")
    kept = named.groupBy("label").agg(F.min(F.struct("first_id", "t")).alias("one")).select(F.col("one.first_id").alias("_lectern_id"), F.col("one.t").alias("_lectern_t"))
    own = docs.withColumn("_lectern_text", _text_id(F.col("text")))
    held = own.filter("doc_id is not null").join(kept, (F.col("doc_id").cast("long") == F.col("_lectern_id")) & (F.col("_lectern_text") == F.col("_lectern_t")), "left_semi")
    again = Window.partitionBy("doc_id", "_lectern_text").orderBy(F.xxhash64(*docs.columns))
    once = held.withColumn("_lectern_nth", F.row_number().over(again)).filter("_lectern_nth = 1").drop("_lectern_nth", "_lectern_text")
    return once.unionByName(docs.filter("doc_id is null"))
