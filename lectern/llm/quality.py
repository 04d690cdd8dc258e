"""Quality rules: counts within a document, and lines that recur across the documents of a host.

Lines are normalised (lower case, digits as 0, single spaces) and hashed. For each host (the column
`source`), the distinct documents that hold a line are counted; a document is its doc_id, where that is null its
text. With `copies="once"` exact copies of a text count as one document, for corpora whose copies another operator
drops later. A line is removed from a document if at least `min_docs`
documents of its host hold it, and at least `min_share` of them or `most_docs`, whichever is less; a document that
keeps less than `min_left` of its words, or fewer than `min_words`, is depleted and rejected. `clean` gives the texts
without those lines, `judge` the counts and verdicts. Only built-in functions are used.

Lines are written once and used for counting and removing. Counts are made with partial sums before each shuffle,
first by host, line and document, so a host or line that a third of all documents share is dealt by document; only
lines at or above the limit are joined back, the few that hold more than a thousandth of these lines by a broadcast.

Defined results: a null text has no words, so it fails the base rules; a null host is a host of its own;
rows with one doc_id are judged each by its own text; repeated rows come out as often as they go in;
columns of other names are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WS, WS_RE, join_spread, let, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """How many words of the array lie in windows of `width` words that occur twice or more in it.

    Windows are compared by a 64-bit hash. Only where some hash occurs twice are they sorted with their
    places: places of equal neighbours, in order, each cover `width` words or up to the next place.
    """
    at = lambda i: F.get(w, i)
    hashes = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(at(i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1), p + width) - p).cast("bigint"))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def twice(sorted_: Column) -> Column:
        same = lambda p, k: (F.coalesce(F.get(sorted_, k + 1)["h"] == p["h"], F.lit(False))) | ((k > 0) & F.coalesce(F.get(sorted_, F.greatest(k - 1, F.lit(0)))["h"] == p["h"], F.lit(False)))
        return let(F.sort_array(F.transform(F.filter(sorted_, same), lambda p: p["i"])), covered)

    def count(h: Column) -> Column:
        slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(slow)

    return let(hashes, count)


def repeated_lines(text: Column) -> Column:
    """How many lines that hold a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns to keep, th (hash of the text) and the base counts with base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"))
    bare = F.length(F.translate(F.col("_t"), WS, ""))
    # both counts of words in one expression: a filter on them that is pushed down still splits the text once
    of_words = let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    m = rows.select(
        *keep, F.xxhash64("_t").alias("th"), of_words.alias("_w"), bare.cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate(F.col("_t"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"), repeated_lines(F.col("_t")).alias("n_dup_lines"),
    )
    counts = m.select(*keep, "th", "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, th, pos, line (hash of host and line) and words of each line that holds a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.btrim("raw", F.lit(WS))).filter("raw <> ''")
    plain = F.regexp_replace(F.regexp_replace(F.lower("raw"), WS_RE, " "), "[0-9]", "0")
    return rows.select("doc_id", "host", "th", "pos", F.xxhash64("host", plain).alias("line"), F.size(F.split("raw", WS_RE)).cast("bigint").alias("words"))


def _document(copies: str) -> list[Column]:
    """What makes two rows (doc_id, th) one document."""
    if copies not in ("each", "once"):
        raise ValueError(f"copies are counted each or once, not {copies!r}")
    return [F.col("th")] if copies == "once" else [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("th")).alias("th")]


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int = 10, min_share: float = 0.002, most_docs: int = 100, copies: str = "each") -> DataFrame:
    """(host, line, n_docs) of the lines to remove; lines: of `docs`; copies: whether copies of a text count each or once."""
    held = lines.select("host", "line", *_document(copies)).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hosts = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("th")).select("host", *_document(copies)).distinct().groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("host_docs"))
    limit = F.least(F.lit(min_share) * F.col("host_docs"), F.lit(float(most_docs)))
    return held.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n_docs") >= limit).select("host", "line", "n_docs")


def _decided(docs: DataFrame, whole: bool, min_left: float = 0.5, min_words: int = 10, **limits) -> DataFrame:
    """The measures of each row with n_removed_words, places (of the lines to remove, from 0) and kept; whole: also row, a struct of all columns."""
    lines = written(_lines(docs), "lines")
    often = written(frequent_lines(docs, lines, **limits).select("line", "n_docs"), "frequent")
    hit = join_spread(lines, often, ["line"], "n_docs")
    # rows with the same doc_id, host and text have the same lines, which count once
    removed = hit.select("doc_id", "host", "th", "pos", "words").distinct().groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("th").alias("_th"))
    removed = removed.agg(F.sum("words").alias("n_removed"), F.collect_list("pos").alias("places"))  # no more places than the text has lines
    rows = docs.select("doc_id", "source", "text", *([F.struct(*docs.columns).alias("row")] if whole else []))
    m = measures(rows, ("doc_id", "source", *(["row"] if whole else [])))
    same = m["doc_id"].eqNullSafe(removed["_id"]) & m["source"].eqNullSafe(removed["_host"]) & (m["th"] == removed["_th"])
    j = m.join(removed, same, "left").withColumn("n_removed_words", F.coalesce("n_removed", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_left * F.col("n_words")) | (left < min_words))
    return j.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed_words and kept for each row of docs."""
    return _decided(docs, False, **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, their texts without the lines that are frequent in their host."""
    lines = F.filter(F.split(F.col("row.text").cast("string"), "\n"), lambda x, i: ~F.array_contains(F.col("places"), i))
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    kept = _decided(docs, True, **limits).filter("kept")
    return kept.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def judge_sql(min_docs: int = 10, min_share: float = 0.002, most_docs: int = 100, min_left: float = 0.5, min_words: int = 10, copies: str = "each") -> str:
    """DuckDB SQL for the result of `judge` over the table documents, whose doc_ids are distinct."""
    ws = "[\\x20\\x09-\\x0D]+"
    line_document, document = ("th", "md5(t)") if copies == "once" else ("doc_id", "doc_id")
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w FROM documents),
    gram AS (SELECT doc_id, i, list_slice(w, i, i + 4)::VARCHAR AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
    rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM again GROUP BY doc_id),
    line AS (SELECT doc_id, source, md5(t) AS th, raw, len(list_filter(regexp_split_to_array(raw, '{ws}'), lambda x: x <> '')) AS n FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw FROM d)),
    word_line AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(raw, '^{ws}', ''), '{ws}$', '')), '{ws}', ' ', 'g'), '[0-9]', '0', 'g') AS plain FROM line WHERE n > 0),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM word_line GROUP BY doc_id),
    often AS (SELECT l.source, l.plain FROM (SELECT source, plain, count(DISTINCT {line_document}) AS n FROM word_line GROUP BY source, plain) l
              JOIN (SELECT source, count(DISTINCT {document}) AS n FROM d GROUP BY source) h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n >= {min_docs} AND l.n >= least({min_share} * h.n, {most_docs})),
    gone AS (SELECT doc_id, sum(n) AS n FROM word_line l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.plain = o.plain GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
          FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
      (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {min_left} * n_words OR n_words - n_removed_words < {min_words})) AS kept,
      n_removed_words::BIGINT AS n_removed_words
    FROM m
    """
