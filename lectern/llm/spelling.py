"""Spelling variants by a trie of letter-group counts.

Letters belong to groups; a word's frequency vector is its length and then its count of letters in each group. Words that
differ by one inserted, deleted or replaced letter differ in their counts by a surplus of at most one and a deficit of at
most one. So words are arranged in a trie whose levels are the successive counts, and a depth-first search for a word takes
every branch that its budget of one surplus and one deficit still pays for; words in the leaves that it reaches
are compared letter by letter.

The trie is spread over tasks: its upper levels (length and `depth` groups) are a shuffle key, a cell. Each word is
dealt to its own cell, to be found there, and as a searcher to the cells that its budget reaches. Each task builds the rest
of the trie for one cell's words at a time and searches it for that cell's searchers, in batches. A cell of more than
`most` rows is cut at the next level until it is small or the vector ends; of a full vector's cell each share of
the words meets each share of the searchers once. Every pair is met from one side only: a searcher looks for
longer words, and for words of its own length whose first difference is a surplus.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count as often
as they come; words of any length and letters are compared; ties are broken as the functions say; other columns of the
documents are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, join_spread, written

#: Letters with a group of their own, in the order of the levels; the others share REST groups by their code points.
SINGLE = "eaintrsoludc"
REST = 4
GROUPS = len(SINGLE) + REST
#: A node of at most so many words is a leaf.
LEAF = 32
#: Numbers that are compared at a time.
STEP = 1 << 22

CELL = "key binary, searching boolean, word string, n long"


def words(docs: DataFrame, shortest: int = 6, fewest: int = 5, slips: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters in ASCII lower case, of `shortest` letters and `fewest` occurrences at least.

    slips: of the runs whose crc32 of `doc_id:run` it divides, one letter is left out (the place is the rest by the run's length).
    """
    # a run that is too short can't become longer, and a greedy match of a long one takes all of it
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), run.alias("run"))
    ascii_only = F.length("run") == F.octet_length("run")
    found = found.select("d", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if slips:
        found = found.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.withColumn("word", F.when(F.col("h") % slips == 0, short).otherwise(F.col("word")))
    return found.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= shortest) & (F.col("n") >= fewest))


def _letters(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the words' lengths."""
    return np.frombuffer("".join(some).encode("utf-32-le"), "<u4"), np.fromiter(map(len, some), np.int64, len(some))


def group_of(letters: np.ndarray) -> np.ndarray:
    """The group of each code point."""
    out = len(SINGLE) + letters.astype(np.int64) % REST
    for k, c in enumerate(SINGLE):
        out[letters == ord(c)] = k
    return out


def vectors(some: list[str]) -> np.ndarray:
    """A row for each word: its length and its count of letters in each group."""
    letters, sizes = _letters(some)
    at = np.repeat(np.arange(len(some)), sizes) * GROUPS + group_of(letters)
    counts = np.bincount(at, minlength=len(some) * GROUPS).reshape(len(some), GROUPS)
    return np.column_stack([sizes, counts]).astype(np.int32)


def _down(own: np.ndarray, level: int, row: np.ndarray, path: np.ndarray, searching: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths one level longer. own: vectors; row: whose path it is. A searcher's budget is what its path doesn't use."""
    mine, flat = own[row], searching[row]
    longer = path[:, 0] > mine[:, 0] if level else np.zeros(len(row), bool)
    less = path[:, 1:] - mine[:, 1:level] if level > 1 else np.zeros((len(row), 0), np.int32)
    surplus, deficit = (less > 0).any(1), (less < 0).any(1) | longer
    here = mine[:, level]
    rows, paths = [], []
    # the same count, one more (a longer word, or a surplus), one less (a deficit, after a surplus)
    for step, may in ((0, np.ones(len(row), bool)), (1, flat & (~surplus if level else True)), (-1, flat & surplus & ~deficit & (here > 0) if level else flat & False)):
        rows.append(row[may])
        paths.append(np.column_stack([path[may], here[may] + step]))
    return np.concatenate(rows), np.concatenate(paths).astype(np.int32)


def _batch(keys: list[bytes], searching: np.ndarray, some: list[str], n: list[int], row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(searching[row]), pa.array(some, pa.string()).take(pa.array(row)), pa.array(n, pa.int64()).take(pa.array(row))], ["key", "searching", "word", "n"])


def _dealt(rows: DataFrame, levels: int) -> DataFrame:
    """Rows (key, searching, word, n) with keys that many levels longer, in every way that their budgets allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, searching = b["word"].to_pylist(), b["searching"].to_numpy(zero_copy_only=False).astype(bool)
            own, row = vectors(some), np.arange(b.num_rows)
            raw = b["key"].to_pylist()
            for size in sorted(set(map(len, raw))):
                mine = np.array([k for k, x in enumerate(raw) if len(x) == size], np.int64)
                path = np.frombuffer(b"".join([raw[k] for k in mine]), np.int32).reshape(len(mine), size // 4)
                row = mine
                for level in range(size // 4, min(size // 4 + levels, GROUPS + 1)):
                    row, path = _down(own, level, row, path, searching)
                data, width = path.tobytes(), 4 * path.shape[1]
                yield _batch([data[k : k + width] for k in range(0, len(data), width)], searching, some, b["n"].to_pylist(), row)

    return rows.mapInArrow(run, CELL)


def _crowded(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """rows (written), as those in small cells and those in cells of more than `most`."""
    cells = written(rows.groupBy("key").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > most), "crowded")
    if cells.isEmpty():
        return rows, rows.limit(0)
    share = rows.count() / 1000
    hot, others = cells.filter(F.col("n_rows") > share), cells.filter(F.col("n_rows") <= share)
    small = rows.join(F.broadcast(hot), "key", "left_anti").join(others.hint("merge"), "key", "left_anti")
    return small, join_spread(rows, cells, ["key"], "n_rows").drop("n_rows")


def _shares(rows: DataFrame, most: int) -> DataFrame:
    """Cells of equal vectors, cut so that each share of the words meets each share of the searchers in a cell of its own."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count_if(~F.col("searching")) / most).alias("w"), F.ceil(F.count_if("searching") / most).alias("q"), F.count("*").alias("n_rows"))
    cut = join_spread(rows, written(sizes, "shares"), ["key"], "n_rows")
    own = F.pmod(F.xxhash64("word"), F.when(F.col("searching"), F.col("q")).otherwise(F.col("w")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.when(F.col("searching"), F.col("w")).otherwise(F.col("q")), F.lit(1)) - 1))
    met = cut.select("key", "searching", "word", "n", own.alias("own"), other.alias("other"))
    pair = F.when(F.col("searching"), F.concat_ws(",", "other", "own")).otherwise(F.concat_ws(",", "own", "other"))
    return met.select(F.concat("key", F.lit(":").cast("binary"), pair.cast("binary")).alias("key"), "searching", "word", "n")


class _Cell:
    """The words of one cell, all of one length, as a trie: sorted vectors, whose nodes are ranges of rows."""

    def __init__(self, some: list[str], n: list[int]):
        own = vectors(some)
        order = np.lexsort(own.T[::-1])
        self.own = own[order]
        self.length = int(own[0, 0])
        self.words, self.n = [some[k] for k in order], [n[k] for k in order]
        self.letters = _letters(self.words)[0].reshape(len(some), self.length)

    def reach(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(searchers, words) that may be near, by a depth-first search with all searchers (rows of `own`) at once."""
        longer = own[:, 0] < self.length
        stack = [(1, 0, len(self.words), np.arange(len(own)), np.zeros(len(own), bool), longer)]
        while stack:
            level, low, high, who, surplus, deficit = stack.pop()
            if not len(who):
                continue
            if high - low <= LEAF or level > GROUPS:
                step = max(1, STEP // ((high - low) * GROUPS))
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    less = self.own[None, low:high, 1:] - own[some, None, 1:]
                    near = (np.maximum(less, 0).sum(2) <= 1) & (np.maximum(-less, 0).sum(2) <= 1)
                    q, w = np.nonzero(near)
                    yield some[q], low + w
                continue
            counts = self.own[low:high, level]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(counts)) + 1, [high - low]))
            wanted = own[who, level]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                step = counts[a] - wanted
                go = (step == 0) | ((step == 1) & ~surplus) | ((step == -1) & surplus & ~deficit)
                stack.append((level + 1, low + a, low + b, who[go], (surplus | (step == 1))[go], (deficit | (step == -1))[go]))

    def near(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(searchers, words) that differ by exactly one inserted, deleted or replaced letter."""
        own = vectors(some)
        letters, sizes = _letters(some)
        firsts = np.cumsum(sizes) - sizes
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for q, w in self.reach(own):
            for size, check in ((self.length, self._replaced), (self.length - 1, self._inserted)):
                mine = np.flatnonzero(sizes[q] == size)
                step = max(1, STEP // self.length)
                for at in range(0, len(mine), step):
                    a, b = q[mine[at : at + step]], w[mine[at : at + step]]
                    held = check(letters[firsts[a][:, None] + np.arange(size)], self.letters[b])
                    out.append((a[held], b[held]))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    @staticmethod
    def _replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows that differ in one place, where y has the surplus: a group before x's, or a greater letter of the same."""
        other = x != y
        one = np.flatnonzero(other.sum(1) == 1)
        at = other[one].argmax(1)
        p, q = x[one, at], y[one, at]
        gp, gq = group_of(p), group_of(q)
        return one[(gq < gp) | ((gq == gp) & (p < q))]

    @staticmethod
    def _inserted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows in which y is x with one more letter."""
        none = np.zeros((len(x), 1), bool)
        head = np.column_stack([x == y[:, :-1], none]).argmin(1)
        tail = np.column_stack([(x == y[:, 1:])[:, ::-1], none]).argmin(1)
        return np.flatnonzero(head + tail >= x.shape[1])


def _searched(rows: DataFrame) -> DataFrame:
    """(a, na, b, nb): near words of the cells, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some, n, cell = None, [], [], None
        for b in batches:
            keys = b["key"].to_pylist()
            searching, texts, ns = b["searching"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and searching[end] == searching[at]:
                    end += 1
                if keys[at] != key:
                    key, some, n, cell = keys[at], [], [], None
                if not searching[at]:
                    some += texts[at:end]
                    n += ns[at:end]
                elif some:
                    cell = cell or _Cell(some, n)
                    q, w = (x.tolist() for x in cell.near(texts[at:end]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([texts[at + k] for k in q], pa.string()), pa.array([ns[at + k] for k in q], pa.int64()), pa.array([cell.words[k] for k in w], pa.string()), pa.array([cell.n[k] for k in w], pa.int64())],
                        ["a", "na", "b", "nb"],
                    )
                at = end

    # of a cell, words come before searchers
    return rows.repartition("key").sortWithinPartitions("key", "searching").mapInArrow(run, "a string, na long, b string, nb long")


def near_pairs(found: DataFrame, depth: int = 3, most: int = 200_000) -> DataFrame:
    """(a, na, b, nb): the pairs of `found` (word, n; distinct) that differ by exactly one letter, each once; written."""
    both = found.select(F.lit(b"").alias("key"), F.explode(F.array(F.lit(False), F.lit(True))).alias("searching"), "word", "n")
    rows, pairs = written(_dealt(both, 1 + depth), "cells"), None
    for levels in range(1 + depth, GROUPS + 2):
        small, crowded = _crowded(rows, most)
        now = _searched(small)
        pairs = now if pairs is None else pairs.unionByName(now)
        if crowded.isEmpty():
            break
        if levels == GROUPS + 1:
            pairs = pairs.unionByName(_searched(_shares(written(crowded, "crowded"), most)))
            break
        rows = written(_dealt(crowded, 1), "cells")
    return written(pairs, "near")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of `forms` (word, form; no circles) along forms to the last one; written.

    Each round joins what is reached with what is reached from there, so paths double.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reached


def variants(found: DataFrame, times: int = 5, depth: int = 3, most: int = 200_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `found` (word, n; distinct).

    form: the near word of largest n (of equal ones the first in code-point order), if that is `times` the word's n at
    least; root: the last word along forms, the word itself if it has none.
    """
    found = written(found.select("word", "n"), "words")
    pairs = near_pairs(found, depth, most)
    ends = pairs.union(pairs.select("b", "nb", "a", "na"))
    # the least of (-n, word) is the first of the most frequent
    best = ends.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("form"))).alias("best"))
    known = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.form", (-F.col("best.n")).alias("form_n"))
    holds = F.col("form_n") >= times * F.col("n")
    known = written(known.select("word", "n", "n_near", F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "forms")
    roots = followed(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
