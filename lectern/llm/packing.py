"""Best-fit packing by a configuration linear program over the length histogram.

Pieces of documents go into sequences of at most `size` tokens, as few as possible. The driver sees only
the histogram of piece lengths (at most `size` numbers, whatever the corpus). The linear program has a
row for each length and a column for each configuration (a multiset of lengths that fits); it is solved
by multiplicative weights: each round prices lengths by their weights, a knapsack dynamic program finds
configurations of the largest price, they are raised by a small step, and the weights of the lengths that
they cover shrink. Every pricing gives a lower bound on the optimum; where the sequences are not within a
stated gap of the best bound, the columns' own dual prices re-weight the lengths, with the same knapsack, until
the fractional value is. Rounding takes whole multiples of the configurations as far as pieces last, and what
the fractions leave (a number bounded by the number of configurations) goes by best fit, largest first.

The plan is a table of slots: for each length, which ranks go into which configuration. Pieces get their
rank among those of their length from counts by length and salt; there are at least SALTS salts, and one for each PART
pieces of the corpus, so no task sees more than some PART pieces of a length. They find their slots by binary search in the plan, which goes to
the tasks whole: it has at most rounds x pricings x `size` configurations of fewer than 91 different lengths each,
and what best fit adds for the rest.

Defined results: a null text is an empty one, so its one piece is the closing id alone; repeated rows
are packed as often as they come; columns of other names are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.tokens import public_tokenizer, word_ids

SIZE = 4096
END_ID = 1
#: Into how many parts the pieces of one length are dealt at least, and how many pieces of all there are to a part beyond that.
SALTS, PART = 256, 100_000


def cut(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and row, a number for the row of docs."""
    path = tokenizer or public_tokenizer()
    closing = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc, ids in zip(b["doc_id"].to_pylist(), word_ids(path).encode_batch(b["text"].to_pylist()), strict=True):
                ids = memoryview(ids + closing)
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), row))
                row += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def _knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity: the best total price, and the length to take first there (0: leave one token empty).

    price: by length, negative where there are none. Of equal choices the longest is taken.
    """
    size = len(price) - 1
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    longest_first, value = np.ascontiguousarray(price[:0:-1]), np.empty(size)
    for c in range(1, size + 1):
        now = np.add(longest_first[size - c :], best[:c], out=value[:c])
        i = int(now.argmax())
        if now[i] >= best[c - 1]:
            best[c], take[c] = now[i], c - i
        else:
            best[c] = best[c - 1]
    return best, take


def _with(first: int, best: np.ndarray, take: np.ndarray) -> Counter:
    """The best configuration with a piece of length `first`."""
    has, c = Counter({first: 1}), len(best) - 1 - first
    while c > 0 and best[c] > 0:
        if k := int(take[c]):
            has[k] += 1
        c -= k or 1
    return has


def fractional(counts: np.ndarray, rounds: int = 5, step: float = 0.05, pricings: int = 10) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """How often to use each configuration ((length, times), ...): every length is covered, nearly as few in all as the program allows.

    counts: pieces by length. Weights begin at the volume of each length, the prices of a perfect
    packing. A round covers 1/rounds of each length; covering a length's share lowers its weight by
    exp(-step). After `pricings` knapsacks, what a round still lacks is covered all the same.
    Also the best lower bound that the prices gave on the number of sequences.
    """
    size = len(counts) - 1
    there = np.flatnonzero(counts)
    share = counts / rounds
    weight = np.arange(size + 1) / size
    used: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    bound = 0.0
    for _ in range(rounds):
        need = share.copy()
        for pricing in range(pricings):
            open_ = need > share * 1e-3
            if not open_[there].any():
                break
            best, take = _knapsack(np.where(open_, weight, -1.0))
            bound = max(bound, float((counts * weight)[open_].sum() / best[-1]))
            for first in there[::-1].tolist():  # the best configuration with each length, longest first
                if need[first] <= share[first] * 1e-3:
                    continue
                has = _with(first, best, take)
                last = pricing == pricings - 1
                times = need[first] / has[first] if last else min(need[k] / n for k, n in has.items())
                if times > 0:
                    used[tuple(sorted(has.items(), reverse=True))] += times
                    for k, n in has.items():
                        need[k] -= min(need[k], times * n)
                        weight[k] *= np.exp(-step * times * n / share[k])
        weight[there] *= there.sum() / size / weight[there].sum()
    return used, bound


def reweighted(counts: np.ndarray, gap: float, at_once: int = 50, work: float = 4e9) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """How often to use each configuration, within `gap` of the lower bound that comes with it, or as near as `work` allows.

    The lengths are weighted by the dual prices of a basis of configurations. After a knapsack, up to `at_once` of the
    best configurations that are worth more than one sequence enter the basis. It begins with each length alone. It ends
    when changes of the basis, times the square of the number of lengths, come to `work`; every basis covers all pieces.
    Sums are numpy's own loops: a configuration holds few lengths, and a linear algebra library's threads were seen to hang here.
    """
    size, there = len(counts) - 1, np.flatnonzero(counts)
    place, need = {int(k): i for i, k in enumerate(there)}, counts[there]
    held = [Counter({int(k): size // int(k)}) for k in there]
    price, bound, entered = np.full(size + 1, -1.0), 0.0, 0
    moved = True
    inverse = np.diag(1.0 / (size // there))
    x = need / (size // there)

    def times_inverse(has: Counter) -> np.ndarray:
        at = [place[k] for k in has]
        return (inverse[:, at] * np.fromiter(has.values(), float, len(has))).sum(axis=1)

    while True:
        dual = inverse.sum(axis=0)
        price[there] = dual
        best, take = _knapsack(price)
        bound = max(bound, min(float(x.sum()), float((dual * need).sum())) / float(best[-1]))
        if x.sum() <= bound * (1 + gap) or not moved or entered * len(there) ** 2 >= work:
            return {tuple(sorted(has.items(), reverse=True)): float(n) for has, n in zip(held, x) if n > 0}, bound
        worth = price[there] + best[size - there]
        moved = False
        for i in np.argsort(-worth, kind="stable")[:at_once].tolist():
            has = _with(int(there[i]), best, take)
            value = sum(float(dual[place[k]]) * n for k, n in has.items())
            if value <= 1 + 1e-9:
                continue
            d = times_inverse(has)
            ratio = np.full(len(x), np.inf)
            np.divide(x, d, out=ratio, where=d > 1e-9)
            r = int(ratio.argmin())
            times, row = max(ratio[r], 0.0), inverse[r] / d[r]
            x -= times * d
            x[r] = times
            inverse -= np.outer(d, row)
            inverse[r] = row
            dual = dual + (1 - value) * row
            held[r] = has
            entered, moved = entered + 1, True
            if entered % 500 == 0:  # a Newton step against rounding errors
                wrong = np.eye(len(there)) - np.stack([times_inverse(h) for h in held], axis=1)
                inverse = inverse + np.einsum("ij,jk->ik", wrong, inverse)
                x, dual = np.maximum((inverse * need).sum(axis=1), 0.0), inverse.sum(axis=0)


def _best_fit(left: dict[int, int], size: int) -> Counter:
    """Best fit, largest first, for counts of lengths: how often each filling (lengths, descending) occurs."""
    room: list[int] = []  # capacities that some open sequences have, ascending
    fillings: dict[int, list[list]] = defaultdict(list)  # by capacity left: [filling, count]
    done: Counter = Counter()

    def put(filling: tuple[int, ...], capacity: int, n: int) -> None:
        if capacity == 0:
            done[filling] += n
            return
        if not fillings[capacity]:
            insort(room, capacity)
        fillings[capacity].append([filling, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            i = bisect_left(room, length)
            if i == len(room):
                each = size // length
                full, rest = divmod(n, each)
                for times, k in ((full, each), (1, rest)):
                    if times and k:
                        put((length,) * k, size - length * k, times)
                break
            capacity = room[i]
            filling, m = fillings[capacity].pop()
            if not fillings[capacity]:
                room.pop(i)
            k = min(n, m)
            if m > k:
                put(filling, capacity, m - k)
            put((*filling, length), capacity - length, k)
            n -= k
    for some in fillings.values():
        for filling, n in some:
            done[filling] += n
    return done


def _rounded(used: dict[tuple[tuple[int, int], ...], float], histogram: dict[int, int], size: int) -> Counter:
    """Whole multiples of the configurations, and best fit for what they leave."""
    left = dict(histogram)
    out: Counter = Counter()
    for has, times in sorted(used.items(), key=lambda x: (-sum(k * n for k, n in x[0]), x[0])):  # fullest first
        whole = min(int(times + 0.5), *(left[k] // n for k, n in has))
        if whole > 0:
            out[tuple(k for k, n in has for _ in range(n))] += whole
            for k, n in has:
                left[k] -= whole * n
    out.update(_best_fit({n: c for n, c in left.items() if c}, size))
    return out


def plan(histogram: dict[int, int], size: int = SIZE, gap: float = 0.001) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths) and how many sequences take each; together they hold exactly the histogram's pieces.

    Where multiplicative weights or plain best fit are not within `gap` of the lower bound, the program is solved to
    that gap, or as near as a bound on the work allows, and then rounded, which adds less than one sequence for each
    length. The smallest of these plans is taken.
    """
    if not histogram:
        return []
    counts = np.zeros(size + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, bound = fractional(counts)
    plans = [_rounded(used, histogram, size), _rounded({}, histogram, size)]
    if min(p.total() for p in plans) > -(-bound // 1) * (1 + gap):
        plans.append(_rounded(reweighted(counts, gap)[0], histogram, size))
    return sorted(min(plans, key=Counter.total).items(), reverse=True)


def _slots(fillings: list[tuple[tuple[int, ...], int]], shift: int = 40) -> tuple[np.ndarray, ...]:
    """Sorted keys (length << shift | first rank), and for each: first rank, pieces of the length in a sequence, first sequence, offset."""
    ranks: Counter = Counter()
    rows, first = [], 0
    for filling, times in fillings:
        offset = 0
        for length, n in Counter(filling).items():  # in the filling's order
            rows.append(((length << shift) | ranks[length], ranks[length], n, first, offset))
            ranks[length] += n * times
            offset += n * length
        first += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows)))


def place(pieces: DataFrame, size: int = SIZE, shift: int = 40) -> DataFrame:
    """The pieces (from `cut`, written) with sequence_id and offset."""
    salts = max(SALTS, pieces.count() // PART)
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    counts = written(dealt.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = _slots(plan(histogram, size), shift) or (np.zeros(0, np.int64),) * 5
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sent = pieces.sparkSession.sparkContext.broadcast(slots)
    kept = ("doc_id", "piece", "start", "length", "ids_crc32", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, each, firsts, offsets = sent.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(keys, (length << shift) | rank, side="right") - 1
            copy, k = np.divmod(rank - starts[at], each[at])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(firsts[at] + copy), pa.array(offsets[at] + k * length)], [*kept, "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    ranked = dealt.withColumn("nth", nth).join(bases.hint("merge"), ["length", "salt"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (a number for the row of docs), sequence_id, offset for every piece of every document."""
    return place(written(cut(docs, size, end_id, tokenizer), "pieces"), size)
