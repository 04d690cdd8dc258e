"""Toxicity by maximum-scoring segments.

Units of a text are its words in lower case and the words' first four, five and six letters. From
labelled documents, each unit gets a log-odds ratio between toxic and other documents under an
informative Dirichlet prior (Monroe, Colaresi, Quinn 2008); units that stand out by at least `min_z`
standard errors score, all other words cost `gap`. A linear scan (Ruzzo, Tompa 1999) finds all maximal
segments of a text. Segment sums follow an extreme-value law (Karlin, Altschul 1990): lambda solves
sum p(s) exp(lambda s) = 1 over the scores of words of other documents, K comes from their best
segments, and a segment is significant if so good a one is expected at most `max_expected` times in
a text of the same length. A document's evidence is the surprise of its best segment and the number
of its significant ones; a logistic curve turns it into a probability.

What is learnt: weights from labelled documents with crc32(doc_id) mod 5 in 1, 2, 3; the curve from
those with 4; 0 is never looked at. At most about `most_labelled` labelled documents are used, chosen by
a hash of doc_id, and copies of one text count once, so the model is bounded and goes to executors whole.

Defined results: null and empty texts get the probability of no evidence; a document with several labels
is toxic if one of them says so; labels without a document teach nothing; with no labels at all every
score is 0.1; repeated rows are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import hashed_sample, written

WORD = re.compile(r"\w+")


def lowered(text: str | None) -> str:
    """text in lower case, as long as it was: the one letter whose lower case is two code points becomes one."""
    return (text or "").replace("\u0130", "i").lower()

STEMS = (4, 5, 6)
FOLDS = 5


def fold(doc_id):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def units(word: str) -> list[str]:
    """The word itself, and its beginnings (marked)."""
    return [word, *(f"{word[:k]}~" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, ...] = (float(np.log(0.1 / 0.9)), 0.0, 0.0)
    gap: float = 0.5
    max_expected: float = 0.01

    def word(self, w: str) -> float:
        return max((self.weight[u] for u in units(w) if u in self.weight), default=0.0)

    def surprise(self, score: float, n_words: int) -> float:
        """-log10 of how many segments as good are expected in a text of n_words words of the other kind."""
        return (self.lam * score - np.log(self.k * max(n_words, 1))) / np.log(10)


def segments(scores: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first word, last word, sum); a word without a score costs gap.

    Linear in the number of scoring words: what lies between two of them is one negative sum.
    """
    at = np.flatnonzero(scores)
    stack: list[list[float]] = []  # first, last, sum before, sum up to the end
    total, end = 0.0, 0
    for i in at.tolist():
        total -= gap * (i - end)
        left, right = total, total + scores[i]
        total, end = right, i + 1
        new = [i, i, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(int(a), int(b), r - x) for a, b, x, r in stack]


def once_in_a_row(words: list[str], scores: Iterable[float]) -> np.ndarray:
    """The scores, but 0 for a word that repeats the one before it: a stutter is no more evidence than the word."""
    out = np.fromiter(scores, float, len(words))
    for i in np.flatnonzero(out).tolist()[::-1]:
        if i and words[i] == words[i - 1]:
            out[i] = 0.0
    return out


class Scorer:
    """Looks words up once for each worker."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most, self.known = model, most, {}

    def evidence(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """Words, surprise of the best segment (0: none), and the significant passages (start, stop in characters, surprise)."""
        low = lowered(text)
        words = WORD.findall(low)
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.model.word(w)
        scores = once_in_a_row(words, map(known.__getitem__, words))
        if not scores.any():
            return len(words), 0.0, []
        best, kept = 0.0, []
        for a, b, s in segments(scores, self.model.gap):
            x = self.model.surprise(s, len(words))
            best = max(best, x)
            if x >= -np.log10(self.model.max_expected):
                kept.append((a, b, x))
        spans = [m.span() for m in WORD.finditer(low)] if kept else []
        return len(words), best, [(spans[a][0], spans[b][1], float(x)) for a, b, x in kept]

    def probability(self, best: float, n: int) -> float:
        a, b, c = self.model.curve
        z = max(a + b * strength(best) + c * float(np.log1p(n)), -30.0)
        # far up, where a double would be 1, the order of the evidence stays
        return float(1 / (1 + np.exp(-(z if z <= 20 else 20 + np.log1p(z - 20)))))


def strength(best: float) -> float:
    """The surprise of a best segment as the curve sees it: past 30 it still grows, but slowly."""
    return best if best <= 30 else 30 + float(np.log(best / 30))


def _in_tasks(tune: DataFrame, model: Model) -> DataFrame:
    """Of each text (text, toxic): toxic, words, the sum of its best segment, its surprise, how many significant ones, and its scores above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = []
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                words = WORD.findall(lowered(text))
                scores = once_in_a_row(words, [model.word(w) for w in words])
                top = max((s for _, _, s in segments(scores, model.gap)), default=0.0)
                _, best, kept = scorer.evidence(text)
                out.append((int(toxic), len(words), top, best, len(kept), scores[scores > 0].tolist()))
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["toxic", "words", "top", "best", "kept", "scores"])

    return tune.mapInArrow(run, "toxic int, words long, top double, best double, kept long, scores array<double>")


def _counts(train: DataFrame) -> DataFrame:
    """unit, toxic, n: documents with the unit, from (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            met: Counter = Counter()
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                met.update((u, toxic) for u in {u for w in set(WORD.findall(lowered(text))) for u in units(w)})
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in met], pa.string()), pa.array([t for _, t in met], pa.int32()), pa.array(list(met.values()), pa.int64())], ["unit", "toxic", "n"])

    return train.mapInArrow(run, "unit string, toxic int, n long").groupBy("unit").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("yes"), F.sum(F.expr("if(toxic = 1, 0, n)")).alias("no"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients (constant first) by Newton's method, with a ridge on the others."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lambda(rate: float, mean_exp, gap: float) -> float:
    """The positive root of (1 - rate) exp(-lambda gap) + rate E exp(lambda s) = 1."""
    lo, hi = 1e-6, 1.0
    f = lambda x: (1 - rate) * np.exp(-x * gap) + rate * mean_exp(x) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000, min_z: float = 2.5, min_docs: int = 3, min_share: float = 0.01, prior: float = 0.05, gap: float = 0.5) -> Model:
    """A model of bounded size: at most about `most_labelled` documents take part.

    prior: weight of the prior, as a share of the documents learnt from. min_docs, min_share: a unit
    scores if it is in so many toxic documents at least, and in so large a share of them.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    known = F.broadcast(hashed_sample(known.filter(fold("_id") != 0), F.col("_id"), most_labelled, "toxicity"))  # most_labelled rows, give or take
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(known, "_id")
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("_id", "_toxic", "text")).alias("r"))
    once = written(once.select(fold("r._id").alias("fold"), F.col("r._toxic").alias("toxic"), "r.text"), "labelled")
    learn, tune = once.filter(F.col("fold") != FOLDS - 1).select("text", "toxic"), once.filter(F.col("fold") == FOLDS - 1).select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_yes, n_no = n.get(1, 0), n.get(0, 0)
    if not n_yes + n_no:
        return Model(gap=gap)

    # log-odds under a Dirichlet prior in proportion to each unit's share of all documents
    weight_of_prior = prior * (n_yes + n_no)
    a = F.lit(weight_of_prior / (n_yes + n_no)) * (F.col("yes") + F.col("no"))
    odds = lambda y, m: F.log((F.col(y) + a) / F.greatest(F.lit(m + weight_of_prior) - F.col(y) - a, F.lit(0.5)))
    delta, error = odds("yes", n_yes) - odds("no", n_no), F.sqrt(1 / (F.col("yes") + a) + 1 / (F.col("no") + a))
    found = _counts(learn).filter(F.col("yes") >= max(min_docs, min_share * n_yes)).select("unit", delta.alias("w"), (delta / error).alias("z"))
    # bounded: each unit has min_docs of the labelled documents
    weight = {r["unit"]: r["w"] for r in found.filter((F.col("z") >= min_z) & (F.col("w") >= 1)).collect()}
    model = Model(weight, gap=gap)

    # the law of segment sums in documents of the other kind; a row for each text of the last fold comes here, but no text
    held = written(_in_tasks(tune, model), "tuned")
    others = [(r["words"], r["top"]) for r in held.filter("toxic = 0").select("words", "top").collect()]
    # no more rows than there are weights
    rates = Counter({r["s"]: float(r["n"]) for r in held.filter("toxic = 0").select(F.explode("scores").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()})
    for w in weight.values():  # half a word is taken to have been met besides
        rates[w] += 0.5 / len(weight)
    draws, mass = np.array(list(rates) or [1.0]), np.array(list(rates.values()) or [0.5])
    model.lam = _lambda(min(float(mass.sum()) / (sum(m for m, _ in others) + 1), 0.2), lambda x: float((mass * np.exp(x * draws)).sum() / mass.sum()), gap)
    model.k = float(np.clip((sum(s > 0 for _, s in others) + 0.5) / (sum(m * np.exp(-model.lam * s) for m, s in others) + 1), 1e-6, 1.0))

    found = _in_tasks(tune, model).select("toxic", "best", "kept").collect()
    truth = np.array([r["toxic"] for r in found], float)
    if 0 < truth.sum() < len(truth):
        model.curve = tuple(float(c) for c in _logistic(np.array([(strength(r["best"]), np.log1p(r["kept"])) for r in found]), truth))
    else:
        model.curve = (float(np.log((n_yes + 0.1) / (n_no + 0.9))), 0.5, 0.5)
    return model


def score(docs: DataFrame, model: Model, named: tuple[str, str] = ("toxicity", "toxic_passages"), keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with toxicity (0 to 1) and toxic_passages: start, stop (characters) and surprise of each significant one.

    named: what to call these two; columns of docs with the same names are replaced. keep: which columns
    of docs to return (default: all), since what is returned passes through the workers.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # so few texts at a time are Python objects
                b = whole.slice(at, 256)
                p, spans = [], []
                for text in b["_lectern_text"].to_pylist():
                    _, best, kept = s.evidence(text)
                    p.append(s.probability(best, len(kept)))
                    spans.append([{"start": x, "stop": y, "surprise": z} for x, y, z in kept])
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(p, pa.float64()), pa.array(spans, kind)], [*names, *named])

    names = [c for c in (docs.columns if keep is None else keep) if c not in named]
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    kept = docs.select(*names)
    sent = docs.select(*names, text.alias("_lectern_text"))
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("surprise", T.DoubleType())])
    out = T.StructType([*kept.schema.fields, T.StructField(named[0], T.DoubleType()), T.StructField(named[1], T.ArrayType(passage))])
    return sent.mapInArrow(run, out)
