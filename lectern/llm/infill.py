"""Fill-in-middle transformation by displacement scatter, and its inverse.

A text's lines are its units. Two cuts between units, drawn from a hash of doc_id, make a prefix, a middle and a suffix,
which are written in another order with a mark before each:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

The texts of a batch are one run of bytes. A scan of its line ends finds the cuts; every byte of a segment moves by the
same number of places, so a difference array holds the change of that number where a segment begins, its cumulative sum
is each byte's displacement, and one numpy scatter writes the batch's output. `restore` finds the marks, builds the same
displacements from the output's segments and gathers the bytes back.

Defined results: a null text is an empty one; a text that is empty or holds a mark is left as it is (form plain); a null
doc_id draws as an empty one; rows come out as often as they go in, with all of their columns, and rows with one doc_id draw
the same numbers; a column of a result's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lectern.llm.bytebpe import _replaced as replaced
from lectern.llm.bytebpe import _sizes as sizes_of
from lectern.llm.bytebpe import _steps as steps

#: Marks of the prefix, the suffix and the middle, 3 bytes each.
P, S, M = b"<P>", b"<S>", b"<M>"
MARK = re.compile(rb"<[PSM]>")
#: Bytes of text that are worked on at a time (one text at least), and bytes that are moved at a time.
STEP, BLOCK = 1 << 22, 1 << 20


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits, from the sha256 of `seed:doc_id`."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins (and the last ends)."""
    column = column.cast(pa.string())
    starts = np.concatenate(([0], np.cumsum(sizes_of(column))))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, starts


def _displaced(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(bytes, where they belong in the output), a block at a time. starts: of segments, in order; shifts: of each one's bytes."""
    change = np.diff(shifts, prepend=0)
    carried = 0
    for at in range(0, size, BLOCK):
        end = min(at + BLOCK, size)
        step = np.zeros(end - at, np.int64)
        a, b = np.searchsorted(starts, [at, end])
        np.add.at(step, starts[a:b] - at, change[a:b])  # empty segments begin where the next one does
        step[0] += carried
        shift = np.cumsum(step)
        carried = shift[-1]
        yield slice(at, end), np.arange(at, end) + shift


def _texts(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _characters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many characters begin between successive bounds (in order) of the bytes."""
    leads = np.append((data & 0xC0) != 0x80, False)
    return np.where(np.diff(bounds) > 0, np.add.reduceat(leads, bounds, dtype=np.int64)[:-1], 0)


def _scatter(texts: pa.Array, draw: np.ndarray, rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts. draw: a row of four numbers for each."""
    data, starts = _flat(texts)
    begin, end = starts[:-1], starts[1:]
    after = np.flatnonzero(data == 10) + 1  # where a unit ends
    first, last = np.searchsorted(after, begin, "right"), np.searchsorted(after, end, "right")
    open_end = (end > begin) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else np.zeros(len(begin), bool)
    n = last - first + open_end
    raw = data.tobytes()
    plain = (begin == end) | (draw[:, 2] % 100 >= rate)
    held = np.array([m.start() for m in MARK.finditer(raw)], np.int64)
    inside = np.searchsorted(held, begin) < np.searchsorted(held, end - len(P), "right")
    plain |= inside & (end - begin >= len(P))

    def place(unit: np.ndarray) -> np.ndarray:
        """The byte after that many units of each text."""
        known = np.append(after, 0)[np.minimum(first + unit - 1, len(after))]
        return np.where(unit == 0, begin, np.where(unit > last - first, end, known))

    one, two = draw[:, 0] % (n + 1), draw[:, 1] % (n + 1)
    a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
    a, b = np.where(plain, begin, a), np.where(plain, begin, b)
    swapped = ~plain & (draw[:, 3] % 100 < spm)
    out = np.concatenate(([0], np.cumsum(end - begin + np.where(plain, 0, 3 * len(P)))))
    at, prefix, middle, suffix = out[:-1], a - begin, b - a, end - b
    # where each segment's bytes go; a plain text is all suffix
    to_prefix = np.where(swapped, at + 6 + suffix, at + 3)
    to_suffix = np.where(plain, at, np.where(swapped, at + 3, at + 6 + prefix))
    to_middle = at + 9 + prefix + suffix
    segments = np.stack([begin, a, b], 1).ravel()
    shifts = (np.stack([to_prefix, to_middle, to_suffix], 1) - np.stack([begin, a, b], 1)).ravel()
    output = np.empty(out[-1], np.uint8)
    for part, where in _displaced(len(data), segments, shifts):
        output[where] = data[part]
    for mark, where in ((P, to_prefix), (S, to_suffix), (M, to_middle)):
        output[where[~plain, None] + np.arange(-3, 0)] = np.frombuffer(mark, np.uint8)
    chars = _characters(data, np.append(segments, len(data))).reshape(-1, 3)
    form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (chars[:, 0], chars[:, 1])]
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, _texts(output, out)]


def _gather(outputs: pa.Array, forms: list[str | None]) -> pa.Array:
    """The texts whose outputs those are."""
    data, starts = _flat(outputs)
    begin, end = starts[:-1], starts[1:]
    plain, swapped = np.array([f not in ("psm", "spm") for f in forms], bool), np.array([f == "spm" for f in forms], bool)
    held = {m: [] for m in (P, S, M)}
    for m in MARK.finditer(data.tobytes()):
        held[m.group()].append(m.start())

    def mark(kind: bytes) -> np.ndarray:
        """The first such mark in each output (a plain one: its beginning)."""
        places = np.array(held[kind] + [len(data)], np.int64)
        found = places[np.searchsorted(places[:-1], begin)]
        if (found[~plain] >= end[~plain]).any():
            raise ValueError(f"an output without its mark {kind.decode()}")
        return np.where(plain, begin, found)

    p, s, m = mark(P), mark(S), mark(M)
    prefix = np.where(plain, 0, np.where(swapped, m, s) - p - 3)
    suffix = np.where(plain, end - begin, np.where(swapped, p, m) - s - 3)
    middle = np.where(plain, 0, end - m - 3)
    text = np.concatenate(([0], np.cumsum(prefix + middle + suffix)))
    at = text[:-1]
    segments = np.stack([at, at + prefix, at + prefix + middle], 1).ravel()
    sources = np.stack([p + 3, m + 3, np.where(plain, begin, s + 3)], 1).ravel()
    restored = np.empty(text[-1], np.uint8)
    for part, where in _displaced(len(restored), segments, sources - segments):
        restored[part] = data[where]
    return _texts(restored, text)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, text: str = "text") -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars (null if plain) and output.

    rate: per cent of the texts that are transformed; spm: per cent of those with the suffix first.
    """
    names = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}
    hashes = [f"_lectern_h{k}" for k in range(4)]
    df = docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    schema = replaced(df, names)
    kept = [f.name for f in schema.fields if f.name not in names]
    df = df.select(*kept, *(h.alias(name) for h, name in zip(draws(F.col("doc_id"), seed), hashes, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, sizes_of(whole[text]), STEP):
                draw = np.stack([b[h].to_numpy(zero_copy_only=False) for h in hashes], 1)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *_scatter(b[text], draw, rate, spm)], [*kept, *names])

    return df.mapInArrow(run, schema)


def restore(transformed: DataFrame, output: str = "output") -> DataFrame:
    """transformed with restored, the exact text, from output and form."""
    schema = replaced(transformed, {"restored": StringType()})
    kept = [f.name for f in schema.fields if f.name != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, sizes_of(whole[output]), STEP):
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), _gather(b[output], b["form"].to_pylist())], [*kept, "restored"])

    return transformed.mapInArrow(run, schema)


def transform_sql(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """The digests of the query, for DuckDB."""
    h = lambda k: f"('0x' || substr(d, {1 + 8 * k}, 8))::BIGINT"
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT *, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h(2)} % 100 >= {rate} AS plain,
    {h(0)} % (len(u) + 1) AS one, {h(1)} % (len(u) + 1) AS two, {h(3)} % 100 < {spm} AS swapped FROM units),
cut AS (
  SELECT *, array_to_string(u[1:least(one, two)], '') AS prefix, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(u[greatest(one, two) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN swapped THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN swapped THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut
"""
