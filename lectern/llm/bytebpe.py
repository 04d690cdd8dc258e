"""Byte-level BPE: ids of whole texts by the tokenizers library, and their bytes again.

A rank file lists byte strings. Each byte is written as one printable character (the byte table), so the library's
merges work on characters; two tokens merge if the bytes of both together have a rank, the lowest rank first, and a
match of the pattern that has a rank itself is one token. Texts are cut before each space that black text follows,
where a match of the pattern always ends, so a part's ids don't depend on what stands around it: parts that a worker has
met are looked up. New ones of letters and closing punctuation go to the library's model match by match, in the byte
table's characters; all others go through the library together, whose offsets tell them apart.

Decoding takes bytes from the table, so a character may be split over ids: `decode` joins bytes before it reads
characters, and `decode_parts` gives a split character to the part in which it ends.

Defined results: a null or empty text has no ids; null ids are none; an id without a rank, or a null one, is decoded
as U+FFFD, and so are bytes that are no UTF-8 in `text` (not in `data`); rows come out as often as they go in, with all
of their columns; a column of a result's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from codecs import getincrementaldecoder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from lectern.llm.tokens import _byte_letters as byte_letters
from lectern.llm.tokens import public_tokenizer

RANKS = "byte_bpe_50k.tiktoken"
#: Before such a space a match ends: what comes before it, white space or not, is matched as at the end of a text.
CUT = re.compile(r" (?=\S)")
#: Letters, with the cut's space or without, and punctuation after them: two matches, wherever they stand.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Characters that are worked on at a time.
STEP = 1 << 20
UNKNOWN = "\ufffd".encode()


class ByteBpe:
    """Ids of a rank file. most: entries of the cache of parts, which then starts anew."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 48):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        letters = byte_letters()
        written = {data: "".join([letters[x] for x in data]) for data in ranks}
        merges = [(written[data[:k]], written[data[k:]]) for data in sorted(ranks, key=ranks.get) for k in range(1, len(data)) if data[:k] in ranks and data[k:] in ranks]
        self.tokenizer = Tokenizer(models.BPE({written[data]: rank for data, rank in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        byte_of = {letter: bytes([x]) for x, letter in enumerate(letters)}
        self.bytes_of = {rank: b"".join([byte_of[c] for c in word]) for word, rank in self.tokenizer.get_vocab().items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.sizes[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}
        self.letters = {x: letter for x, letter in enumerate(letters)}

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern."""
        if (found := self.matches.get(match)) is None:
            if len(self.matches) >= self.most:
                self.matches.clear()
            characters = match.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(characters)]).tobytes()
            if len(match) <= self.longest:
                self.matches[match] = found
        return found

    def _plain(self, part: str) -> bytes | None:
        """Ids of a part whose lines are words with closing punctuation; none for other parts."""
        out = []
        for line in part.split("\n"):  # between such lines, a line break is a match
            m = PLAIN.fullmatch(line)
            if not m or (out and line[0] == " "):
                return None
            out.append(self._match(m[1]) + self._match(m[2]) if m[2] else self._match(m[1]))
        return out[0] if len(out) == 1 else self._match("\n").join(out)

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that begin with a cut, by one pass of the library over all of them."""
        out: dict[str, bytes] = {}
        at = 0
        while at < len(parts):
            some, size = [], 0
            while at < len(parts) and (not some or size + len(parts[at]) < STEP // 8):
                some.append(parts[at])
                size += len(parts[at])
                at += 1
            e = self.tokenizer.encode("".join(some), add_special_tokens=False)
            starts = np.array([x for x, _ in e.offsets], np.int64)
            ids = np.array(e.ids, "<u4")
            firsts = np.cumsum([0, *map(len, some)])
            cuts = np.searchsorted(starts, firsts)
            out.update((part, ids[a:b].tobytes()) for part, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        done: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            at, text = 0, text or ""
            while at < len(text):
                m = CUT.search(text, at + STEP) if len(text) - at > STEP else None
                end = m.start() if m else len(text)
                parts = CUT.split(text if end - at == len(text) else text[at:end])
                # a text's first part has no space before it, and one after a cut has an empty first part
                held.append((k, [parts[0], *(" " + p for p in parts[1:])]))
                size += end - at
                at = end
                if size >= STEP:
                    self._encode(held, done)
                    held, size = [], 0
        self._encode(held, done)
        return [b"".join(x) for x in done]

    def _encode(self, held: list[tuple[int, list[str]]], done: list[list[bytes]]) -> None:
        known = self.known
        lost = {p for _, parts in held for p in parts if p not in known}
        if lost and len(known) + len(lost) > self.most:
            known.clear()
            lost = {p for _, parts in held for p in parts}
        others = []
        for p in lost:
            if (ids := self._plain(p)) is None:
                others.append(p)
            else:
                known[p] = ids
        # parts that begin with a cut's space can stand side by side; the others are encoded by themselves
        beside = {p for p in others if len(p) > 1 and p[0] == " " and not p[1].isspace()}
        known.update(self._learn(sorted(beside)))
        for p in set(others) - beside:
            known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        for k, parts in held:
            done[k] += map(known.get, parts)
        for p in lost:
            if len(p) > self.longest:
                del known[p]

    def decode(self, ids: list[int | None]) -> bytes:
        """The bytes of ids; U+FFFD for those without a rank."""
        return b"".join([self.bytes_of.get(x, UNKNOWN) for x in ids])

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each id and the one after its last; ids that share a character both have it."""
        leads = (np.frombuffer((text or "").encode(), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(leads) - 1
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return (character[starts], character[ends - 1] + 1) if len(ids) else (starts, ends)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker and rank file."""
    return ByteBpe(path)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _steps(b: pa.RecordBatch, sizes: np.ndarray, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` units of size, one row at least."""
    at, total = 0, np.cumsum(sizes)
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes or elements of each row."""
    import pyarrow.compute as pc

    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ids(column: pa.Array) -> list[list[int]]:
    """The elements of each row; -1 for null ones, none for a null row."""
    import pyarrow.compute as pc

    flat = pc.fill_null(pc.list_flatten(column), -1).to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(_sizes(column)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _replaced(df: DataFrame, names: dict) -> StructType:
    """df's schema with the columns `names`, each in place of one of that name."""
    out = StructType([f for f in df.schema.fields if f.name not in names])
    for name, kind in names.items():
        out = out.add(name, kind)
    return out


def encode(docs: DataFrame, path: str | None = None, offsets: bool = False, text: str = "text") -> DataFrame:
    """docs with ids array<int>; with offsets also starts and ends array<int>, the characters of each id."""
    ranks = path or public_tokenizer(RANKS)
    new = ["ids", *(["starts", "ends"] if offsets else [])]
    df = docs.withColumn(text, F.col(text).cast("string"))
    schema = _replaced(df, {n: ArrayType(IntegerType()) for n in new})
    kept = [f.name for f in schema.fields if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for whole in batches:
            for b in _steps(whole, _sizes(whole[text])):
                texts = b[text].to_pylist()
                ids = [np.frombuffer(x, "<u4") for x in bpe.encode_batch(texts)]
                made = [_lists(ids)]
                if offsets:
                    at = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    made += [_lists([x for x, _ in at]), _lists([y for _, y in at])]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *made], [*kept, *new])

    return df.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with data binary, the bytes of the ids, and text string, the characters of those bytes."""
    ranks = path or public_tokenizer(RANKS)
    schema = _replaced(encoded, {"data": BinaryType(), "text": StringType()})
    kept = [f.name for f in schema.fields if f.name not in ("data", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for whole in batches:
            for b in _steps(whole, _sizes(whole[ids])):
                data = [bpe.decode(x) for x in _ids(b[ids])]
                made = [pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *made], [*kept, "data", "text"])

    return encoded.mapInArrow(run, schema)


def decode_parts(cut: DataFrame, path: str | None = None, parts: str = "parts") -> DataFrame:
    """cut with texts array<string>, one for each part of `parts` (array<array<int>>, a text's ids cut anywhere).

    The texts of a row join to the whole text: a character that is split over parts is in the part with its last byte.
    """
    ranks = path or public_tokenizer(RANKS)
    schema = _replaced(cut, {"texts": ArrayType(StringType())})
    kept = [f.name for f in schema.fields if f.name != "texts"]

    def joined(bpe: ByteBpe, row: list[list[int] | None] | None) -> list[str] | None:
        if row is None:
            return None
        reader, last = getincrementaldecoder("utf-8")(errors="replace"), len(row) - 1
        return [reader.decode(bpe.decode(x or []), final=k == last) for k, x in enumerate(row)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for b in batches:
            texts = [joined(bpe, row) for row in b[parts].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(texts, pa.list_(pa.string()))], [*kept, "texts"])

    return cut.mapInArrow(run, schema)
