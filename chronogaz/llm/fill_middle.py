"""Fill-in-the-middle transformation over a Roaring-style set of cut positions.

The positions between a text's lines, as code points from the text's start, form a set of integers that is kept in
containers of 65,536 values each, by the upper bits: a sorted array of 16-bit values, a bitmap, or runs (start and
length), whichever takes fewest bytes. Cumulative cardinalities say how many values stand before each container, so
select(rank) is a search for the container and a select inside it: by index in an array, by the cumulative counts of
set bits of the words in a bitmap, by the cumulative lengths in runs. `boundaries()` makes the set as a binary column
that `Cuts.load()` reads; `transform()` makes the sets in the same pass that cuts the texts.

Null and empty texts have no lines, n is 0 and the form plain. A text that holds a sentinel stays plain, so that every
output can be read back without doubt. Rows do not depend on each other: repeated rows give equal results, doc_ids may
repeat or be null (null counts as no digits). An empty table gives an empty table. Texts of any length are cut whole;
a batch of them holds some 16 MB or one text. Columns that have the name of a column of the result give way to it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronogaz.llm.common import batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred texts so many are transformed, and of a hundred of these so many as suffix, prefix, middle.
FIM_RATE, SPM_RATE = 100, 50
ARRAY, BITMAP, RUN = 0, 1, 2
_WORDS = 1 << 16 >> 6


class Cuts:
    """A set of integers from 0 to 2^32 - 1 in containers by their upper 16 bits."""

    def __init__(self, keys: np.ndarray, kinds: np.ndarray, before: np.ndarray, parts: list[np.ndarray]):
        self.keys, self.kinds, self.parts = keys, kinds, parts
        #: values before each container, and the number of all at the end
        self.before = before
        self._ranks: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, values: np.ndarray) -> Cuts:
        """From rising values."""
        upper, low = (values >> 16).astype(np.int64), (values & 0xFFFF).astype(np.uint16)
        keys, starts = np.unique(upper, return_index=True)
        ends = np.append(starts[1:], len(values))
        kinds, parts = np.zeros(len(keys), np.uint8), []
        for i, (a, b) in enumerate(zip(starts, ends)):
            kinds[i], part = _container(low[a:b])
            parts.append(part)
        return cls(keys, kinds, np.append(starts, len(values)).astype(np.int64), parts)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The value with so many smaller ones in the set."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        inside = rank - int(self.before[at])
        return (int(self.keys[at]) << 16) | self._local(at, inside)

    def _local(self, at: int, inside: int) -> int:
        part = self.parts[at]
        if self.kinds[at] == ARRAY:
            return int(part[inside])
        if self.kinds[at] == RUN:
            upto = self._counts(at, lambda: part[1::2].astype(np.int64) + 1)
            run = int(np.searchsorted(upto, inside, side="right"))
            return int(part[2 * run]) + inside - (int(upto[run - 1]) if run else 0)
        upto = self._counts(at, lambda: np.bitwise_count(part).astype(np.int64))
        word = int(np.searchsorted(upto, inside, side="right"))
        bits, left = int(part[word]), inside - (int(upto[word - 1]) if word else 0)
        for _ in range(left):
            bits &= bits - 1  # the lowest set bit goes
        return word << 6 | (bits & -bits).bit_length() - 1

    def _counts(self, at: int, make) -> np.ndarray:
        """Running counts inside a container, made once."""
        if at not in self._ranks:
            self._ranks[at] = np.cumsum(make())
        return self._ranks[at]

    def dump(self) -> bytes:
        """Number of containers; for each its key, kind, cardinality and number of bytes; then the containers."""
        bodies = [p.tobytes() for p in self.parts]
        sizes = np.diff(self.before)
        heads = [struct.pack("<IBII", k, t, n, len(b)) for k, t, n, b in zip(self.keys.tolist(), self.kinds.tolist(), sizes.tolist(), bodies)]
        return struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(bodies)

    @classmethod
    def load(cls, data: bytes) -> Cuts:
        (n,) = struct.unpack_from("<I", data)
        heads = [struct.unpack_from("<IBII", data, 4 + 13 * i) for i in range(n)]
        at, parts = 4 + 13 * n, []
        for _, kind, _, size in heads:
            parts.append(np.frombuffer(data, np.uint64 if kind == BITMAP else np.uint16, size // (8 if kind == BITMAP else 2), at))
            at += size
        before = np.append(0, np.cumsum([h[2] for h in heads])).astype(np.int64)
        return cls(np.array([h[0] for h in heads], np.int64), np.array([h[1] for h in heads], np.uint8), before, parts)


def _container(low: np.ndarray) -> tuple[int, np.ndarray]:
    """Rising 16-bit values of one container in the form that takes fewest bytes."""
    breaks = np.flatnonzero(np.diff(low) != 1)
    runs = len(breaks) + 1
    array, bitmap, run = 2 * len(low), 8 * _WORDS, 4 * runs
    if run < min(array, bitmap):
        first = low[np.append(0, breaks + 1)]
        last = low[np.append(breaks, len(low) - 1)]
        return RUN, np.column_stack([first, last - first]).ravel()
    if array <= bitmap:
        return ARRAY, low
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return BITMAP, np.packbits(bits, bitorder="little").view(np.uint64)


def line_cuts(data: bytes) -> Cuts:
    """0 and the end of each line (`[^\\n]*\\n|[^\\n]+`) of a text in UTF-8, in code points."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(data) and data[-1] != 10:
        ends = np.append(ends, len(data))
    if not data.isascii():
        chars = np.cumsum((raw & 0xC0) != 0x80)
        ends = chars[ends - 1]
    return Cuts.of(np.append(0, ends))


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return struct.unpack(">4I", digest[:16])


def cut_text(doc_id, data: bytes, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE):
    """(lines, form, prefix, middle, suffix): the three are None if the form is plain."""
    cuts = line_cuts(data)
    n = len(cuts) - 1
    text = data.decode()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select(first), cuts.select(second)
    return n, "spm" if h4 % 100 < spm_rate else "psm", text[:a], text[a:b], text[b:]


def joined(text: str, form: str, prefix, middle, suffix) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, _, rest = output[len(PREFIX) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _kept(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in names]


def boundaries(df: DataFrame, text: str = "text", name: str = "cuts") -> DataFrame:
    """Adds a binary column: the set of line ends of each text, and 0."""
    kept = _kept(df, (name,))

    def run(it):
        for b in batches(it, column=text):
            sets = pa.array([line_cuts(x).dump() for x in text_bytes(b, text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], sets], names=[*kept, name])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.BinaryType())]))


MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Adds n (lines), form, prefix_chars, middle_chars and output (the transformed text) to each row."""
    return _mapped(df, text, key, _kept(df, MADE), seed, fim_rate, spm_rate, False)


def fim_digest(docs: DataFrame) -> DataFrame:
    """Hashes of each output and of the text rebuilt from it, in place of the texts."""
    return _mapped(docs.select("doc_id", "text"), "text", "doc_id", ["doc_id"], SEED, FIM_RATE, SPM_RATE, True)


def _mapped(df: DataFrame, text: str, key: str, kept: list[str], seed: int, fim_rate: int, spm_rate: int, digest: bool) -> DataFrame:
    last = ["output_sha256", "restored_sha256"] if digest else ["output"]
    types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()} | dict.fromkeys(last, pa.string())

    def run(it):
        for b in batches(it, column=text):
            ids, rows = b.column(b.schema.get_field_index(key)).to_pylist(), []
            for doc_id, data in zip(ids, text_bytes(b, text)):
                n, form, prefix, middle, suffix = cut_text(doc_id, data, seed, fim_rate, spm_rate)
                output = joined("" if prefix is not None else data.decode(), form, prefix, middle, suffix)
                sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
                ends = [_sha(output), _sha(restored(output, form))] if digest else [output]
                rows.append((n, form, *sizes, *ends))
            columns = list(zip(*rows))
            made = [pa.array(c, t) for c, t in zip(columns, types.values())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *made], names=[*kept, *types])

    spark_type = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *[T.StructField(c, spark_type[t]) for c, t in types.items()]]))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
