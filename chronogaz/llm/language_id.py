"""Language identification with a string kernel.

Texts are compared by the blended-spectrum presence kernel: the number of n-grams (1 to 3 bytes of the lower-cased
UTF-8 text, hashed to DIM places) that two texts share, divided by the root of the product of their own numbers. A
Nystroem map over `landmarks` training texts gives features, and one-versus-rest kernel ridge regression gives a score
for each language. Scoring multiplies a batch's presence matrix by the landmarks' and by the weights.

Fitted on a bounded sample: at most `per_lang` texts of each language, those with the smallest hash of their doc_id,
and `landmarks` of these; only the share of hashes that holds half as many again as needed is ranked. All rows are scored, each over its whole text. Texts that are null or have no letter get
`und` with score 0; so does every text if nothing can be learned from. Languages are names of any kind; nulls teach
nothing. Repeated rows and extra columns have no effect on others. A very long text is one of a batch of bounded bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, cut

DIM = 1 << 13
PER_LANG, LANDMARKS, RIDGE = 600, 192, 1e-3
#: Up to so many languages, or ids of the sample, are broadcast (8 bytes each).
#: Rows that reach the driver at most, of all languages; with very many languages each gives fewer.
MOST_ROWS = 200_000
MOST_IDS = 1_000_000
#: Steepness of the softmax over the scores, which lie about -1 and 1.
SHARP = 4.0
_LETTER = re.compile(r"[^\W\d_]")
_MUL = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def presence(texts: list[str]) -> np.ndarray:
    """A row of DIM zeros and ones for each text: the hashed n-grams that it holds."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lens = np.array([len(r) for r in raw], np.int64)
    out = np.zeros(len(texts) * DIM, np.uint8)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIM, lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(b))  # bytes up to the text's end
    code = np.zeros(len(b), np.uint32)
    for n in range(1, 4):
        size = len(b) - n + 1
        if size <= 0:
            break
        code = (code[:size] << np.uint32(8)) | b[n - 1 :]
        place = row[:size] + ((code * _MUL[n - 1]) >> np.uint32(32 - 13))
        out[place if n == 1 else place[left[:size] >= n]] = 1
    return out.reshape(len(texts), DIM)


class KernelModel:
    """Landmarks' presence rows and the weights of each language."""

    def __init__(self, rows: np.ndarray, langs: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(langs))
        rows = rows.astype(np.float32)
        pick = np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int)  # rows come language by language
        self.marks = np.ascontiguousarray(rows[pick].T)
        self.norm = np.sqrt(np.maximum(self.marks.sum(0), 1))
        k = self.kernel(rows)
        val, vec = np.linalg.eigh(k[pick].astype(np.float64) + 1e-6 * np.eye(len(pick)))
        root = vec / np.sqrt(np.maximum(val, 1e-8)) @ vec.T
        phi = np.hstack([k @ root, np.ones((len(k), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + ridge * len(k) * np.eye(phi.shape[1]), phi.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(rows.sum(1), 1))
        return (rows @ self.marks) / own[:, None] / self.norm[None, :]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows.astype(np.float32)) @ self.weights + self.bias


def training_sample(df: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, bits): presence rows, packed to bits, of at most per_lang texts of each language."""
    known = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.col("doc_id").cast("string"))
    known = known.withColumn("h", F.xxhash64("lang", "doc_id", "text"))  # a row without an id, or with another's, has a hash of its own
    hashed = known.select("lang", "h").distinct()
    counts = cut(hashed.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language
    langs = counts.count()
    per_lang = max(1, min(per_lang, MOST_ROWS // max(1, langs)))
    counts = F.broadcast(counts) if langs <= MOST_IDS else counts
    near = hashed.join(counts, "lang").where(F.col("h") / 2.0**64 + 0.5 <= (1.5 * per_lang + 200) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h")
    ids = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang).select("lang", "h"))

    def bits(it):
        for b in it:
            rows = presence([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary()), b.column(2)], ["lang", "bits", "doc_id"])

    ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    sample = known.join(ids, ["lang", "h"], "left_semi").groupBy("lang", "h", "doc_id", "text").count()  # equal rows count once
    return sample.select("lang", "text", "doc_id").mapInArrow(bits, "lang string, bits binary, doc_id string")


def fit(df: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """The model from the rows of df (doc_id, text, lang); what reaches the driver is bounded by the sample, 1 KB a text."""
    got = sorted(training_sample(df, per_lang).collect(), key=lambda r: (r.lang, r.doc_id or "", bytes(r.bits)))
    if not got:
        return None
    rows = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return KernelModel(rows, [r.lang for r in got], landmarks, ridge)


def predict(df: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # landmarks x DIM numbers

    def run(it):
        m = shared.value
        for b in (s for x in it for s in batches([x], 2 << 20)):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                lang, score = np.array(["und"] * len(texts), object), np.zeros(len(texts))
                some = [i for i, t in enumerate(texts) if m is not None and _LETTER.search(t)]
                if some:
                    s = m.scores(presence([texts[i] for i in some])).astype(np.float64)
                    e = np.exp(SHARP * (s - s.max(1, keepdims=True)))
                    lang[some] = np.array(m.langs, object)[s.argmax(1)]
                    score[some] = e.max(1) / e.sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col("doc_id").cast("long"), F.col("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
