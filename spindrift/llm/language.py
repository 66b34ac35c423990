"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit one binary classifier over hashed byte
n-grams (1 to 3 bytes of the lower-cased letters and gaps of the whole text) is trained by
logistic regression. A text is decoded to the language whose codeword costs the least
logistic loss over all bits (loss-weighted decoding); the score is the softmax of the
negative losses, and a small distance to the runner-up flags the text as ambiguous.

Up to four languages get the exhaustive code, more get the best of several seeded random
codes by minimum distance. Fitted on about ``per_class`` rows a language, of every language
there is; many languages share examples.MOST_ROWS rows evenly, so that what the driver holds
is bounded (only beyond as many languages the rarest can't have a row).

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is
everything where no row has a usable language; with one language, every text with letters
gets it; repeated rows and null doc_ids (never held out) are scored like others; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, examples

PER_CLASS = 800
DIM = 2048
PIECE = 1 << 18
MODULUS, REMAINDER = 4, 2
MARGIN = 0.2
ITERATIONS = 150
PART = 4096
_LETTER = re.compile(r"[^\W\d_]")


def _gap_table() -> np.ndarray:
    """Bytes as letters see them: A-Z in lower case, all that is no letter as one gap."""
    t = np.full(256, 32, np.uint32)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_TABLE = _gap_table()


def features(data: np.ndarray, dim: int = DIM, piece: int = PIECE) -> np.ndarray:
    """Square-rooted n-gram counts of one text, scaled to length 1; a long text is read in pieces."""
    shift = np.uint32(32 - (dim.bit_length() - 1))
    counts = np.zeros((3, dim), np.int64)
    last = np.array([32], np.uint32)  # up to two codes before the piece
    for at in range(0, len(data) + 1, piece):
        t = _TABLE[data[at : at + piece]]
        if at + piece > len(data):
            t = np.append(t, np.uint32(32))
        t = t[(t != 32) | (np.concatenate([last[-1:], t[:-1]]) != 32)]  # gaps count once
        s, k = np.concatenate([last, t]), len(last)
        one = t * np.uint32(0x9E3779B1)
        two = (s[k - 1 : -1] << np.uint32(8) | s[k:]) * np.uint32(0x85EBCA6B)
        m = s[k - 2 :] if k > 1 else s
        three = (m[:-2] << np.uint32(16) | m[1:-1] << np.uint32(8) | m[2:]) * np.uint32(0xC2B2AE35)
        for c, g in zip(counts, (one, two, three)):
            c += np.bincount(g >> shift, minlength=dim)[:dim]
        last = s[-2:]
    x = np.sqrt(counts).sum(axis=0).astype(np.float32)
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def _least_distance(code: np.ndarray, at: int) -> int:
    """The least distance of the codewords at..at + 1024 to others."""
    gram = code[at : at + 1024] @ code.T
    gram[np.arange(len(gram)), at + np.arange(len(gram))] = -code.shape[1]
    return int((code.shape[1] - gram.max()) // 2)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1."""
    if k <= 1:
        return np.ones((k, 0), np.float32)
    if k <= 4:
        cols = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and len(set(c)) == 2]
        return np.array(cols, np.float32).T
    r = np.random.default_rng(seed)
    bits = max(10, int(np.ceil(10 * np.log2(k))))
    best, far = None, -1
    for _ in range(max(1, min(200, 20_000_000 // (k * k)))):
        code = r.choice(np.array([-1, 1], np.float32), (k, bits))
        d = min(_least_distance(code, at) for at in range(0, k, 1024))
        if d > far and all(len(set(c)) == 2 for c in code.T):
            best, far = code, d
    return best


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, iterations: int = ITERATIONS, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once (Adam, full batch): weights and intercepts."""
    bits = y.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for i in range(1, iterations + 1):
        dw, db = ridge * w, np.zeros_like(b)
        for k in range(0, len(x), PART):  # half precision is widened a part at a time
            part, yk = x[k : k + PART].astype(np.float32), y[k : k + PART]
            g = -yk * weight[k : k + PART] / (1 + np.exp(np.clip(yk * (part @ w + b), -30, 30)))
            dw += part.T @ g
            db += g.sum(axis=0)
        for p, s, d in ((w, state[0], dw), (b, state[1], db)):
            s[0] = 0.9 * s[0] + 0.1 * d
            s[1] = 0.99 * s[1] + 0.01 * d * d
            p -= 0.3 * (s[0] / (1 - 0.9**i)) / (np.sqrt(s[1] / (1 - 0.99**i)) + 1e-8)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its probability, and the lead over the runner-up, by least logistic loss over the bits."""
    # a bit's loss is that of codeword bit 1, plus the margin where the bit is -1: one product for all codewords
    loss = np.logaddexp(0, -margins).sum(axis=1, keepdims=True) + margins @ ((1 - code.T) / 2)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    p /= p.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ordered = np.sort(p, axis=1)
    lead = ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)
    return best, p[np.arange(len(p)), best], lead


def fit(docs: DataFrame, per_class: int = PER_CLASS, dim: int = DIM):
    """Languages, codewords, weights and intercepts; learned from text and lang of rows that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~common.held(F.col("doc_id"), MODULUS, REMAINDER))
    chosen, _ = examples.choose(usable.select("doc_id", "lang"), "doc_id", "lang", per_class)
    if not chosen:
        return [], np.ones((0, 0), np.float32), None, None
    small = docs.sparkSession.createDataFrame(sorted({i for i, _ in chosen}), "long").toDF("doc_id")

    def run(batches):
        for b in common.slices(batches):
            data, at = common.raw(common.texts(b.column(1)))
            x = [features(data[s:e], dim).astype(np.float16).tobytes() for s, e in zip(at[:-1], at[1:])]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(small), "doc_id").mapInArrow(run, "doc_id long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.x))
    names = sorted({r.lang for r in rows})
    number = {n: k for k, n in enumerate(names)}
    x = np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(len(rows), dim)
    label = np.array([number[r.lang] for r in rows])
    code = codewords(len(names))
    if not code.shape[1]:
        return names, code, None, None
    w, b = train(x, code[label], 1.0 / np.bincount(label, minlength=len(names))[label])
    return names, code, w, b


def identify(docs: DataFrame, model, dim: int = DIM, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row, from the whole text alone."""
    names, code, w, b = model

    def run(batches):
        for part in common.slices(batches):
            column = common.texts(part.column(1))
            data, at = common.raw(column)
            n = len(part)
            pred, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            rows = [i for i, t in enumerate(column.to_pylist()) if names and _LETTER.search(t)]
            if rows and w is None:
                pred[rows], score[rows] = names[0], 1.0
            elif rows:
                x = np.stack([features(data[at[i] : at[i + 1]], dim) for i in rows])
                best, p, lead = decode(x @ w + b, code)
                pred[rows], score[rows], unsure[rows] = [names[k] for k in best], p, lead < margin
            yield pa.record_batch([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op4_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(common.held(F.col("doc_id"), MODULUS, REMAINDER), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op4_language_ecoc": op4_language_ecoc}
ORACLE_SQL: dict[str, str] = {}
