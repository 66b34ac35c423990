"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded (learned table), frames of WIDTH bytes every STRIDE bytes pass through
FILTERS learned filters and a rectifier, and overlapping chunks of frames that cover the
whole document are max-pooled. The document is described by the mean and the maximum of
its chunks' pooled filters, which one logistic unit combines into a probability.

Trained on the driver by Adam on about ``per_class`` rows of each class, weighted back to
the classes' true shares so that the probability is calibrated. The sample ends earlier
where a class's texts add up to TRAIN_BYTES (both bounds are documented parameters): rows
are taken in the order of a hash, so long texts are as likely as short ones, and each is
learned from whole. The driver holds TRAIN_BYTES and one text a class at most. Scoring reads
every byte of every text.

Defined cases: null is an empty text, which is one frame of padding and gets a score like any
other; without labels every score is 0.5; repeated rows and null doc_ids (never held out)
are scored like others; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm import common, examples

PER_CLASS = 1000
TRAIN_BYTES = 32 << 20
MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.7
EMBED, WIDTH, STRIDE, FILTERS = 4, 8, 4, 24
BLOCK, BLOCKS = 16, 4  # a chunk is BLOCKS blocks of BLOCK frames; chunks overlap in all blocks but one
EPOCHS = 12
PIECE_FRAMES = 1 << 14  # a multiple of BLOCK


class Net:
    """Parameters and both passes of the network."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "table": (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
            "filters": (r.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32),
            "bias": np.full(FILTERS, 0.1, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "level": np.zeros(1, np.float32),
        }

    @staticmethod
    def padded(data: np.ndarray) -> np.ndarray:
        """Bytes padded with zeros to whole frames."""
        frames = max(1, -(-(len(data) - WIDTH) // STRIDE) + 1)
        return np.concatenate([data, np.zeros((frames - 1) * STRIDE + WIDTH - len(data), np.uint8)])

    def frames(self, data: np.ndarray) -> np.ndarray:
        e = self.p["table"][data].reshape(-1)
        n = (len(data) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def filtered(self, data: np.ndarray) -> np.ndarray:
        z = self.frames(data) @ self.p["filters"]
        z += self.p["bias"]
        return np.maximum(z, 0, out=z)

    @staticmethod
    def chunked(blocks: np.ndarray) -> np.ndarray:
        """Maxima over BLOCKS blocks in a row, one chunk for each start."""
        n = max(1, len(blocks) - BLOCKS + 1)
        out = blocks[:n].copy()
        for k in range(1, min(BLOCKS, len(blocks))):
            np.maximum(out, blocks[k : k + n], out=out)
        return out

    def describe(self, data: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Mean and maximum of the pooled chunks of one text, in pieces of bounded memory."""
        data = self.padded(data)
        total = (len(data) - WIDTH) // STRIDE + 1
        per = step // STRIDE // BLOCK * BLOCK
        blocks = []
        for at in range(0, total, per):
            n = min(per, total - at)
            r = self.filtered(np.ascontiguousarray(data[at * STRIDE : (at + n - 1) * STRIDE + WIDTH]))
            blocks.append(np.maximum.reduceat(r, np.arange(0, n, BLOCK), axis=0))
        c = self.chunked(np.concatenate(blocks))
        return np.concatenate([c.mean(axis=0), c.max(axis=0)])

    def probability(self, described: np.ndarray) -> np.ndarray:
        z = described @ self.p["out"] + self.p["level"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def gradient(self, data: np.ndarray, y: float, weight: float, grads: dict) -> float:
        """Adds one document's gradient of the weighted log loss; its probability."""
        data = self.padded(data)
        total, cols = (len(data) - WIDTH) // STRIDE + 1, np.arange(FILTERS)
        block_at, blocks = [], []
        for at in range(0, total, PIECE_FRAMES):  # of a long text only the blocks' maxima and their places are kept
            n = min(PIECE_FRAMES, total - at)
            r = self.filtered(np.ascontiguousarray(data[at * STRIDE : (at + n - 1) * STRIDE + WIDTH]))
            starts = np.arange(0, n, BLOCK)
            whole = np.full((len(starts) * BLOCK, FILTERS), -1, np.float32)
            whole[:n] = r
            top = starts[:, None] + whole.reshape(len(starts), BLOCK, FILTERS).argmax(axis=1)
            block_at.append(at + top)
            blocks.append(r[top, cols])
        block_at, blocks = np.concatenate(block_at), np.concatenate(blocks)
        m = max(1, len(blocks) - BLOCKS + 1)
        wide = np.stack([blocks[k : k + m] for k in range(min(BLOCKS, len(blocks)))])
        win = wide.argmax(axis=0)
        chunk_at = block_at[win + np.arange(m)[:, None], cols]
        c = wide.max(axis=0)
        best = c.argmax(axis=0)
        d = np.concatenate([c.mean(axis=0), c.max(axis=0)])
        p = float(self.probability(d[None])[0])
        g = np.float32(weight * (p - y))
        grads["out"] += g * d
        grads["level"] += g
        dc = np.repeat((g * self.p["out"][:FILTERS] / m)[None], m, axis=0)
        dc[best, cols] += g * self.p["out"][FILTERS:]
        live = c > 0
        rows, fs = chunk_at[live], np.broadcast_to(cols, c.shape)[live]
        v = dc[live]
        used, back = np.unique(rows, return_inverse=True)
        dz = np.zeros((len(used), FILTERS), np.float32)
        np.add.at(dz, (back, fs), v)
        read = data[used[:, None] * STRIDE + np.arange(WIDTH)]
        grads["filters"] += self.p["table"][read].reshape(len(used), WIDTH * EMBED).T @ dz
        grads["bias"] += dz.sum(axis=0)
        da = (dz @ self.p["filters"].T).reshape(-1, EMBED)
        np.add.at(grads["table"], read.reshape(-1), da)
        return p


def train(rows: list[tuple[bytes, int]], counts: dict[int, int], epochs: int = EPOCHS, seed: int = 5) -> Net | None:
    """The network, fitted to (text, label) rows that stand for classes of ``counts`` rows."""
    if not rows:
        return None
    net, r = Net(), np.random.default_rng(seed)
    drawn = {c: sum(1 for _, y in rows if y == c) for c in (0, 1)}
    share = {c: counts.get(c, 0) / max(1, drawn[c]) for c in (0, 1)}
    mean = sum(share[y] for _, y in rows) / len(rows)
    weight = {c: share[c] / max(mean, 1e-9) for c in share}
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    data = [(np.frombuffer(t, np.uint8), float(y), weight[y]) for t, y in rows]
    base = sum(w for _, y, w in data if y) / sum(w for _, _, w in data)
    net.p["level"][:] = np.log((base + 1e-3) / (1 - base + 1e-3))
    step, batch = 0, 32
    epochs = max(epochs, min(40, 12000 // len(rows)))  # small samples take as many steps as large ones
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for at in range(0, len(order), batch):
            step += 1
            grads = {k: np.zeros_like(v) for k, v in net.p.items()}
            part = order[at : at + batch]
            for i in part:
                net.gradient(*data[i], grads)
            rate = 0.01 * (1 - step / (total + 1)) + 1e-4
            for k, g in grads.items():
                g = g / len(part)
                s = state[k]
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                net.p[k] -= (rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = TRAIN_BYTES) -> Net | None:
    rows, counts = examples.labelled(docs, labels, "quality", MODULUS, REMAINDER, per_class)
    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")
    got = sorted((r.doc_id, bytes(r.body), r.label) for r in examples.within(rows, most_bytes).select("doc_id", body, "label").collect())
    return train([(t, y) for _, t, y in got if y in (0, 1)], counts)


def scored(docs: DataFrame, net: Net | None, out: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``out`` (which takes the place of one so named), from the whole text alone."""
    names = [n for n in docs.columns if n != out]
    docs = docs.select(*names)
    at_text = names.index("text")

    def run(batches):
        for b in common.slices(batches):
            data, at = common.raw(common.texts(b.column(at_text)))
            if net is None:
                s = np.full(len(b), 0.5)
            else:
                x = np.stack([net.describe(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
                s = net.probability(x)
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], [*names, out])

    schema = StructType(list(docs.schema.fields)).add(out, "double")
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    score = common.unused(docs, "score")
    return scored(docs, net, score).where(F.col(score) >= threshold).drop(score)


def op8_quality_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(common.held(F.col("doc_id"), MODULUS, REMAINDER), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_conv": op8_quality_conv}
ORACLE_SQL: dict[str, str] = {}
