"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are about ``per_class`` labelled rows of each class (the documented bound). Terms
are all the words and word beginnings whose presence tells the classes apart (signed G
statistic of the examples, near copies counted once, against a bound that grows with the
number of terms tried, and LEAST_RATIO times as frequent in one class as in the other).
This choice is what is learned: among vectors of all words a few toxic ones hardly count
(README has the figures). Inverse document frequencies come from all documents. The examples' weights lie in an
inverted index cut into blocks of BLOCK examples, with the largest weight of every term in
every block. A search takes the blocks in falling order of their upper bound and stops when
no block can enter the NEIGHBOURS best, so the neighbours are exactly those of a full scan.

Votes are weighted by cosine distance and by the share of its class that an example stands
for, smoothed to the rate of examples without any term, and calibrated by logistic
regression on the examples' own leave-one-out votes. The neighbours' ids are the evidence.

Defined cases: null, blank and term-free texts have no neighbours and get the calibrated
rate of such examples; without usable labels every score is 0; equal cosines are ordered by
example id; repeated rows and null doc_ids (never held out) are scored like others; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from spindrift.llm import common, examples
from spindrift.llm.wordhash import STEMS, term_hashes  # noqa: F401

PER_CLASS = 2000
MODULUS, REMAINDER = 5, 0
THRESHOLD = 0.5
NEIGHBOURS = 15
BLOCK = 64
LEAST_RATIO = 8
COPY_SIMILARITY = 0.8
SMOOTH = 0.5


class Index:
    """Block-max inverted index over examples; ``vocabulary`` holds the terms' sorted hashes."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, share: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.vocabulary, self.idf = vocabulary, idf
        # examples with like strongest terms side by side make tight bounds
        lead = [int(t[np.argmax(w)]) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], int(ids[i])))
        self.ids, self.labels, self.share = ids[order], labels[order], share[order]
        self.vectors = [vectors[i] for i in order]
        n = len(order)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([t for t, _ in self.vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        where = np.repeat(np.arange(n), [len(t) for t, _ in self.vectors])
        cell = term * max(1, self.blocks) + where // BLOCK
        by = np.lexsort((where, cell))
        self.place, self.weight, cell = where[by], weight[by], cell[by]
        cells = np.arange(len(vocabulary) * max(1, self.blocks))
        self.start = np.searchsorted(cell, cells)
        self.end = np.searchsorted(cell, cells, "right")
        self.most = np.zeros(len(cells))
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(vocabulary), max(1, self.blocks))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of known terms: (1 + log count) * idf, scaled to length 1."""
        w = (1 + np.log(np.maximum(counts, 1))) * self.idf[terms]
        return terms.astype(np.int64), w / np.sqrt((w * w).sum()) if len(w) else w

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine; ``skip`` is left out."""
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weights @ self.most[terms]
        place, score, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(place) >= k and bound[b] < kth - 1e-12):
                break
            got = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                c = t * self.blocks + b
                s, e = self.start[c], self.end[c]
                if s < e:
                    got[self.place[s:e] - b * BLOCK] += w * self.weight[s:e]
            hit = np.flatnonzero(got > 0)
            hit = hit[hit + b * BLOCK != skip]
            place, score = np.concatenate([place, hit + b * BLOCK]), np.concatenate([score, got[hit]])
            if len(place) > k:
                best = np.lexsort((self.ids[place], -np.round(score, 12)))[:k]
                place, score = place[best], score[best]
            if len(place) >= k:
                kth = float(score.min())
        best = np.lexsort((self.ids[place], -np.round(score, 12)))
        return place[best], score[best]


class Model:
    def __init__(self, index: Index, rate: float, a: float, b: float):
        self.index, self.rate, self.a, self.b = index, rate, a, b

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours, smoothed to ``rate``."""
        w = self.index.share[place] * cosine / (1.05 - np.minimum(cosine, 1.0))
        return float(((w * self.index.labels[place]).sum() + SMOOTH * self.rate) / (w.sum() + SMOOTH))

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.a * np.log(v / (1 - v)) + self.b))))


def signed_g(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G statistic of presence against class for each term; negative where the term speaks against class 1."""

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    n, tot = n_pos + n_neg, pos + neg
    g = 2 * (part(pos, tot * n_pos / n) + part(neg, tot * n_neg / n) + part(n_pos - pos, (n - tot) * n_pos / n) + part(n_neg - neg, (n - tot) * n_neg / n))
    return np.where(pos * n_neg >= neg * n_pos, g, -g)


def near_copies(rows: list[tuple[np.ndarray, int]], similarity: float = COPY_SIMILARITY) -> list[int]:
    """For each row of (distinct term hashes, label) the first row of its label that it nearly copies, itself if none: Jaccard similarity of ``similarity`` or more, tried where one of a few smallest hashes of rarer terms agrees."""
    first: list[int] = []
    met: dict[tuple, list[int]] = {}
    mixers = [np.uint64(2 * (0x5851F42D4C957F2D * (k + 1) % (1 << 63)) + 1) for k in range(8)]
    terms, back, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in rows)]), return_inverse=True, return_counts=True)
    rare = np.split(df[back] <= max(20, len(rows) // 10), np.cumsum([len(h) for h, _ in rows])[:-1])
    for i, (h, label) in enumerate(rows):
        own = h[rare[i]] if rare[i].any() else h  # the smallest hash of common words would be that of most rows
        keys = [(label, k, int((own * m).min())) for k, m in enumerate(mixers)] if len(h) else [(label, -1, 0)]
        own = i
        for j in sorted({j for key in keys for j in met.get(key, ())}):
            both = len(np.intersect1d(h, rows[j][0], assume_unique=True))
            if both >= similarity * (len(h) + len(rows[j][0]) - both):
                own = j
                break
        first.append(own)
        if own == i:
            for key in keys:
                met.setdefault(key, []).append(i)
    return first


def select_terms(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Sorted hashes of the terms that tell the classes apart; near copies count once."""
    if len({y for _, y in rows}) < 2:
        return np.zeros(0, np.uint64)
    rows = [r for i, (r, j) in enumerate(zip(rows, near_copies(rows))) if i == j]
    terms, back = np.unique(np.concatenate([h for h, _ in rows]), return_inverse=True)
    y = np.repeat([label for _, label in rows], [len(h) for h, _ in rows])
    n = [sum(1 for _, label in rows if label == k) for k in (0, 1)]
    pos = np.bincount(back, weights=y, minlength=len(terms))
    neg = np.bincount(back, weights=1 - y, minlength=len(terms))
    g = signed_g(pos, neg, n[1], n[0])
    # weight of evidence must be large, not only significant; the bound holds the number of chance terms near one
    ratio = ((pos + 0.5) / (n[1] + 1)) / ((neg + 0.5) / (n[0] + 1))
    least = 2 * np.log(len(terms) + 1)
    return terms[(np.abs(g) >= least) & ((ratio >= LEAST_RATIO) | (ratio <= 1 / LEAST_RATIO))]


class Finder:
    """Known terms of an Arrow batch of texts."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.mask = np.zeros(1 << 20, bool)  # top bits of known hashes: most terms end here
        self.mask[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def pairs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term number and count of each known term of each text, by text."""
        v, found = self.vocabulary, [np.zeros(0, np.int64)]
        if len(v):
            for h, row in term_hashes(data, at):
                some = np.flatnonzero(self.mask[(h >> np.uint64(44)).astype(np.int64)])
                i = np.minimum(np.searchsorted(v, h[some]), len(v) - 1)
                hit = v[i] == h[some]
                found.append(row[some[hit]] * len(v) + i[hit])
        pair, count = np.unique(np.concatenate(found), return_counts=True)
        n = max(1, len(v))
        return pair // n, pair % n, count


def all_terms(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct term hashes and their counts, text by text."""
    parts = list(term_hashes(data, at))
    h = np.concatenate([x for x, _ in parts])
    row = np.concatenate([r for _, r in parts])
    order = np.argsort(row, kind="stable")
    h, cuts = h[order], np.searchsorted(row[order], np.arange(len(at)))
    return [np.unique(h[s:e], return_counts=True) for s, e in zip(cuts[:-1], cuts[1:])]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a weighted logistic regression with a weak pull to (1, 0)."""
    p = np.array([1.0, 0.0])
    w = w / max(w.mean(), 1e-12)
    for _ in range(50):
        m = 1 / (1 + np.exp(-np.clip(p[0] * x + p[1], -30, 30)))
        g = np.array([((m - y) * w * x).sum() + (p[0] - 1), ((m - y) * w).sum() + p[1]])
        v = np.maximum(m * (1 - m) * w, 1e-9)
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(hess, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(p[0])), float(p[1])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows in all, and rows that hold each term; counted over every whole text, summed per task before they are sent."""

    def run(batches):
        n, df, finder = 0, np.zeros(len(vocabulary), np.int64), Finder(vocabulary)
        for b in common.slices(batches):
            n += b.num_rows
            df += np.bincount(finder.pairs(*common.raw(common.texts(b.column(0))))[1], minlength=len(vocabulary))[: len(vocabulary)]
        full = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-1, *full.tolist()], pa.int64()), pa.array([n, *df[full].tolist()], pa.int64())], ["term", "n"])

    total, df = 0, np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    return total, df


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows, counts = examples.labelled(docs, labels, "toxic", MODULUS, REMAINDER, per_class)

    def run(batches):
        for b in common.slices(batches):
            u = all_terms(*common.raw(common.texts(b.column(1))))
            yield pa.record_batch([b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in u], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in u], pa.binary())], ["doc_id", "label", "h", "c"])

    got = sorted((r.doc_id, r.label, bytes(r.h), bytes(r.c)) for r in rows.mapInArrow(run, "doc_id long, label int, h binary, c binary").collect() if r.label in (0, 1))
    if not got:
        return None
    return build([(i, y, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)) for i, y, h, c in got], counts, lambda v: document_frequencies(docs, v))


def build(rows, counts: dict[int, int], frequencies) -> Model:
    """rows: (id, label, sorted term hashes, counts)."""
    vocabulary = select_terms([(h, y) for _, y, h, _ in rows])
    total, df = frequencies(vocabulary)
    idf = np.log((1 + total) / (1 + df)) + 1
    drawn = {c: sum(1 for r in rows if r[1] == c) for c in (0, 1)}
    share = {c: counts.get(c, drawn[c]) / max(1, drawn[c]) for c in (0, 1)}
    index = Index(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [])
    ids, labels, weight, vectors, empty = [], [], [], [], [0.0, 0.0]
    for i, y, h, c in rows:
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        hit = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
        if len(hit):
            ids.append(i)
            labels.append(float(y))
            weight.append(share[y])
            vectors.append(index.weigh(at[hit], c[hit]))
        else:
            empty[y] += share[y]
    scale = sum(share[r[1]] for r in rows) / len(rows)
    rate = (empty[1] / scale + 0.5) / ((empty[0] + empty[1]) / scale + 5)
    index = Index(vocabulary, idf, np.array(ids, np.int64), np.array(labels), np.array(weight) / scale, vectors)
    model = Model(index, rate, 1.0, 0.0)
    votes = np.array([model.vote(*index.search(*v, skip=i)) for i, v in enumerate(index.vectors)] or [rate])
    y, w = (index.labels, index.share) if len(index.vectors) else (np.array([0.0]), np.array([1e-6]))
    v = np.concatenate([votes, [rate, rate]])
    y, w = np.concatenate([y, [1.0, 0.0]]), np.concatenate([w, [empty[1] / scale, empty[0] / scale]])
    v = np.clip(v, 1e-4, 1 - 1e-4)
    model.a, model.b = logistic(np.log(v / (1 - v)), y, np.maximum(w, 1e-6))
    return model


def scored(docs: DataFrame, model: Model | None, out: str = "score", evidence: str | None = "evidence") -> DataFrame:
    """All columns of ``docs`` with ``out`` and, if asked for, ``evidence``: the ids of the nearest examples. Both take the place of columns so named."""
    names = [n for n in docs.columns if n not in (out, evidence)]
    docs = docs.select(*names)
    at_text = names.index("text")
    box = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class: terms of the examples

    def run(batches):
        m = box.value
        finder = Finder(m.index.vocabulary) if m is not None else None
        for b in common.slices(batches):
            n = b.num_rows
            score, near = np.zeros(n), [[] for _ in range(n)]
            if m is not None:
                score[:] = m.calibrated(m.rate)
                doc, term, count = finder.pairs(*common.raw(common.texts(b.column(at_text))))
                cuts = np.searchsorted(doc, np.arange(n + 1)).tolist()
                for r in np.unique(doc).tolist():
                    s, e = cuts[r], cuts[r + 1]
                    place, cosine = m.index.search(*m.index.weigh(term[s:e], count[s:e]))
                    score[r] = m.calibrated(m.vote(place, cosine))
                    near[r] = m.index.ids[place].tolist()
            cols = [*b.columns, pa.array(score)] + ([pa.array(near, pa.list_(pa.int64()))] if evidence else [])
            yield pa.record_batch(cols, [*names, out, evidence][: len(cols)])

    schema = StructType(list(docs.schema.fields)).add(out, "double")
    if evidence:
        schema = schema.add(evidence, ArrayType(LongType()))
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    score = common.unused(docs, "score")
    return scored(docs, model, score, None).where(F.col(score) < threshold).drop(score)


def op7_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(common.held(F.col("doc_id"), MODULUS, REMAINDER), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op7_toxicity_knn": op7_toxicity_knn}
ORACLE_SQL: dict[str, str] = {}
