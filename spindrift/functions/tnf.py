"""Tetranucleotide composition and the probability that two fragments differ in it."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# --- fixed values ---------------------------------------------------------------------------
# Coefficients of the two logistic models, intercept b and slope c of each, over the log10 lengths
# x (shorter) and y (longer fragment). Each is a polynomial in x (with the constant), one in y and
# one in the product xy; coefficients by rising power.
MODEL = {
    "b1": {
        "x": [46349.1624324381, -76092.3748553155, 53873.3933743949, -21263.6010657275, 5003.2646455284, -700.5825500292, 54.037542743, -1.7713972342],
        "y": [0, -639.918334183, -156.6547554844, 64.7719132839, -8.5014386744, 0.3968284526],
        "xy": [0, 474.0850141891, -23.966597785, 0.7800219061, -0.0138723693, 0.0001027543],
    },
    "c1": {
        "x": [-443565.465710869, 718862.10804858, -501588.206183097, 194712.394138513, -45088.7863182741, 6220.3310639927, -473.269785487, 15.3213264134],
        "y": [0, 5114.1630934534, 784.4442123743, -377.9645994741, 50.5960513287, -2.3670776453],
        "xy": [0, -3282.8510348085, 164.0438603974, -5.2778800755, 0.0929379305, -0.0006826817],
    },
    "b2": {
        "x": [6770.9351457442, -5933.7589419767, 3279.7524685865, -967.2906583423, 159.8317289682, -14.0267151808, 0.5108811613],
        "y": [0, -2976.2879986855, 1602.7544794819, -462.0149190219, 74.4884405822, -6.3644917671, 0.2252455343],
        "xy": [0, 0, 0.965040193, -0.0546309127, 0.0012917084, -1.14383e-05],
    },
    "c2": {
        "x": [39406.5712626297, -77863.1741143294, 55360.1701572325, -21887.8400068324, 5158.3764225203, -724.0348081819, 56.0522105105, -1.8470088417],
        "y": [0, 9586.8761567725, -5825.2491611377, 1751.6803621934, -290.1765894829, 25.364646181, -0.9172073892],
        "xy": [0, 449.4660736502, -24.4141920625, 0.8465834103, -0.0158943762, 0.0001235384],
    },
}
FLOOR = 0.1
LONGEST = 500_000
# --------------------------------------------------------------------------------------------

PARTS = ("x", "y", "xy")
STRIP = 64
FRAGMENTS = 256  # counted at once
LOG_FLOOR = float(np.log(1 / FLOOR - 1))
K = 4
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def canonical(kmer: str) -> str:
    return min(kmer, kmer.translate(_COMPLEMENT)[::-1])


KMERS = sorted({canonical("".join(p)) for p in itertools.product("ACGT", repeat=K)})  # 136 classes
_CLASS = np.array([KMERS.index(canonical("".join(p))) for p in itertools.product("ACGT", repeat=K)], np.int64)
_CLASSES = np.eye(len(KMERS))[_CLASS]
_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def counts(sequence: bytes) -> np.ndarray:
    """Canonical 4-mer counts; windows with another letter than ACGT are skipped."""
    c = _CODE[np.frombuffer(sequence, np.uint8)]
    if len(c) < K:
        return np.zeros(len(KMERS), np.int64)
    bad = np.concatenate([[0], np.cumsum(c > 3)])
    code = ((c[:-3] * 4 + c[1:-2]) * 4 + c[2:-1]) * 4 + c[3:]
    return np.bincount(_CLASS[code[bad[K:] == bad[:-K]]], minlength=len(KMERS))


def bases(texts: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bases (0 to 3) that ``code`` gives for the bytes of texts, one text after the other, and where each begins; last, where they end. Bytes with another code are left out."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = code[np.frombuffer(texts.buffers()[2], np.uint8, at[-1] - at[0], at[0])] if at[-1] > at[0] else np.zeros(0, np.uint8)
    own = base < 4
    return base[own], np.concatenate([[0], np.cumsum(own)])[at - at[0]]


def base_counts(base: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Canonical 4-mer counts of sequences as ``bases`` gives them."""
    code = ((base[:-3] * 4 + base[1:-2]) * 4 + base[2:-1]) * 4 + base[3:]  # up to 255
    n = [np.bincount(code[x : max(x, y - K + 1)], minlength=4**K) for x, y in zip(at[:-1], at[1:])]
    return (np.array(n, float).reshape(-1, 4**K) @ _CLASSES).astype(np.int64)


def _counted(b: pa.RecordBatch):
    """A batch in pieces of a few fragments, each with its counts, one row a fragment."""
    at = b.schema.get_field_index("seq")
    for k in range(0, b.num_rows, FRAGMENTS):
        piece = b.slice(k, FRAGMENTS)
        yield piece, np.stack([counts((s.as_py() or "").encode("ascii", "replace")) for s in piece.column(at)])


def packed(n: np.ndarray) -> pa.Array:
    """Rows of counts as bytes, each as wide as its largest count needs."""
    return pa.array([x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes() for x, most in zip(n, n.max(axis=1, initial=0))], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    """The vectors (as ``vectors`` gives them) of a column of ``packed`` counts."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    n = np.zeros((len(column), len(KMERS)))
    for width in (1, 2, 4):
        at = np.flatnonzero(size == width * len(KMERS))
        if len(at):
            n[at] = np.frombuffer(column.take(pa.array(at)).buffers()[2], f"<u{width}", len(at) * len(KMERS)).reshape(len(at), -1)
    return normal(n)


def normal(n: np.ndarray) -> np.ndarray:
    return n / np.maximum(np.sqrt((n * n).sum(axis=1, keepdims=True)), 1e-300)


def vectors(contigs: DataFrame, pack: bool = False) -> DataFrame:
    """contig_id, length, tnf: counts over their Euclidean norm (zeros if there is no window); with ``pack`` also the counts, packed (kmers)."""

    def run(batches):
        for b in batches:
            for piece, n in _counted(b):
                values = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * len(KMERS), pa.array(normal(n.astype(float)).ravel()))
                more = [packed(n)] if pack else []
                yield pa.record_batch([piece.column("contig_id"), piece.column("length"), values, *more], ["contig_id", "length", "tnf", "kmers"][: 3 + len(more)])

    return contigs.select("contig_id", "length", "seq").mapInArrow(run, "contig_id long, length long, tnf array<double>" + (", kmers binary" if pack else ""))


def kmer_counts(contigs: DataFrame, norms: bool = False) -> DataFrame:
    """contig_id, kmer, n of the canonical 4-mers that occur; with ``norms`` also the fragment's Euclidean norm."""
    names = pa.array(KMERS, pa.string())

    def run(batches):
        for b in batches:
            for piece, n in _counted(b):
                row, k = np.nonzero(n)
                out = [piece.column("contig_id").take(pa.array(row)), names.take(pa.array(k)), pa.array(n[row, k])]
                more = [pa.array(np.sqrt((n * n).sum(axis=1).astype(float))[row])] if norms else []
                yield pa.record_batch(out + more, ["contig_id", "kmer", "n", "norm"][: 3 + len(more)])

    return contigs.select("contig_id", "seq").mapInArrow(run, "contig_id long, kmer string, n long" + (", norm double" if norms else ""))


def log_length(length) -> np.ndarray:
    return np.log10(np.minimum(np.asarray(length, float), LONGEST))


def side(part: str, at: np.ndarray) -> np.ndarray:
    """The four coefficients' polynomials of one part, stacked along a new first axis in MODEL's order."""
    return np.stack([np.polynomial.polynomial.polyval(at, m[part]) for m in MODEL.values()])


def decided(d: np.ndarray, b1: np.ndarray, c1: np.ndarray, b2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """The probability from the models' coefficients: the first model speaks where it stays below FLOOR, else the second, of FLOOR at least."""
    first = b1 + c1 * d
    z = np.where(first < -LOG_FLOOR, first, np.maximum(b2 + c2 * d, -LOG_FLOOR))
    return 1 / (1 + np.exp(-np.maximum(z, -700)))


def probability(d: np.ndarray, log1: np.ndarray, log2: np.ndarray) -> np.ndarray:
    """Probability that fragments at composition distance ``d`` come from different genomes."""
    x, y = np.minimum(log1, log2), np.maximum(log1, log2)
    return decided(d, *(side("x", x) + side("y", y) + side("xy", x * y)))


def length_terms(log: np.ndarray, longer: int) -> np.ndarray:
    """Rows of factors, one a fragment, whose products are the four coefficients: a shorter one's and a longer one's.

    A coefficient is the shorter fragment's polynomial times 1, plus 1 times the longer one's,
    plus the products of like powers of both lengths, weighted on the shorter side.
    """
    powers = log[:, None] ** np.arange(max(len(m["xy"]) for m in MODEL.values()))
    own, one = side("y" if longer else "x", log), np.ones(len(log))
    rows = []
    for k, m in enumerate(MODEL.values()):
        weight = np.zeros(powers.shape[1])
        weight[: len(m["xy"])] = m["xy"]
        rows.append(np.column_stack([one, own[k], powers] if longer else [own[k], one, powers * weight]))
    return np.stack(rows)


def coefficients(log1: np.ndarray, log2: np.ndarray) -> np.ndarray:
    """The four coefficients of all fragments of one list with all of another.

    With both lists by length, the pairs whose first fragment is the shorter lie beyond a
    staircase: rows are met in strips, in which each side of it is one matrix product, and
    only the columns between a strip's first and last step are computed for both.
    """
    o1, o2 = np.argsort(log1, kind="stable"), np.argsort(log2, kind="stable")
    x, y = log1[o1], log2[o2]
    out = np.empty((len(MODEL), len(x), len(y)))
    short1, long1, short2, long2 = length_terms(x, 0), length_terms(x, 1), length_terms(y, 0), length_terms(y, 1)
    step = np.searchsorted(y, x)  # columns before it are shorter than the row
    for at in range(0, len(x), STRIP):
        r = slice(at, at + STRIP)
        first, last = step[r][0], step[r][-1]
        out[:, r, first:] = short1[:, r] @ long2[:, first:].transpose(0, 2, 1)
        below = long1[:, r] @ short2[:, :last].transpose(0, 2, 1)
        out[:, r, :first] = below[:, :, :first]
        mixed = np.arange(first, last)[None, :] < step[r][:, None]
        out[:, r, first:last] = np.where(mixed, below[:, :, first:], out[:, r, first:last])
    back1, back2 = np.argsort(o1), np.argsort(o2)
    return out[:, back1][:, :, back2]


def probability_sql(d: str, x: str, y: str) -> str:
    """The same as SQL text (both engines), for log lengths x <= y."""

    def sums(name: str) -> str:
        at = {"x": x, "y": y, "xy": f"({x} * {y})"}
        return " + ".join(f"({_sql(v)}) * pow({at[part]}, {k})" if k else f"({_sql(v)})" for part in PARTS for k, v in enumerate(MODEL[name][part]) if v)

    one, two = (f"(({sums(b)}) + ({sums(c)}) * {d})" for b, c in (("b1", "c1"), ("b2", "c2")))
    z = f"(CASE WHEN {one} < {-LOG_FLOOR!r} THEN {one} ELSE greatest({two}, {-LOG_FLOOR!r}) END)"
    return f"(1e0 / (1e0 + exp(-greatest({z}, -700e0))))"


def _sql(v: float) -> str:
    """A double literal."""
    return f"{v!r}" if "e" in repr(v) else f"{v!r}e0"
