import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import common, examples, language, quality, toxicity

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def truth(spark):
    d = common.table(spark, SF, "documents").select("doc_id", "lang")
    return {r.doc_id: r for r in d.join(common.table(spark, SF, "labels"), "doc_id", "left").collect()}


def test_language_held_out(spark, truth):
    got = language.op4_language_ecoc(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == common.held_py(r.doc_id, 4, 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    empty = ([], np.ones((0, 0), np.float32), None, None)
    model = language.fit(common.table(spark, SF, "documents"))
    for m in (model, empty):
        got = language.identify(docs(spark, edge_rows(), extra=True), m).collect()
        assert len(got) == len(edge_rows())
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    one = language.fit(docs(spark, [(i, "some words") for i in range(9)]))
    assert one[0] == ["en"]
    assert {r.lang_pred for r in language.identify(docs(spark, [(1, "x"), (2, "12")]), one).collect()} == {"en", "und"}
    assert language.fit(docs(spark, []))[0] == []


def test_features_of_pieces_are_those_of_the_whole():
    for text in ("", "a", "ab", "  a  b!! c", "Ünï cöde 12 x", prose(3, 300) + "  .. " + prose(4, 50)):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = language.features(data)
        for piece in (1, 2, 3, 7, 64):
            assert np.allclose(language.features(data, piece=piece), whole)


def test_codewords_correct_errors():
    for k in (2, 3, 4, 6, 12):
        code = language.codewords(k)
        assert len({tuple(c) for c in code}) == k and all(len(set(b)) == 2 for b in code.T)
    code = language.codewords(4)
    margins = code * 3.0
    margins[:, 0] *= -1  # one wrong bit of seven
    best, p, lead = language.decode(margins, code)
    assert best.tolist() == [0, 1, 2, 3] and (p > 0.5).all() and (lead > 0).all()


def test_quality_held_out(spark, truth):
    got = quality.op8_quality_conv(spark, SF).collect()
    assert len(got) == len(truth) and all(r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id].quality is not None]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in held]) > 0.9


def test_quality_network():
    net = quality.Net()
    r = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = (r.standard_normal(net.p[k].shape) * 0.3).astype(np.float32)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    assert np.allclose(net.describe(data), net.describe(data, step=quality.STRIDE * quality.BLOCK * 3), atol=1e-6)  # pieces change nothing
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    p = net.gradient(data[:900], 1.0, 1.0, grads)
    loss = lambda: -np.log(net.probability(net.describe(data[:900])[None])[0])
    assert abs(p - np.exp(-loss())) < 1e-6
    for k, at in (("filters", (3, 2)), ("out", (1,)), ("level", (0,)), ("bias", (4,))):
        old, eps = net.p[k][at], 1e-3
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        slope = (up - loss()) / (2 * eps)
        net.p[k][at] = old
        assert abs(slope - grads[k][at]) < 0.02 * max(1, abs(slope))
    assert net.describe(np.zeros(0, np.uint8)).shape == (2 * quality.FILTERS,)


def test_long_labelled_texts_are_learned_from(spark):
    net = quality.Net()
    data = np.random.default_rng(1).integers(97, 123, 5 * quality.PIECE_FRAMES * quality.STRIDE).astype(np.uint8)
    whole = {k: np.zeros_like(v) for k, v in net.p.items()}
    p = net.gradient(data, 1.0, 1.0, whole)
    assert abs(p - net.probability(net.describe(data)[None])[0]) < 1e-6  # pieces of a long text change nothing
    rows = [(i, ("good sentence here. " if i % 2 else "x1$ zz## 9 ") * (9000 if i < 4 else 20)) for i in range(40)]
    net = quality.fit(docs(spark, rows), labels(spark, [(i, i % 2, 0) for i in range(40)]))
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in quality.scored(docs(spark, rows), net).collect())


def test_sample_ends_by_bytes_of_whole_texts(spark):
    rows = [(i, "x" * (50_000 if i % 3 == 0 else 100)) for i in range(200)]
    of = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "doc_id long, text string, label int")
    kept = examples.within(of, 400_000).collect()
    for label in (0, 1):
        size = [len(r.text) for r in kept if r.label == label]
        assert 400_000 <= sum(size) < 450_000  # the bound, and one text at most
        assert {100, 50_000} == set(size)  # short and long ones alike
    assert examples.within(of, 1 << 30).count() == 200 and examples.within(of.limit(0), 10).count() == 0


def slow_quality(net, text):
    """The network, one frame and one chunk at a time."""
    p, data = {k: v.astype(np.float64) for k, v in net.p.items()}, text.encode()
    frames = max(1, -(-(len(data) - quality.WIDTH) // quality.STRIDE) + 1)
    data += bytes((frames - 1) * quality.STRIDE + quality.WIDTH - len(data))
    z = []
    for k in range(frames):
        x = np.concatenate([p["table"][c] for c in data[k * quality.STRIDE : k * quality.STRIDE + quality.WIDTH]])
        z.append(np.maximum(x @ p["filters"] + p["bias"], 0))
    blocks = -(-frames // quality.BLOCK)
    chunks = [np.max(z[k * quality.BLOCK : (k + quality.BLOCKS) * quality.BLOCK], axis=0) for k in range(max(1, blocks - quality.BLOCKS + 1))]
    d = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(d @ p["out"] + p["level"][0])))


def test_whole_quality_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(0, 150)) if i % 2 else "".join(r.choice("#$% zx19\n") for _ in range(r.randint(0, 900)))) for i in range(90)] + [(90, None), (91, ""), (92, "é日" * 4000), (92, "é日" * 4000)]
    d, y = docs(spark, rows), labels(spark, [(i, i % 2, 0) for i in range(60)])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    y.write.parquet(str(tmp_path / "labels.parquet"))
    net = quality.fit(d, y)
    got = sorted((x.doc_id, x.held_out, x.predicted, round(x.score, 4)) for x in quality.op8_quality_conv(spark, str(tmp_path)).collect())
    want = sorted((i, common.held_py(i, 4, 2), int(s >= 0.7), round(float(s), 4)) for i, t in rows for s in [slow_quality(net, t or "")])
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-4)


def slow_language(model, text):
    """Features, margins and decoding of one text, n-gram by n-gram and bit by bit."""
    names, code, w, b = model
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    t = [32]
    for c in [*text.encode(), 32]:
        c = c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
        if c != 32 or t[-1] != 32:
            t.append(c)
    counts, mask, shift = np.zeros((3, language.DIM)), (1 << 32) - 1, 32 - (language.DIM.bit_length() - 1)
    for k in range(1, len(t)):
        for n, gram in enumerate((t[k] * 0x9E3779B1, (t[k - 1] << 8 | t[k]) * 0x85EBCA6B, (t[k - 2] << 16 | t[k - 1] << 8 | t[k]) * 0xC2B2AE35 if k > 1 else None)):
            if gram is not None:
                counts[n, (gram & mask) >> shift] += 1
    x = np.sqrt(counts).sum(axis=0)
    m = x / np.sqrt((x * x).sum()) @ w.astype(np.float64) + b
    loss = [sum(np.log1p(np.exp(-c * v)) for c, v in zip(word, m)) for word in code]
    p = np.exp(min(loss) - np.array(loss))
    return names[int(np.argmin(loss))], float((p / p.sum()).max())


def test_whole_language_query_against_brute_force(spark, tmp_path):
    base = common.table(spark, SF, "documents").orderBy("doc_id").limit(120).select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(900_000 + i, t, None, "s", 0) for i, t in enumerate([None, "", " 12 ", "ß", "a", "日本語", "A  b--C", "é" * 3])], base.schema)
    base.union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    rows = base.union(odd).collect()
    model = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = {x.doc_id: x for x in language.op4_language_ecoc(spark, str(tmp_path)).collect()}
    for x in rows:
        lang, score = slow_language(model, x.text)
        assert got[x.doc_id].held_out == common.held_py(x.doc_id, 4, 2) and abs(got[x.doc_id].score - score) < 1e-3, x.text
        assert got[x.doc_id].lang_pred == lang or abs(score - 0.5) < 1e-3


def test_many_languages_are_all_learned(spark):
    r = random.Random(6)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåæ", 7)) for _ in range(260)]
    text = lambda k: " ".join("".join(r.choice(alphabets[k]) for _ in range(r.randint(2, 6))) for _ in range(60))
    rows = [(i, text(i % 260), f"l{i % 260:03d}") for i in range(260 * 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    assert len(model[0]) == 260
    got = {x.doc_id: x.lang_pred for x in language.identify(d, model).collect()}
    held = [(i, lang) for i, _, lang in rows if common.held_py(i, 4, 2)]
    assert np.mean([got[i] == lang for i, lang in held]) > 0.9
    few, counts = examples.choose(d.select("doc_id", "lang"), "doc_id", "lang", 800, most=520)
    assert len(counts) == 260 and len(few) < 2 * 520  # a bound on rows, not on languages


def test_kept_rows_keep_clashing_columns(spark):
    d = docs(spark, edge_rows()).withColumns({c: F.lit(i) for i, c in enumerate(("score", "_score", "__SCORE", "evidence"))})
    for kept in (quality.keep_good(d, None, 0.0), toxicity.keep_clean(d, None, 1.0)):
        assert kept.columns == d.columns and kept.count() == len(edge_rows())
        assert kept.select("score", "_score", "__SCORE", "evidence").distinct().collect() == [(0, 1, 2, 3)]


def test_scores_of_edge_rows(spark):
    d = docs(spark, edge_rows(), extra=True)
    none = labels(spark, [(1, None, None), (None, 1, 1)])
    for fit, module in ((quality.fit, quality), (toxicity.fit, toxicity)):
        model = fit(d, none)
        got = module.scored(d, model).collect()
        assert model is None and len(got) == len(edge_rows())
        some = fit(d, labels(spark, [(i, i % 2, i % 2) for i in range(9)] + [(3, 0, 1), (77, 1, 1)]))
        got = module.scored(d, some).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
        assert module.scored(docs(spark, []), some).count() == 0
    assert quality.keep_good(d, quality.fit(d, none), 0.0).columns == d.columns
    assert toxicity.keep_clean(d, None, 1.0).columns == d.columns


def test_toxicity_held_out(spark, truth):
    got = toxicity.op7_toxicity_knn(spark, SF).collect()
    assert len(got) == len(truth) and all(r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id].toxic is not None]
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in held]) > 0.93


def test_block_max_search_is_a_full_scan():
    r = np.random.default_rng(2)
    terms, n = 40, 500
    vectors = []
    for _ in range(n):
        t = np.sort(r.choice(terms, r.integers(1, 8), replace=False))
        w = r.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    vectors += vectors[:30]  # ties
    ids = np.arange(len(vectors))
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), np.ones(terms), ids, np.zeros(len(ids)), np.ones(len(ids)), vectors)
    dense = np.zeros((len(ids), terms))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for _ in range(60):
        t = np.sort(r.choice(terms, r.integers(1, 6), replace=False))
        w = r.random(len(t))
        w /= np.sqrt((w * w).sum())
        cosine = dense[:, t] @ w
        want = sorted((-round(c, 12), int(index.ids[i])) for i, c in enumerate(cosine) if c > 0)[: toxicity.NEIGHBOURS]
        place, score = index.search(t, w)
        assert [int(x) for x in index.ids[place]] == [i for _, i in want]
        assert np.allclose(score, [-c for c, _ in want], atol=1e-9)


def test_only_near_copies_are_merged():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(1, 1 << 62, 200).astype(np.uint64))
    other = np.unique(r.integers(1, 1 << 62, 200).astype(np.uint64))
    near = np.unique(np.concatenate([base[:195], other[:5]]))
    half = np.unique(np.concatenate([base[:120], other[:80]]))  # shares the smallest hashes as like as not
    rows = [(base, 1), (other, 1), (near, 1), (half, 1), (base, 0), (base, 1), (np.zeros(0, np.uint64), 1), (np.zeros(0, np.uint64), 1)]
    got = toxicity.near_copies(rows)
    assert got[:6] == [0, 1, 0, 3, 4, 0] and got[6] == 6


def test_whole_query_against_brute_force(spark, tmp_path):
    """op7 over a small table: terms, document frequencies, cosines, votes and calibration with plain Python sets and a full scan."""
    import math
    import re

    sf = str(tmp_path)
    rows = [(i, prose(i, 60) + " " + ("vile scum " if i % 3 == 0 else "kind friend ") * (1 + i % 3)) for i in range(90)] + [(200, None), (201, "scum " * 9000), (202, "")]
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    labels(spark, [(i, 0, int(i % 3 == 0)) for i in range(90)]).write.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op7_toxicity_knn(spark, sf).collect()}
    assert len(got) == len(rows)

    def terms(t):
        out = {}
        for w in re.findall(r"[a-z]+", (t or "").lower()):
            for x in [w, *(w[:k] + "-" for k in toxicity.STEMS if len(w) > k)]:
                out[x] = out.get(x, 0) + 1
        return out

    train = [(i, terms(t), int(i % 3 == 0)) for i, t in rows[:90] if not common.held_py(i, 5, 0)]
    model = toxicity.fit(docs(spark, rows), labels(spark, [(i, 0, int(i % 3 == 0)) for i in range(90)]))
    chosen = {"vile", "scum", "kind", "friend", "frie-", "frien-"}
    assert len(model.index.vocabulary) == len(chosen)
    df = {x: sum(x in terms(t) for _, t in rows) for x in chosen}

    def vector(t):
        w = {x: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, c in t.items() if x in chosen}
        n = math.sqrt(sum(v * v for v in w.values())) or 1
        return {x: v / n for x, v in w.items()}

    examples = [(i, vector(t), y) for i, t, y in train]
    weight = len(train) / len(examples)
    for i, t in rows:
        v = vector(terms(t))
        near = sorted((-round(sum(w * e.get(x, 0) for x, w in v.items()), 12), j, y) for j, e, y in examples)
        near = [(-c, j, y) for c, j, y in near if c < 0][: toxicity.NEIGHBOURS]
        w = [weight * c / (1.05 - min(c, 1.0)) for c, _, _ in near]
        vote = (sum(a * y for a, (_, _, y) in zip(w, near)) + toxicity.SMOOTH * model.rate) / (sum(w) + toxicity.SMOOTH)
        assert abs(got[i].score - model.calibrated(vote)) < 1e-6 and got[i].evidence == [j for _, j, _ in near], i


def test_held_rule(spark):
    got = spark.range(50).select("id", common.held(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == common.held_py(r.id, 5, 0) for r in got)
