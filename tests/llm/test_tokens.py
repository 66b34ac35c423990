import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import common, packing, token_orc, tokens

TEXTS = ["", " a  b ", "It's, I'LL!! don't.", "é Áx É.", "<|startoftext|>x, y<|endoftext|>.", "日本 語、x1,2.", "İstanbul ΣΑΣ. ß,", "a</w>b x,<|endoftext|>,", "≮ ≠,̸ a.́ b", "a×b ÷ c", "(the)quick-brown; X", "é" * 40 + " " + "a" * 100, "\x1c a\x85b c", "'s it x's-y,'re", " nb sp"]


@pytest.fixture(scope="module")
def words():
    return tokens.Words(tokens.default_path())


def same(words, texts):
    ids, at = words.encode(pa.array(texts, pa.large_string()))
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [w.ids for w in want]


def test_equal_to_the_library(words):
    same(words, TEXTS + [prose(1, 500), prose(2, 50).upper() + "!!"])
    same(words, TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abzABZ éÉß×,.!?'<|>$0 9\n\t́日Σ")), max_size=30), max_size=6))
def test_equal_to_the_library_on_random_texts(words, texts):
    same(words, texts)


def test_reset_and_overflow_keep_ids(words, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEYS", 5)
    for seed in range(3):
        same(words, [prose(seed, 300)])


def slow_ids(words, text, end):
    return [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_orc_round_trip(spark, words):
    rows = edge_rows()
    path = common.scratch(spark, "t")
    token_orc.write(docs(spark, rows, extra=True), path)
    stored = token_orc.read(spark, path)
    got = [(r.doc_id, list(r.ids)) for r in stored.collect()]
    want = [(d, slow_ids(words, t, 2)) for d, t in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    files = sorted({r.f for r in stored.select(F.input_file_name().alias("f")).collect()})
    by_file = [[r.doc_id for r in token_orc.read(spark, f).collect()] for f in files]
    flat = [-1 if d is None else d for f in by_file for d in f]
    assert flat == sorted(flat)  # ascending over and within files
    index = {}
    for r in token_orc.index(stored).collect():
        index.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    start = 0
    for d in sorted({d for d, _ in rows}, key=lambda d: (d is not None, d or 0)):
        group = sorted((len(i), crc(i)) for k, i in want if k == d)
        expected = []
        for n, c in group:
            expected.append((start, n, c))
            start += n
        assert sorted(index[d]) == expected
    plan = stored.where("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan


def test_orc_empty_table(spark):
    path = common.scratch(spark, "t")
    token_orc.write(docs(spark, []), path)
    assert token_orc.index(token_orc.read(spark, path)).count() == 0


def slow_least(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] >= lengths[i] and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] -= lengths[i]
                go(i + 1, bins)
                bins[k] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_solver_is_optimal_on_small_cases(lengths):
    counts = {k: lengths.count(k) for k in set(lengths)}
    patterns, sequences, bound, _ = packing.solve(counts, 20)
    used = {}
    for p, t in patterns:
        assert sum(p) <= 20
        for x in p:
            used[x] = used.get(x, 0) + t
    assert used == counts
    least = slow_least(lengths, 20)
    assert packing.lower_bound(counts, 20) == bound <= least == sequences == sum(t for _, t in patterns)


def test_search_alone_beats_best_fit_and_reaches_leaves():
    saved = leaves = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        pieces = []
        for _ in range(6):  # six full sequences, cut at random places
            cuts = np.sort(r.choice(np.arange(1, 200), 3, replace=False)) * 10
            pieces += np.diff([0, *cuts, 2000]).tolist()
        histogram = {k: pieces.count(k) for k in set(pieces)}
        fit = packing.descent(histogram, 2000, steps=1)
        n, least = sum(t for _, t in fit), min(sum(p) for p, _ in fit)
        if n > 6:
            found = packing.search(histogram, 2000, n, least)
            leaves += found.leaves
            if found.sequences:
                assert found.least < least and sorted(x for p in found.sequences for x in p) == sorted(pieces) and all(sum(p) <= 2000 for p in found.sequences)
                saved += len(found.sequences) < n
    assert leaves >= saved >= 3
    assert packing.NODES >= 10 * packing.PARTNERS


def test_whole_search_shows_that_no_fewer_will_do():
    answer = packing.solve({6: 3, 5: 1}, 10)  # two by volume, four in fact
    assert answer.sequences == 4 and answer.status == "optimal"


def test_solver_scales_with_lengths_not_counts():
    r = np.random.default_rng(0)
    counts = {int(k): int(n) for k, n in zip(range(1, 2049), r.integers(1, 10**6, 2048))}
    answer = packing.solve(counts)
    assert len(answer.patterns) <= 2 * 2048 and answer.sequences == sum(t for _, t in answer.patterns) <= 1.002 * answer.bound
    assert answer.status == ("optimal" if answer.sequences == answer.bound else "within budget")
    # budgets of nothing still give a packing, by best fit and not one piece a sequence
    small = {k: 3 for k in range(100, 400)}
    plain = packing.solve(small, steps=1, nodes=0, rounds=0)
    assert plain.sequences <= 1.1 * plain.bound and sum(t * len(p) for p, t in plain.patterns) == 900


def test_packing_whole(spark, words):
    rows = edge_rows() + [(100 + i, prose(i, 5 + i * 7)) for i in range(40)]
    got = packing.pack(docs(spark, rows, extra=True)).collect()
    want = {}
    for d, t in rows:
        ids = slow_ids(words, t, 0)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.setdefault((d, k // 2048, k, len(part), crc(part)), []).append(1)
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert have == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    lengths = [r.length for r in got]
    assert len(bins) <= packing.lower_bound({k: lengths.count(k) for k in set(lengths)}, 2048) + 1
    assert {(r.sequences, r.bound) for r in got} == {(len(bins), packing.lower_bound({k: lengths.count(k) for k in set(lengths)}, 2048))}
    assert packing.pack(docs(spark, [])).count() == 0
