import random
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import divergence
from tests.llm.util import docs, edge_rows

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def slow(rows, least=10, top=10):
    """The contract, word for word, on (text, lang, source) rows."""
    count, held, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = WORD.findall(text.translate(LOWER))
        groups.add((lang, source))
        count.update((lang, source, w) for w in words)
        count.update((lang, w) for w in words)
        held.update((lang, w) for w in set(words))
    kept = {lang: sorted(w for of, w in held if of == lang and held[of, w] >= least) for lang, _ in groups}

    def chances(*group):
        terms = kept[group[0]]
        total = sum(count[*group, w] for w in terms) + 2 * len(terms)
        return {w: 1 + 1_000_000_000 * (count[*group, w] + 2) // total for w in terms}

    out = []
    for lang, source in groups:
        p, of_lang = chances(lang, source), chances(lang)
        f = lambda q, w: (p[w] - q[w]) ** 2 // (p[w] + q[w])  # noqa: E731, B023
        others = [(s, chances(lang, s)) for of, s in groups if of == lang and s != source]
        pairs = [(sum(f(q, w) for w in kept[lang]), s) for s, q in others]
        terms = [(f(of_lang, w), w) for w in kept[lang] if count[lang, source, w] and p[w] > of_lang[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def rows_of(seed, n, sources, langs=("en", "fr")):
    r = random.Random(seed)
    words = ["été", "Straße", "ÀB", "日本", "x"] + ["".join(r.choice("abcdef") for _ in range(r.randint(1, 3))) for _ in range(120)]
    out = []
    for _ in range(n):
        s = int(r.random() ** 2 * sources)
        out.append((" ".join(r.choice(words[s % 7 :: 1 + s % 3]) + r.choice(["", "!", "1"]) for _ in range(r.randint(0, 40))), r.choice(langs), f"s{s}"))
    return out


def test_whole_audit_against_brute_force(spark):
    rows = rows_of(1, 400, 9) + [(None, None, None), ("", "en", "silent"), ("word", None, "s1"), ("a b c", "xx", "one"), ("a b c", "xx", "two"), ("nul\0nul É é", "en", "s\0"), ("nul", "en\0", "s")]
    rows += [("Same same", "yy", s) for s in ("b", "a", "é", "Z") for _ in range(5)]  # ties
    assert got(divergence.audit(table(spark, rows))) == slow(rows)


def test_many_sources_and_narrow_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 4)
    monkeypatch.setattr(divergence, "WIDE", 8)
    rows = rows_of(2, 500, 30, ("en",))
    assert got(divergence.audit(table(spark, rows), least=5, top=3)) == slow(rows, 5, 3)


def test_edge_rows_and_empty(spark):
    rows = [(t, "en", "s") for _, t in edge_rows()]
    assert got(divergence.audit(docs(spark, edge_rows(), extra=True), least=1)) == slow(rows, 1)
    assert got(divergence.audit(docs(spark, []))) == []


@pytest.mark.parametrize("same", [False, True])
def test_joint_traversal_opens_only_quadrants_with_counts(same):
    r = np.random.default_rng(3)
    side, trees, columns = 16, 4, 60

    def tree(rows):
        zero = r.integers(1, 50, rows)
        row, col = np.repeat(np.arange(rows), 3), r.integers(0, 12, 3 * rows)  # counts gather on the left
        at = np.unique(row * 100 + col)
        row, col, p = at // 100, at % 100, r.integers(50, 10**9, len(at))
        dense = np.repeat(zero[:, None], columns, axis=1)
        dense[row, col] = p
        return divergence.Quadtrees(row, col, p, zero, trees, side), dense

    a, da = tree(13)
    b, db = (a, da) if same else tree(10)
    sums, evaluated = divergence.joint(a, b, columns, same)
    want = divergence.gap(da[:, None, :], db[None, :, :]).sum(axis=2)
    own = np.triu(np.ones(want.shape, bool), 1) if same else np.ones(want.shape, bool)
    assert (sums[own] == want[own]).all()
    assert evaluated <= own.sum() * 6  # three counts a row on each side, of 60 columns
