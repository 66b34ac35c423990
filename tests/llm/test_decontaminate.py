import numpy as np
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import decontaminate as dc


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (p != t))
    return min(row)


def test_edit_distance_of_the_best_stretch():
    r = np.random.default_rng(0)
    for _ in range(60):
        p, t = bytes(r.integers(97, 100, r.integers(1, 12)).tolist()), bytes(r.integers(97, 100, r.integers(0, 30)).tolist())
        want = slow_distance(p, t)
        got = dc.best_distance(p, t, len(p))
        assert got and got[0] == want
        assert (dc.best_distance(p, t, want - 1) is None) or want == 0


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark):
    """Items of every size class, copies with 0 to 20 % edits, long texts: all found pairs are right, and 0.95 of the brute-force pairs are found."""
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([30, 25, 40, 8, 3, 30, 2, 12, 60, 5])] + [(16, None), (17, "  "), (18, prose(1000, 30)), (None, prose(4000, 20))]
    r = np.random.default_rng(3)
    rows = edge_rows()
    for i in range(90):
        body = prose(i, 120)
        if i % 3:
            item = items[i % 10][1].encode()
            leak = dc.misspelt(item, int([0, 0.05, 0.1, 0.15, 0.2][i % 5] * len(item)), r).decode()
            body = [body + "\n" + leak, leak + " " + body, body[:200] + " " + leak.upper() + "  " + body[200:]][i % 3]
        rows.append((100 + i, body))
    rows.append((300, items[13][1] + " " + prose(78, 6000)))
    got = sorted({(str(x.doc_id), str(x.item_id), x.edit_distance) for x in dc.matches(docs(spark, rows, extra=True), benchmark(spark, items)).collect()})
    want = []
    for d, t in rows:
        text = dc.folded(t or "")
        for i, item in items:
            p = dc.folded(item or "")
            if p and i != 18:  # equal items count once
                hit = dc.best_distance(p, text, int(dc.DISTANCE * len(p)))
                if hit:
                    want.append((str(d), str(i), hit[0]))
    found = {g[:2] for g in got}
    assert not found - {w[:2] for w in want}
    missed = [w for w in want if w[:2] not in found]
    assert len(want) > 55 and len(missed) <= 0.05 * len(want), missed
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert ("300", "None", 0) in got
    kept = dc.keep_uncontaminated(docs(spark, rows, extra=True), benchmark(spark, items)).collect()
    assert {str(x.doc_id) for x in kept} == {str(d) for d, _ in rows} - {g[0] for g in got} and "_b" in kept[0]


def test_item_blocks_and_empty_tables(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(5)]
    rows = [(i, "intro " + t + " outro") for i, t in items] + [(9, prose(77, 60))]
    assert len(list(dc.blocks(benchmark(spark, items), 300))) > 1
    assert {(r.doc_id, r.item_id) for r in dc.matches(docs(spark, rows), benchmark(spark, items)).collect()} == {(i, i) for i in range(5)}
    assert dc.matches(docs(spark, []), benchmark(spark, items)).count() == 0
    assert dc.matches(docs(spark, rows), benchmark(spark, [])).count() == 0
    assert dc.keep_uncontaminated(docs(spark, rows), benchmark(spark, [])).count() == 6


def test_recall_at_every_size_and_edit_rate():
    for words in (2, 4, 7, 30):
        items = [(i, dc.folded(prose(2000 + i, words))) for i in range(40)]
        settings, exact, _ = dc.tuned(items)
        block = dc.Items(items, settings, exact=tuple(exact))
        r = np.random.default_rng(5)
        for rate in (0, 0.05, 0.1, 0.15, 0.18, 0.2):
            copies = [dc.misspelt(t, int(rate * len(t)), r) for _, t in items]
            text, at = folded_all([b"before it " + c + b" and after" for c in copies])
            got = {h[:2] for h in dc.find(block, text, at)}
            assert sum((k, k) in got for k in range(40)) >= 0.95 * 40, (words, rate, settings, len(exact))


def test_short_items_are_found_by_walks():
    r = np.random.default_rng(21)
    for words in (5, 6, 7):
        items = [(i, dc.folded(prose(4000 + 100 * words + i, words))) for i in range(100)]
        settings, exact, _ = dc.tuned(items)
        assert len(exact) <= 5, (words, settings)
        block = dc.Items(items, settings, exact=tuple(exact))
        found = np.zeros(100)
        for _ in range(10):  # other copies than those of the tuning
            text, at = folded_all([b"before it " + dc.misspelt(t, int(0.2 * len(t)), r) + b" and after" for _, t in items])
            found[[j for row, j, *_ in dc.find(block, text, at) if row == j]] += 0.1
        assert found.mean() >= 0.93 and (found >= 0.7).mean() >= 0.97, words


def test_blocks_of_items_are_passes(spark, monkeypatch):
    items = [(i, prose(1000 + i, 30)) for i in range(5)]
    rows = [(i, "intro " + t + " outro") for i, t in items] + [(9, prose(77, 60))]
    whole = dc.blocks
    monkeypatch.setattr(dc, "blocks", lambda b: whole(b, 300))
    assert [r.doc_id for r in dc.keep_uncontaminated(docs(spark, rows), benchmark(spark, items)).collect()] == [9]


def folded_all(bodies):
    return dc.fold(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))


def test_scripts_without_spaces():
    item = "これは評価用の問題文でありどの文書にも現れてはならないものとする"
    items = [(1, dc.folded(item))]
    settings, exact, _ = dc.tuned(items)
    text, at = folded_all([("前置きの文章がここにあり" + item + "そのあとに続く文章").encode(), "別の文章".encode()])
    assert {h[:2] for h in dc.find(dc.Items(items, settings, exact=tuple(exact)), text, at)} == {(0, 0)}


def test_repeated_phrases_are_searched_in_bounded_work():
    phrase = b"the same few words again and again until the end of it "
    items = [(1, dc.folded((phrase * 6).decode()))]
    settings, exact, _ = dc.tuned(items)
    text, at = folded_all([phrase * 4000])
    assert [h[:3] for h in dc.find(dc.Items(items, settings, exact=tuple(exact)), text, at)] == [(0, 0, 0)]


def test_lanes_equal_the_plain_distance():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 65, 50)
    patterns = np.zeros((50, 64), np.uint8)
    for k, n in enumerate(sizes):
        patterns[k, :n] = r.integers(97, 100, n)
    texts = r.integers(97, 100, (50, 80)).astype(np.uint8)
    lanes, eq, best = dc.Lanes(sizes), dc._masks(patterns, sizes), sizes.copy()
    for t in range(80):
        best = np.minimum(best, lanes.step(eq[np.arange(50), texts[:, t]]))
    assert best.tolist() == [slow_distance(patterns[k, : sizes[k]].tobytes(), texts[k].tobytes()) for k in range(50)]


def test_exact_search_is_complete():
    r = np.random.default_rng(9)
    items = [(i, dc.folded(prose(3000 + i, w))) for i, w in enumerate([1, 2, 3, 8, 20])]
    block = dc.Items(items, {}, exact=tuple(range(5)))
    bodies = [prose(i, 20).encode() + b"~" + dc.misspelt(items[i % 5][1], int(dc.DISTANCE * len(items[i % 5][1])), r) + b"~" + prose(i + 50, 5).encode() for i in range(40)]
    text, at = dc.fold(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))
    got = {(h[0], h[1]): h[2] for h in dc.find(block, text, at)}
    want = {}
    for k in range(40):
        for j, (_, t) in enumerate(items):
            d = slow_distance(t, text[at[k] : at[k + 1]].tobytes())
            if d <= int(dc.DISTANCE * len(t)):
                want[k, j] = d
    assert got == want and len(want) >= 40


def test_folding_keeps_texts_apart():
    data = "A\n b".encode() + b"" + "ÉÑ×".encode()
    text, at = dc.fold(np.frombuffer(data, np.uint8), np.array([0, 4, 4, len(data)]))
    parts = [text[i:j].tobytes().decode() for i, j in zip(at[:-1], at[1:])]
    assert [p.strip() for p in parts] == ["a b", "", "éñ×"] and all(p.startswith(" ") for p in parts)
