import hashlib
import re

import xxhash
from pyspark.sql import functions as F
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import order_minhash as omh

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values):
    """Spark's xxhash64 of several columns."""
    seed = 42
    for v in values:
        if v is None:
            continue
        b = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(b, seed & MASK)
    return signed(seed)


def slow_fingerprint(text, k=3, slots=32):
    low, bits = omh._LOW, slots.bit_length() - 1
    place = (1 << low) - 1
    w = re.findall(r"[^ \t\n\v\f\r]{1,16}", text or "")
    s = sorted((h(*w[i : i + k]) & ~place) | i for i in range(len(w)))
    seen, t = {}, []
    for x in s:
        o = seen.get(x >> low, 0)
        seen[x >> low] = o + 1
        t.append(x if o == 0 else (h(x >> low, (o,)) & ~place) | (x & place))
    t.sort()
    out = []
    for slot in range(-slots // 2, slots // 2):
        own = [x for x in t if x >> (64 - bits) == slot][:2]
        if len(own) == 1:
            v = h(slot, own[0] >> low)
        elif own:
            a, b = own
            v = h(slot, a >> low, b >> low) if a & place < b & place else h(slot, b >> low, a >> low, (1,))
        else:
            continue
        out.append(v & 0x7FFFFFFF)
    return out


def test_fingerprints_are_the_definition(spark):
    rows = edge_rows() + [(50, prose(5, 900, 20)), (51, "a a a a a a a a a a"), (52, "x y z " * 200)]
    got = omh.fingerprint(docs(spark, rows, extra=True), "text", "sig").select("text", "sig").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (list(r.sig) if r.text is not None else list(r.sig or [])) == slow_fingerprint(r.text)


def slow_query(rows):
    """Descending ids, null ids last, ties by the hash of the text."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), h(r[1] or "")))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), slow_fingerprint(t), slow_fingerprint(edited), slow_fingerprint(nxt)))
    return out


def likeness(a, b):
    most = max(len(a), len(b))
    j = (len(set(a) & set(b)) / most) ** 0.5 if most else 1
    return 2 * j / (1 + j) if most else 1.0


def test_whole_query_against_brute_force(spark, monkeypatch):
    rows = edge_rows() + [(1000 + 7 * i, prose(i, 30 + i)) for i in range(60)]
    for per in (500, 3):
        monkeypatch.setattr(omh.common.id_buckets, "__defaults__", (per,))
        got = omh.edited_fingerprints(docs(spark, rows, extra=True)).collect()
        key = lambda x: (str(x[0]), x[1], x[2])
        have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, list(r.sig), list(r.edited_sig), r.near_edited, r.near_next) for r in got), key=key)
        want = sorted(slow_query(rows), key=key)
        assert [x[:5] for x in have] == [x[:5] for x in want]
        for x, w in zip(have, want):
            assert abs(x[5] - likeness(w[3], w[4])) < 1e-9 and abs(x[6] - likeness(w[3], w[5])) < 1e-9


def test_id_buckets_are_even_whatever_the_ids(spark):
    lowest, highest = -(1 << 63), (1 << 63) - 1
    for ids in (range(2000), [*range(2000), 10**18], [lowest, *range(0, 4000, 2), highest], [7] * 900 + list(range(1000)), [*range(1000), *range(10**9, 10**9 + 1000), 10**17], [None, 3, None]):
        d = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        bucket, n = omh.common.id_buckets(d, "doc_id", 50)
        got = sorted((-(1 << 64) if r[0] is None else r[0], r[1]) for r in d.select("doc_id", bucket(F.col("doc_id"))).collect())
        assert [b for _, b in got] == sorted(b for _, b in got)
        rows = {}
        for i, b in got:
            rows.setdefault(b, []).append(i)
        assert all(len(x) <= 200 or len(set(x)) == 1 for x in rows.values()), {b: len(x) for b, x in rows.items()}
        assert n <= 2 * len(ids) and all(b < n for b in rows)


def test_one_row_none_and_order(spark):
    one = omh.edited_fingerprints(docs(spark, [(5, "one two three four five six")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert omh.edited_fingerprints(docs(spark, [])).count() == 0
    text = prose(9, 400).split()
    moved = text[200:] + text[:200]
    a, b = slow_fingerprint(" ".join(text)), slow_fingerprint(" ".join(moved))
    assert 0 < len(set(a) & set(b)) < len(a)  # the same words in another order differ


def test_no_python_in_the_plan(spark):
    plan = omh.op10_order_minhash(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert spark.range(1).select(F.lit(1)).count() == 1
