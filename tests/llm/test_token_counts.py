import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import common, token_counts, tokens
from tests.llm.util import docs, edge_rows, prose

ODD = ["Ünïcode — ‘quotes’", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|startoftext|>", "tab\tand\x0bmore \r\n", "\x1c\x1dseparators\x85nel line", "H̱ J̌ É É", "İİ ẞ ΑΣ", "don't DON'T we'LL", "日本語 ٣ x²", "  \n ", "a b", "\0nul", "é\ń", "THE the The"]


def library():
    return Tokenizer.from_file(tokens.default_path())


def slow(rows, limit=2048):
    t = library()
    out = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_and_cache(spark, monkeypatch):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, "hot copy") for i in range(60)] + [(300 + i, prose(i, 30)) for i in range(40)]
    cache = common.scratch(spark, "cache")
    assert got(token_counts.count_tokens(docs(spark, rows, extra=True), cache)) == slow(rows)
    path = f"{cache}/tokenizer={token_counts.tokenizer_version(tokens.default_path())}"
    stored = spark.read.parquet(path)
    first = stored.count()
    assert first == stored.select("content").distinct().count() == docs(spark, rows).select(token_counts.content_digest(F.col("text"))).distinct().count()
    # the second run encodes the one text that is new, and appends it
    asked = []
    find = token_counts.misses
    monkeypatch.setattr(token_counts, "misses", lambda *a, **k: asked.append(find(*a, **k)) or asked[-1])
    more = [*rows, (900, "HOT   copy"), (901, "quite new"), (902, " quite NEW\n")]
    assert got(token_counts.count_tokens(docs(spark, more), cache)) == slow(more)
    assert spark.read.parquet(path).count() == first + 1
    assert got(token_counts.count_tokens(docs(spark, []), cache)) == []


@pytest.mark.parametrize("bits", [12, 27])
def test_full_bit_maps_lose_nothing(spark, bits):
    rows = [(i % 1500, f"text {i % 700}") for i in range(3000)] + [(None, "text 1"), (5, "text 1")]
    d = docs(spark, rows).repartition(5)
    slim = d.select("doc_id", token_counts.content_digest(F.col("text")).alias("content"))
    none = spark.createDataFrame([], "content binary, n_tokens long")
    found = token_counts.misses(d, slim, none, tokens.default_path(), most_bits=bits)
    t = library()
    want = sorted(len(t.encode(f"text {i}", add_special_tokens=False).ids) for i in range(700))
    assert sorted(r.n_tokens for r in found.collect()) == want
    assert found.select("content").distinct().count() == 700
    some = common.written(found.limit(300), "some")
    left = token_counts.misses(d, slim, some, tokens.default_path(), most_bits=bits)
    assert left.count() == 400 and left.join(some, "content").count() == 0


def test_normal_form_keeps_the_ids(spark):
    r = random.Random(5)
    letters = "AaZ sS'\t\n\r\x0b\f\x1f\x85 <|>1²é̱́̇JHIİΣς日.-/"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3000)] + [f"{a}{b}{c}" for a in "AHJİé" for b in ("́", "̱", "̌", " ", "\n") for c in "̇aZ"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    t = library()
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    assert [x for x, y in d.select("text", token_counts.normal_form(F.col("text"))).collect() if ids(x) != ids(y)] == []


def test_version_follows_the_file(tmp_path):
    a = token_counts.tokenizer_version(tokens.default_path())
    other = tmp_path / "t.json"
    with open(tokens.default_path(), "rb") as f:
        other.write_bytes(f.read() + b" ")
    assert token_counts.tokenizer_version(str(other)) != a == token_counts.tokenizer_version(tokens.default_path())
