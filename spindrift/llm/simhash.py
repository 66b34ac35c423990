"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees over shards.

Two fingerprints that differ in at most r bits agree on at least two of r + 2 blocks of
bits. Each distinct fingerprint goes to one shard per pair of blocks, keyed by the bits of
both, so every link lies within a shard. A shard of more than ``tree_size`` members is cut
by further bits: of r + 1 parts of its other bits, a link agrees on one. What is still
larger is cut into blocks. In a shard or block a BK-tree holds the fingerprints: children
are keyed by their integer Hamming distance to the parent, and a search follows only edges
within the radius. Each reports a spanning forest of its links, fewer rows than members.

Blocks of one shard are compared last and only as far as they are apart: members outside
the shard's largest component meet the trees of all its blocks, and report links between
different components only. So a large group of near copies, which its blocks connect,
costs rows in proportion to its members, and no tree, task or broadcast grows with the corpus.

``keep_one`` is the deduplication built on it: five-word shingles, and a link counts only
if the two texts' shingle sets have a Jaccard similarity of 0.8 or more. Fingerprints only
connect most copies early: at that similarity about ten of their bits differ, and a line
that is repeated often fixes them alone. The links are made complete by prefixes: two sets
that similar share a shingle among the first fifth (and one) of each, in any one order of
all shingles. The order puts common shingles last, so that few unlike texts meet. First
every text of a bucket meets the bucket's lead, then all that is still apart meets. Pairs
that meet are sieved by sketches, counts of the sets' shingles by hash, whose smaller
values add up to no less than what the sets share; only pairs that pass send their texts.

Defined cases: null and blank texts have fingerprint zero and link like any other; equal
texts share a fingerprint and so a component; rows that repeat a doc_id are kept; a null
doc_id is never a component's smallest id unless it is alone (then null); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import common
from spindrift.operators.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
TREE_SIZE = 1000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK_WORDS = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED):
    """The hashes of a text's shingles in blocks; none of a blank text."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, _BLOCK_WORDS):
        s, e = starts[at : min(n, at + _BLOCK_WORDS)].tolist(), last[at : at + _BLOCK_WORDS].tolist()
        yield np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(s, e)), "<u8", len(s))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _packed(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, seed):
        ones += _bit_sums(h)
        n += len(h)
    return _packed(ones, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in common.slices(batches):
            data, at = common.raw(common.texts(b.column(1)))
            view = memoryview(np.ascontiguousarray(data))
            at = at.tolist()
            fp = np.array([fingerprint(bytes(view[s:e]), shingle) for s, e in zip(at[:-1], at[1:])], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Unsigned integers by Hamming distance; a child's edge is its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d == 0:
                    return
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = len(self.values)
                    break
                at = nxt
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """All values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            kids = self.children[at]
            if len(kids) <= 2 * radius:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


class _Sets:
    """Disjoint sets: ``join`` tells whether two were apart."""

    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x, y) -> bool:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.root[a] = b
        return a != b


PIVOTS = 16
_FEW = 48


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among distinct unsigned fingerprints that connect what all links within ``radius`` do, fewer than there are values.

    In larger groups a few pivots are joined to all that is near them first; then only
    members outside the largest set ask the tree, since of any other link one end is there.
    """
    n, out = len(values), []
    group = np.arange(n)
    tried = np.zeros(n, bool)
    for _ in range(PIVOTS if n > _FEW else 0):
        apart = np.flatnonzero((group != np.bincount(group).argmax()) & ~tried)
        if not len(apart):
            break
        p = int(apart[0])
        tried[p] = True
        near = np.flatnonzero(np.bitwise_count(values ^ values[p]) <= radius)
        label, first = np.unique(group[near], return_index=True)
        out += [(int(values[p]), int(values[i])) for i in near[first[label != group[p]]]]
        group[np.isin(group, label)] = group[p]
    ask = np.flatnonzero(group != np.bincount(group).argmax()).tolist() if n > 1 else []
    return out + bridges(values.tolist(), group.tolist(), [int(values[i]) for i in ask], [int(group[i]) for i in ask], radius)


def bridges(tree_side: list[int], tree_sets: list, query_side: list[int], query_sets: list, radius: int) -> list[tuple[int, int]]:
    """Links between queries and members of a tree that join different sets, fewer than there are sets."""
    if not query_side:
        return []
    tree, of, sets, out = BKTree(), dict(zip(tree_side, tree_sets)), _Sets(), []
    for x in tree_side:
        tree.add(x)
    for x, own in zip(query_side, query_sets):
        for y in tree.within(x, radius):
            if sets.join(own, of[y]):
                out.append((x, y))
    return out


def _cuts(radius: int) -> list[tuple[int, int]]:
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    return list(zip(cuts[:-1], cuts[1:]))


def _width(radius: int) -> int:
    return max(hi - lo for lo, hi in _cuts(radius))


def _bits(fp, radius: int):
    return [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in _cuts(radius)]


def shard_keys(fp, radius: int):
    """One key for each pair of the radius + 2 blocks: pair number and the two blocks' bits."""
    part, width = _bits(fp, radius), _width(radius)
    return [F.lit(i << (2 * width)).cast("long") + F.shiftleft(part[a], width) + part[b] for i, (a, b) in enumerate(itertools.combinations(range(radius + 2), 2))]


def further_keys(fp, key, radius: int):
    """For a member of a shard, one key for each of radius + 1 parts of the bits that the shard does not fix: a link of the shard agrees on one of them."""
    cuts, part, width = _cuts(radius), _bits(fp, radius), _width(radius)
    rests = []
    for a, b in itertools.combinations(range(radius + 2), 2):
        rest = F.lit(0).cast("long")
        for i in range(radius + 2):
            if i not in (a, b):
                rest = F.shiftleft(rest, cuts[i][1] - cuts[i][0]) + part[i]
        rests.append(rest)
    rest = F.get(F.array(*rests), F.shiftright(key, 2 * width).cast("int"))
    free = 64 - 2 * (64 // (radius + 2))  # the most bits that two blocks leave
    ends = [free * i // (radius + 1) for i in range(radius + 2)]
    return [F.lit((i + 1) << 48) + F.shiftrightunsigned(rest, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:]))]


def _grouped(batches, keys: int):
    """The columns of each run of rows with equal first ``keys`` columns; batches are sorted by them, groups of bounded size."""
    kept = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        elif kept is None:
            return
        else:
            cols = kept
        if not len(cols[0]):
            continue
        edge = np.ones(len(cols[0]), bool)
        edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]])
        cut = np.flatnonzero(edge)
        done = len(edge) if b is None else int(cut[-1])  # the last group may go on in the next batch
        kept = None if b is None else [c[done:] for c in cols]
        if done:
            starts = cut[cut < done]
            yield [c[:done] for c in cols], starts, np.r_[starts[1:], done]


def _signed(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])


def _forests(groups: DataFrame, radius: int) -> DataFrame:
    """a, b: the forest of each group (key, sub, block) of fingerprints."""

    def run(batches):
        for (_, _, _, fp), starts, ends in _grouped(batches, 3):
            u = fp.view(np.uint64)
            two = starts[ends - starts == 2]
            near = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
            out = list(zip(u[near].tolist(), u[near + 1].tolist()))
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 2:
                    out += forest(u[s:e], radius)
            yield _signed(out)

    dealt = groups.select("key", "sub", "block", "fp").repartition("key", "sub", "block").sortWithinPartitions("key", "sub", "block", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _between(members: DataFrame, groups: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """a, b: links between different components (``groups``: node, component) of the blocks of one shard (``members``: key, sub, block, parts, fp)."""
    of = groups.select(F.col("node").alias("fp"), F.col("component").alias("of"))
    m = common.written(members.join(of, "fp", "left").withColumn("of", F.coalesce("of", "fp")), "shard-members")
    shard = ["key", "sub"]
    most = m.groupBy(*shard, "of").count().groupBy(*shard).agg(F.max(F.struct("count", "of")).alias("top"), F.sum("count").alias("all"))
    # queries that are many are dealt to several copies of each tree
    most = most.select(*shard, F.col("top.of").alias("top"), F.ceil((F.col("all") - F.col("top.count")) / (8 * tree_size)).cast("int").alias("deals")).where("deals > 0")
    m = m.join(most, shard)
    deal = F.pmod(F.xxhash64("fp"), F.col("deals")).cast("int")
    ask = m.where("of != top").select(*shard, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), deal.alias("deal"), F.lit(True).alias("query"), "fp", "of")
    tree = m.select(*shard, "block", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(False).alias("query"), "fp", "of")
    order = [*shard, "block", "deal"]
    dealt = tree.union(ask).repartition(*order).sortWithinPartitions(*order, "query", "fp")

    def run(batches):
        for (_, _, _, _, query, fp, of), starts, ends in _grouped(batches, 4):
            u, out = fp.view(np.uint64), []
            for s, e in zip(starts.tolist(), ends.tolist()):
                k = s + int((~query[s:e]).sum())
                out += bridges(u[s:k].tolist(), of[s:k].tolist(), u[k:e].tolist(), of[k:e].tolist(), radius)
            yield _signed(out)

    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect the same components as all links do."""
    keyed = nodes.select("fp", F.explode(F.array(*shard_keys(F.col("fp"), radius))).alias("key"))
    large = lambda d, *by: d.groupBy(*by).count().where(F.col("count") > tree_size)
    hot = common.written(large(keyed, "key"), "hot-shards")
    whole = lambda d: d.withColumn("sub", F.lit(0).cast("long")).withColumn("block", F.lit(0))
    if not hot.limit(1).count():
        return _forests(whole(keyed), radius)
    keyed = keyed.join(hot, "key", "left")
    cut = keyed.where("count is not null").select("fp", "key", F.explode(F.array(*further_keys(F.col("fp"), F.col("key"), radius))).alias("sub"))
    parts = common.written(large(cut, "key", "sub").select("key", "sub", F.ceil(F.col("count") / tree_size).cast("int").alias("parts")), "hot-parts")
    cut = cut.join(parts, ["key", "sub"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.lit(0)))
    names = ["key", "sub", "block", "fp"]
    found = common.written(_forests(whole(keyed.where("count is null")).select(*names).union(cut.select(*names)), radius), "forests")
    if not parts.limit(1).count():
        return found
    blocks = cut.where("parts is not null").select(*names, "parts")
    return found.union(_between(blocks, connected_components(found), radius, tree_size))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = common.written(fingerprints(docs, shingle), "simhash")
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    reps = connected_components(links(nodes, radius, tree_size))
    rep = nodes.join(reps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("rep"))
    least = rep.groupBy("rep").agg(F.min("first").alias("component_id"))
    of = common.written(rep.join(least, "rep").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


STAGE_SHINGLE = 5
STAGE_RADIUS = RADIUS
SIMILARITY = 0.8
SAMPLE = 16  # one text in so many at least is counted for the order of shingles, where there are more than SAMPLE_FROM
SAMPLE_FROM = 20_000
SAMPLED = 2_000_000
MOST_COMMON = 200_000


def shingle_set(text: bytes, shingle: int) -> set[bytes]:
    """Distinct shingles in the fingerprint's reading of words; a shorter text is one shingle, a blank one none."""
    words = text.translate(_LOWER).split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def similar(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar enough, as a, b; two blank texts are alike."""

    def run(batches):
        for b in common.slices(batches):
            keep, last, left = [], None, set()
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if x != last:
                    last, left = x, shingle_set((x or "").encode("utf-8", "replace"), shingle)
                right = shingle_set((y or "").encode("utf-8", "replace"), shingle)
                both = len(left & right)
                union = len(left) + len(right) - both
                keep.append(both >= similarity * union - 1e-12)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the distinct hashes begin with each of 64 or more bit patterns, about one a pattern; empty if a count does not fit a byte."""
    bits = min(16, max(6, int(len(hashes)).bit_length()))
    count = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def may_share(x: bytes, y: bytes) -> float:
    """No less than the number of hashes that two sets share, from their sketches."""
    if not x or not y:
        return float("inf")
    p, q = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
    while len(p) > len(q):
        p = p.reshape(-1, 2).sum(axis=1)
    while len(q) > len(p):
        q = q.reshape(-1, 2).sum(axis=1)
    return float(np.minimum(p, q).sum())


def _md5(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def common_shingles(docs: DataFrame, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the most common shingles of a sample of texts, and in how many they are. Any outcome gives a valid order."""

    def run(batches):
        seen: set = set()
        for b in common.slices(batches):
            out = [np.zeros(0, np.uint64)]
            for m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m not in seen:
                    seen.add(m)
                    out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes((t or "").encode("utf-8", "replace"), shingle)])))
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64))], ["h"])

    own = docs.select(_md5(F.col("text")).alias("md5"), "text")
    some = own.where(F.crc32("md5") % sample == 0).mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles, rare before common, of which a set this similar shares one."""
    n = len(hashes)
    size = min(n, n - int(np.ceil(similarity * n - 1e-9)) + 1)
    h, count = often
    if not len(h):
        return hashes[:size]
    i = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
    return hashes[np.lexsort((hashes, np.where(h[i] == hashes, count[i], 0)))[:size]]


_SEEN = 500_000


def read_texts(docs: DataFrame, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """md5, doc_id of every row; fp, n (distinct shingles), keys (their prefix) and sketch of a text where a task first meets it. One pass over the texts."""
    box = docs.sparkSession.sparkContext.broadcast(often)  # at most MOST_COMMON
    names = ["md5", "doc_id", "fp", "n", "keys", "sketch"]

    def run(batches):
        seen: set = set()
        for b in common.slices(batches):
            data, at = common.raw(common.texts(b.column(2)))
            view, at = memoryview(np.ascontiguousarray(data)), at.tolist()
            fp, n, keys, sketches, size = [], [], [], [], []
            for i, m in enumerate(b.column(0).to_pylist()):
                if m in seen:
                    for x in (fp, n, sketches):
                        x.append(None)
                    size.append(0)
                    continue
                seen.add(m)
                ones, total, own = np.zeros(64, np.int64), 0, [np.zeros(0, np.uint64)]
                for h in shingle_hashes(bytes(view[at[i] : at[i + 1]]), shingle):
                    ones += _bit_sums(h)
                    total += len(h)
                    own.append(np.unique(h))
                own = np.unique(np.concatenate(own)) if len(own) > 2 else own[-1]
                fp.append(_packed(ones, total))
                n.append(len(own))
                keys.append(prefix(own, box.value, similarity) if len(own) else np.zeros(1, np.uint64))  # blank texts share a key
                sketches.append(sketch(own))
                size.append(len(keys[-1]))
            if len(seen) > _SEEN:
                seen.clear()
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
            signed = [None if x is None else x - (1 << 64) if x >> 63 else x for x in fp]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(signed, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(sketches, pa.binary())], names)

    return docs.select(_md5(F.col("text")).alias("md5"), "doc_id", "text").mapInArrow(run, "md5 binary, doc_id long, fp long, n int, keys array<long>, sketch binary")


def buckets(read: DataFrame) -> DataFrame:
    """key, md5, n, pos of each text's prefix shingles that other texts share, with many (their texts), lead, lead_n and lead_pos of the bucket's lead.

    The lead has the shingle earliest in its prefix. Shingles of a large group are common and
    stand behind those that an edit makes, so the lead is the text that the others stem from,
    or the one that is least edited, and is similar to more of them than any other.
    """
    d = read.where("n is not null").select("md5", "n", F.posexplode("keys").alias("pos", "key"))
    d = d.withColumn("_last", F.lag("md5").over(Window.partitionBy("key").orderBy("md5"))).where("_last is null or _last != md5").drop("_last")
    own = Window.partitionBy("key")
    d = d.withColumn("_many", F.count(F.lit(1)).over(own)).withColumn("_lead", F.min(F.struct("pos", "md5", "n")).over(own)).where("_many > 1")
    return d.select("key", "md5", "n", "pos", F.col("_many").alias("many"), F.col("_lead.md5").alias("lead"), F.col("_lead.n").alias("lead_n"), F.col("_lead.pos").alias("lead_pos"))


def _fits(n, pos, m, at, similarity: float):
    """Two sets of n and m shingles can be similar enough if the shingles at pos and at are the first they share."""
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (F.least(n - pos, m - at) >= similarity / (1 + similarity) * (n + m) - 1e-6)


def _by_fingerprint(texts: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """a, b: pairs of different texts that fingerprints bring together; equal fingerprints by their lead only."""
    nodes = common.written(texts.groupBy("fp").agg(F.min("md5").alias("lead"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    lead = nodes.select("fp", "lead")
    same = texts.select("md5", "fp").join(nodes.where("n > 1").select("fp", "lead"), "fp").where(F.col("md5") != F.col("lead")).select(F.col("lead").alias("a"), F.col("md5").alias("b"))
    near = links(nodes.select("fp"), radius, tree_size).distinct()
    near = near.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("la")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("lb")), "b")
    return same.union(near.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")))


def _by_lead(shared: DataFrame, similarity: float) -> DataFrame:
    fits = _fits(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), similarity)
    return shared.where((F.col("md5") != F.col("lead")) & fits).select(F.col("lead").alias("a"), F.col("md5").alias("b"))


def _by_all(shared: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All pairs of buckets, but for those with the lead, that ``groups`` does not connect: one side is always outside the lead's group, so a large group does not meet itself."""
    shared = shared.where((F.col("many") > 2) & (F.col("md5") != F.col("lead"))).select("key", "md5", "n", "pos", "lead")
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    d = shared.join(of("md5"), "md5", "left").join(of("lead"), "lead", "left")
    d = d.select("key", "md5", "n", "pos", F.coalesce("of_md5", "md5").alias("of"), F.coalesce("of_lead", "lead").alias("of_lead"))
    d = common.written(d, "bucket-groups")
    x = d.where("of != of_lead").select("key", F.col("md5").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("of").alias("ox"))
    y = d.select(F.col("key").alias("ky"), F.col("md5").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("of").alias("oy"))
    on = (F.col("key") == F.col("ky")) & (F.col("ox") != F.col("oy")) & _fits(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), similarity)
    return x.join(y, on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


MOST_BITS = 27


def _among(asked: DataFrame):
    """A test of md5 columns: false means not in ``asked`` (column md5), true that it may be.

    It reads a bit map of 16 MB at most, which keeps most rows that are not asked for out of a
    shuffle of texts; where the map is full it only keeps fewer out.
    """
    spark = asked.sparkSession
    bits = min(MOST_BITS, max(12, (16 * asked.count()).bit_length()))

    def words(batches):
        for b in batches:
            for at in _positions(b.column(0), bits):
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    got = asked.select("md5").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    box = spark.sparkContext.broadcast(table)  # 2 ** MOST_BITS bits at most

    def may(md5: pa.Array) -> pa.Array:
        keep = np.ones(len(md5), bool)
        for at in _positions(md5, bits):
            keep &= (box.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(keep)

    return F.arrow_udf(may, "boolean")


def _asked(df: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``df`` whose md5 is asked for (``asked``: distinct md5)."""
    return df.where(_among(asked)("md5")).join(asked, "md5", "left_semi")


def _positions(md5: pa.Array, bits: int):
    """Two bit numbers of each digest."""
    data = np.frombuffer(b"".join(md5.to_pylist()), np.int64).reshape(-1, 2) & ((1 << bits) - 1)
    return data[:, 0], data[:, 1]


def _sieved(pairs: DataFrame, read: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches leave room for the similarity."""
    asked = common.written(pairs.select(F.explode(F.array("a", "b")).alias("md5")).distinct(), "asked")
    known = _asked(read.where("n is not null").select("md5", "n", "sketch"), asked).dropDuplicates(["md5"])
    side = lambda c: known.select(F.col("md5").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for b in common.slices(batches):
            n, m, x, y = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = []
            for i in range(b.num_rows):
                both = min(may_share(x[i], y[i]), n[i], m[i])
                keep.append(both >= similarity * (n[i] + m[i] - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a binary, b binary")


def near_duplicate_texts(docs: DataFrame, shingle: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, similarity: float = SIMILARITY, tree_size: int = TREE_SIZE):
    """Texts by MD5: (distinct texts with their smallest doc_id and row count, components of the similar ones)."""
    spark = docs.sparkSession
    rows = docs.count()
    often = common_shingles(docs, shingle, max(SAMPLE, rows // SAMPLED) if rows > SAMPLE_FROM else 1)
    read = common.written(read_texts(docs, shingle, similarity, often), "near-read")
    texts = common.written(read.groupBy("md5").agg(F.min("doc_id").alias("keep_id"), F.max("fp").alias("fp"), F.count(F.lit(1)).alias("rows")), "texts")
    own = docs.select(_md5(F.col("text")).alias("md5"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    repeats = texts.where("rows > 1").limit(1).count()

    def verify(pairs: DataFrame) -> DataFrame:
        # only texts that are in a pair travel, one row each
        asked = common.written(pairs.select(F.explode(F.array("a", "b")).alias("md5")).distinct(), "asked")
        firsts = texts.join(asked, "md5", "left_semi").select(F.col("md5").alias("_md5"), "keep_id")
        stored = body = common.written(_asked(own, asked).join(firsts, (F.col("md5") == F.col("_md5")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("md5", "text"), "near-texts")
        if repeats:
            body = body.groupBy("md5").agg(F.first("text").alias("text"))
        full = pairs.join(body.select(F.col("md5").alias("b"), F.col("text").alias("text_b")), "b").join(body.select(F.col("md5").alias("a"), F.col("text").alias("text_a")), "a")
        found = common.written(similar(full, shingle, similarity), "links")
        common.forget(spark, stored)
        return found

    shared = common.written(buckets(read), "buckets")
    met = common.written(_by_fingerprint(texts, radius, tree_size).union(_by_lead(shared, similarity)).distinct(), "near-pairs")
    verified = verify(common.written(_sieved(met, read, similarity), "near-pairs"))
    groups = common.written(connected_components(verified), "near-groups")
    rest = common.written(_by_all(shared, groups, similarity).distinct().join(met, ["a", "b"], "left_anti"), "near-pairs")
    rest = common.written(_sieved(rest, read, similarity), "near-pairs")
    if rest.limit(1).count():
        groups = common.written(connected_components(verified.union(verify(rest))), "near-groups")
    common.forget(spark, shared)
    common.forget(spark, read)
    return texts, groups


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, similarity: float = SIMILARITY, tree_size: int = TREE_SIZE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays (a null id counts as largest)."""
    texts, groups = near_duplicate_texts(docs, shingle, radius, similarity, tree_size)
    member = texts.join(groups.withColumnRenamed("node", "md5"), "md5").select("md5", "keep_id", "component")
    order = F.struct(F.col("keep_id").isNull().alias("null"), "keep_id", "md5")
    best = member.groupBy("component").agg(F.min(order).alias("best")).select("component", F.col("best.md5").alias("best"))
    verdict = texts.join(member.join(best, "component").select("md5", "best"), "md5", "left").where("rows > 1 or best is not null")
    own, md5, keep, chosen = (common.unused(docs, c) for c in ("own", "md5", "keep", "chosen"))
    verdict = common.written(verdict.select("md5", "keep_id", (F.coalesce("best", "md5") == F.col("md5")).alias("chosen")), "verdict")
    maybe = common.unused(docs, "maybe")
    d = docs.withColumn(own, _md5(F.col("text"))).withColumn(maybe, _among(verdict)(own))
    # only rows that may have a verdict are shuffled
    judged = d.where(maybe).join(verdict.toDF(md5, keep, chosen), F.col(own) == F.col(md5), "left")
    judged = judged.where(F.col(md5).isNull() | (F.col(chosen) & F.col("doc_id").eqNullSafe(F.col(keep))))
    d = d.where(~F.col(maybe)).select(*docs.columns, own).unionByName(judged.select(*docs.columns, own))
    repeated = docs.select("doc_id", _md5(F.col("text")).alias("m")).groupBy("doc_id", "m").count().where("count > 1")
    if repeated.limit(1).count():
        d = d.dropDuplicates(["doc_id", own])
    return d.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
