"""Main text of web pages by consensus host paths.

1. Every page's containers are scored: a container's generalised tag-class path (digits in
   class names left out) gets the share of the page's content below it. Content is text
   outside links and outside what is noise by its markup.
2. Shares are summed per host and path in Spark. A host's winning path is its deepest
   ``article`` or ``main`` path that covers at least MAIN_COVER of its pages' content on
   average, else its deepest path of any kind that covers COVER.
   Paths that at least half of the host's pages have are known.
3. Pages are read again and the text below the winning path is taken, if it and the known
   parts beside it cover enough of this page. A page of another shape votes for itself.

Noise: menus, headers, footers, sidebars, dialogs and controls by their tags; hidden
elements; forms and elements whose class, id or role is or ends in a word of _NOISE; lists
of links outside the article. A name marks a part and never the page: a form or named
element that holds the article, a main heading, or half of the page in several blocks is a
wrapper and counts as none.

Text: character references decoded once, white space inside a block (Python's str.split)
as one space, blocks in page order joined by one space.

A path is a 64-bit hash of its parent's path and its own label, so that deep markup costs
memory in proportion to its size.

Defined cases: null html is an empty page with empty text; a null url, or one without a
host, belongs to the empty host; broken and unclosed markup is read as far as it goes;
repeated rows are pages of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common

COVER = 0.85
MAIN_COVER = 0.5
SALTS = 16  # rows of the paths' table for each host, so that a large host is no single key

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\">]*\"|'[^'>]*'|[\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_CONTAINERS = frozenset("html body div section article main header footer nav aside form ul ol dl table blockquote fieldset menu dialog details".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIPPED = frozenset("header footer nav aside menu dialog button select option head title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LISTS = frozenset("ul ol dl table div section".split())
_WHOLE = frozenset("html body article main".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side menu menus nav navbar navigation navigations breadcrumb breadcrumbs comment comments commentlist respond disqus reply replies share sharing social related recommended "
    "newsletter subscribe signup login widget widgets footer header masthead toolbar pagination pager skip search complementary contentinfo "
    "adslot adbox werbung anzeige anzeigen publicidad publicite anuncio anuncios kommentare commentaires comentarios".split()
)
#: What may follow a leading word of _NOISE where the name still means the part as such.
_PLACES = frozenset(
    "left right top bottom main primary secondary inner outer list item items bar box block area section panel slot unit frame holder link links button buttons icon icons "
    "form field input row col column grid card cards group set wrap text title label message msg info inline fixed sticky first last small large mobile desktop "
    "posts articles stories media post article page site global local overlay close open toggle id".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A name with one of these says what lies beside or within, not what the element is.
_ABOUT = frozenset("has with no without page layout body wrapper container content".split())

_PART, _GONE = 1, 2


STRONG, WEAK = 2, 1


def named_noise(value: str) -> int:
    """STRONG if one of the names is a word of _NOISE, ends with one, or begins with one that only words of place follow; WEAK if one merely begins with such a word, as names of articles may; else 0."""
    said = 0
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and (words[-1] in _NOISE or words[0] in _NOISE) and _ABOUT.isdisjoint(words):
            said = max(said, STRONG if words[-1] in _NOISE or _PLACES.issuperset(words[1:]) else WEAK)
    return said


class Page:
    """One pass over a page: blocks of text with the elements they lie in, then what is noise and what is content."""

    def __init__(self, source: str):
        self.parent: list[int] = []  # of the elements that matter, in page order
        self.path: list[int] = []
        self.label: list[str] = []
        self.depth: list[int] = []
        self.named: list[int] = []  # STRONG for a form, or what the element's names say
        self.heads: list[bool] = []  # article, main, or one with a main heading below
        self.links: list[int] = []
        self.pieces: list[tuple[int, int, str, bool]] = []  # block, element, text, in a link
        self._read(source)
        self._weigh()

    def _element(self, parent: int, tag: str, label: str, named: int) -> int:
        from xxhash import xxh64_intdigest

        up = self.path[parent] if parent >= 0 else 0
        self.parent.append(parent)
        self.label.append(label)
        self.path.append(xxh64_intdigest(label.encode("utf-8", "replace"), up & 0xFFFFFFFFFFFFFFFF) >> 1 or 1)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 1)
        self.named.append(named)
        self.heads.append(tag in ("article", "main"))
        self.links.append(0)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, element, gone
        at, gone, here, block, link = 0, 0, -1, 0, False
        open_at: dict[str, list[int]] = {}  # tag to its places on the stack, so that a stray end tag costs nothing

        def close(i: int) -> None:
            nonlocal gone, here
            while len(stack) > i:
                tag, _, g = stack.pop()
                open_at[tag].pop()
                gone -= g
            here = stack[-1][1] if stack else -1

        for m in _TOKEN.finditer(source):
            if not gone and m.start() > at:
                self.pieces.append((block, here, source[at : m.start()], link))
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            if m[2]:
                link &= tag != "a"
                if tag not in _INLINE:
                    block += 1
                if open_at.get(tag):
                    close(open_at[tag][-1])
                continue
            if tag == "a":
                link = True
                if here >= 0:
                    self.links[here] += 1
            names, role, kind = "", 0, _GONE if tag in _SKIPPED else 0
            if m[4] and not m[4].isspace():
                for k, a, b, c in _ATTRIBUTE.findall(m[4]):
                    k, v = k.lower(), a or b or c
                    if k == "class":
                        names = ".".join(sorted({re.sub(r"\d+", "", x) for x in v.split()} - {""}))
                    if tag in _WHOLE:
                        continue
                    if k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
                        kind = _GONE
                    elif k in ("class", "id", "role"):
                        role = max(role, named_noise(v))
            role = STRONG if tag == "form" else role
            if not kind and role:
                kind = _PART
            if tag not in _INLINE:
                block += 1
                link &= tag in _VOID
                if stack and stack[-1][0] == "p" and tag not in _VOID:
                    close(len(stack) - 1)  # a paragraph ends where the next block begins
                if tag == "h1":
                    for e in self._up(here):
                        if self.heads[e]:
                            break
                        self.heads[e] = True
            if tag in _VOID or not (kind or tag in _CONTAINERS) or m[4].rstrip().endswith("/"):
                continue
            if kind != _GONE and not gone:
                here = self._element(here, tag, f"{tag}.{names}" if names else tag, role * (kind == _PART))
            gone += kind == _GONE
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, here, kind == _GONE))
        if not gone and at < len(source):
            self.pieces.append((block, here, source[at:], link))

    def _up(self, e: int):
        while e >= 0:
            yield e
            e = self.parent[e]

    def _weigh(self) -> None:
        n = len(self.parent)
        text, linked, links, blocks, head = [0] * n, [0] * n, self.links[:], [0] * n, self.heads
        size = [len(t.strip()) for _, _, t, _ in self.pieces]
        last = [-1] * n
        for (b, e, _, link), k in zip(self.pieces, size):
            if e >= 0 and k:
                text[e] += k
                linked[e] += k * link
                blocks[e] += last[e] != b
                last[e] = b
        for e in range(n - 1, -1, -1):
            p = self.parent[e]
            if p >= 0:
                text[p] += text[e]
                linked[p] += linked[e]
                links[p] += links[e]
                blocks[p] += blocks[e]
                head[p] |= head[e]
        everything = sum(size)
        noise, inside = [False] * n, [False] * n  # inside: of an article
        for e in range(n):
            p = self.parent[e]
            tag = self.label[e].partition(".")[0]
            inside[e] = tag in ("article", "main") or (p >= 0 and inside[p])
            part = self.named[e] > 0 and not head[e] and not (2 * text[e] >= everything and blocks[e] >= 3)
            part &= self.named[e] == STRONG or 5 * (text[e] - linked[e]) < everything  # a name that says little marks little
            part |= tag in _LISTS and not inside[e] and links[e] >= 3 and 10 * linked[e] >= 8 * text[e] > 0 and not head[e]
            noise[e] = part or (p >= 0 and noise[p])
        self.noise = noise
        self.own = [0] * n
        self.total = 0
        for (_, e, _, link), k in zip(self.pieces, size):
            if not link and (e < 0 or not noise[e]):
                self.total += k
                if e >= 0:
                    self.own[e] += k
        self.content = self.own[:]
        for e in range(n - 1, -1, -1):
            if self.parent[e] >= 0:
                self.content[self.parent[e]] += self.content[e]

    def shares(self) -> dict[int, tuple[int, bool, float]]:
        """Path to its depth, whether it is an article or main element, and the share of content below any container of that path. Path 0 is the page."""
        out = {0: (0, False, 1.0)}
        if self.total:
            for e, c in enumerate(self.content):
                if c and not self.noise[e]:
                    _, _, share = out.get(self.path[e], (0, False, 0.0))
                    out[self.path[e]] = (self.depth[e], self.label[e].partition(".")[0] in ("article", "main"), share + c / self.total)
        return out

    def own_path(self, cover: float = COVER, main: float = MAIN_COVER) -> int:
        """The page's winning path if it alone votes."""
        return max((is_main, depth, round(share, 6), path) for path, (depth, is_main, share) in self.shares().items() if share >= (main if is_main else cover))[3]

    def best_path(self, path: int, known=(), cover: float = COVER, main: float = MAIN_COVER) -> int:
        """``path`` if it and the ``known`` paths beside it cover enough of this page, else the page's own."""
        n, is_main, known = len(self.parent), False, frozenset(known)
        above, good = [False] * n, [False] * n
        for e in range(n - 1, -1, -1):
            if (above[e] or self.path[e] == path) and self.parent[e] >= 0:
                above[self.parent[e]] = True
        covered, has = 0, False
        for e in range(n):
            p = self.parent[e]
            if self.path[e] == path:
                has, is_main = True, self.label[e].partition(".")[0] in ("article", "main")
            good[e] = self.path[e] == path or (p >= 0 and good[p]) or (self.path[e] in known and not above[e])
            covered += self.own[e] * good[e]
        if path and has and covered >= (main if is_main else cover) * self.total:
            return path
        return self.own_path(cover, main)

    def text(self, path: int) -> str:
        """All blocks below containers of ``path`` that are no noise."""
        n = len(self.parent)
        inside = [False] * n
        for e in range(n):
            p = self.parent[e]
            inside[e] = self.path[e] == path or (p >= 0 and inside[p])
        out, parts, last = [], [], -1
        for b, e, t, _ in [*self.pieces, (-2, -1, "", False)]:
            if b != last:
                words = " ".join(html_lib.unescape("".join(parts)).split())
                if words:
                    out.append(words)
                parts, last = [], b
            if (e < 0 and not path) or (e >= 0 and not self.noise[e] and (not path or inside[e])):
                parts.append(t)
        return " ".join(out)

    def written_path(self, path: int, most: int = 100) -> str:
        """The labels of a path, the innermost ``most`` of them."""
        e = self.path.index(path) if path in self.path else -1
        labels = [self.label[x] for x, _ in zip(self._up(e), range(most))]
        return ">".join(reversed(labels))


def host(url: Column) -> Column:
    """Lower-case host of an address without user, port and leading www; empty if there is none."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """host, path, depth, main, share, pages: summed within each task before anything is sent."""

    def run(batches):
        kept: dict[tuple[str, int], list] = {}

        def out():
            keys, rows = list(kept), list(kept.values())
            kept.clear()
            kinds = [pa.int32(), pa.bool_(), pa.float64(), pa.int64()]
            return pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["host", "path", "depth", "main", "share", "pages"]
            )

        for b in common.slices(batches):
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for path, (depth, main, share) in Page(source or "").shares().items():
                    row = kept.setdefault((h, path), [depth, main, 0.0, 0])
                    row[2] += share
                    row[3] += 1
                if len(kept) > 50_000:
                    yield out()
        yield out()

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, depth int, main boolean, share double, pages long")


def winning_paths(pages: DataFrame, cover: float = COVER, main: float = MAIN_COVER) -> DataFrame:
    """host, path, known: of the host's paths that cover enough of its content, article and main before others, the deepest; and those that half of its pages have."""
    v = votes(pages).groupBy("host", "path", "depth", "main").agg(F.sum("share").alias("share"), F.sum("pages").alias("pages"))
    v = common.written(v, "votes")  # read twice below
    size = v.where("depth = 0").select("host", F.col("pages").alias("all"))  # path 0 has a vote of every page
    need = F.when(F.col("main"), F.lit(main)).otherwise(F.lit(cover))
    good = v.join(size, "host").where(F.col("share") >= need * F.col("all") - 1e-9)
    best = good.groupBy("host").agg(F.max(F.struct("main", "depth", F.round("share", 6).alias("share"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))
    known = v.join(size, "host").where("depth > 0 and 2 * pages >= all").groupBy("host").agg(F.collect_set("path").alias("known"))  # at most twice as many as a page has
    return best.join(known, "host", "left")


def extract(pages: DataFrame, cover: float = COVER, main: float = MAIN_COVER, salts: int = SALTS) -> DataFrame:
    """page_id, url, text, n_chars, text_path of every page."""
    best = common.written(winning_paths(pages, cover, main), "host-paths")
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    d = d.join(best, ["host", "salt"], "left")

    def run(batches):
        for b in common.slices(batches):
            text, paths = [], []
            for source, path, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                page = Page(source or "")
                own = page.best_path(path or 0, known or (), cover, main)
                text.append(page.text(own))
                paths.append(page.written_path(own))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "text_path"])

    return d.select("page_id", "url", "html", "path", "known").mapInArrow(run, "page_id long, url string, text string, n_chars long, text_path string")


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_consensus": op3_html_consensus}
ORACLE_SQL: dict[str, str] = {}
