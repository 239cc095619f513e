"""HTML extraction by equivalence classes of template tokens.

A token is a tag in its place (the path of elements above it, with their classes) or a run of
text in its place.  Over the pages of one host every token has an occurrence vector: how often
it occurs in each page.  Tokens with equal vectors that occur in enough pages form a class; a
class is valid on a page where its tokens stand in the class's order, and valid classes nest
into the host's template.  What stands between template tokens are slots.

The template decides three things.  A text that is itself a template token is boilerplate.  The
main box is the innermost template box that holds more than half of the host's text; the article
is the whole ``article`` (or other marked) element around it, with all elements in the same
place, or, where none is, the page's text.  Furniture is a template box outside or inside the
article, but not around the main box, most of whose text on the host is links, or whose class or
id is made up of usual names for menus, adverts, notices and comments.  A name alone takes
nothing out: the box must be part of the template.

Vectors are never gathered: a token's vector is the exclusive or, over pages, of a hash of page
and count, which adds up before the shuffle.  So a host with a third of all pages costs a row for
each token and task.  Pages of a host with the same longest text count once, so copies don't make
a template.

A host of fewer than ``SUPPORT`` different pages has no template.  There, as on a page that lacks
the host's main box, the marked elements are the article, or all text where none is marked, and
boxes with such names are furniture.  On every page the elements that by their kind hold no
article text (menus, footers, forms, scripts, ...) are left out.

Defined results: null html, or a page without article text, gives the empty string.  A page
without a host belongs to the host ''.  Very long pages and texts are parsed whole.  Ties: of
equally large main boxes the later one in the page is taken.  Repeated rows give repeated rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Different pages of a host in which a class must occur, at least, and as a share of the host's.
SUPPORT, SHARE = 6, 0.6
#: Tokens that make a class.
SIZE = 2
#: Rows of templates that may be broadcast.
BROADCAST_ROWS = 200_000

#: Share of a host's text that the main box holds, and share of links in a box of links.
MAIN_SHARE, LINK_SHARE = 0.5, 0.5

# Elements of HTML by their part in a page, and usual class names.
RAW = frozenset("script style noscript template iframe svg textarea select button object canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br ruby rb rt rp "
    "math mi mo mn ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom semantics annotation".split()
)
AWAY = frozenset("head nav footer aside form menu dialog fieldset header".split())
CONTAINERS = frozenset("div section td article main body ul ol table".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related recommended "
    "share sharing social comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "widget toolbar pagination pager skip hidden copyright responses discussion feedback announcement disclaimer adslot adbox adunit sponsors teaser teasers trending".split()
)
#: What such a name may be joined with.
NEUTRAL = frozenset("list box bar buttons button wrapper container section area block links link inner outer left right top bottom wide slot unit group items item site page the js main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MAIN_NAMES = frozenset("content article post entry story articlebody main text".split())
REOPENS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

#: A quote opens a value only behind an equals sign; nothing is tried twice.
PART = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?][^>]*+>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
KEYS = frozenset("class id role hidden aria-hidden itemprop style".split())
#: The end of each raw element; what stands before it isn't markup.
END = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I) for tag in RAW}
NAME, DIGITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"\d+")


def furniture_name(value: str) -> bool:
    """Whether one of the names in a class or id says furniture, and nothing else."""
    for token in value.split():
        words = {w.lower() for w in NAME.findall(token)}
        if words & NAMES and words <= NAMES | NEUTRAL:
            return True
    return False


class Box:
    __slots__ = ("parent", "h", "main", "named", "chars", "links")

    def __init__(self, parent: int, h: int, main: int, named: bool):
        self.parent, self.h, self.main, self.named, self.chars, self.links = parent, h, main, named, 0, 0


class Page:
    """One pass over a page: its tokens, and its blocks of text with the boxes they stand in."""

    def __init__(self, html: str):
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, int, int]] = []  # text, place among the tokens, innermost box; only what may be article
        self.boxes: list[Box] = [Box(-1, 0, 0, False)]
        self._hash: dict[str, int] = {}
        self._parse(html)

    def _token(self, s: str) -> int:
        h = self._hash.get(s)
        if h is None:
            h = self._hash[s] = xxhash.xxh64_intdigest(s) - (1 << 63)
        return h

    def _flush(self, text: list[str], path: str, away: bool, box: int) -> None:
        s = " ".join(unescape("".join(text)).split())
        text.clear()
        links, self._links = self._links, 0
        if s:
            if not away:
                self.blocks.append((s, len(self.tokens), box))
                for k in self._above(box):
                    self.boxes[k].chars += len(s)
                    self.boxes[k].links += min(links, len(s))
            self.tokens.append(self._token(path + "\0" + s))

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, str, bool, int]] = []  # tag, path before, left out before, box before
        path, away, box, text, at = "", False, 0, [], 0
        last, anchor, self._links = html.rfind(">"), False, 0
        while at < len(html):
            m = PART.match(html, at) if at <= last else None  # behind the last > no tag ends any more
            s = m[0] if m else html[at:].partition("<!--")[0]
            at = m.end() if m else len(html)
            if m is None or m[2] is None:
                if s[:1] != "<" or s == "<":
                    text.append(s)
                    self._links += len(s) * anchor
                continue
            tag = m[2].lower()
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    anchor = not m[1]
                continue
            self._flush(text, path, away, box)
            anchor = False
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        _, path, away, box = stack[k]
                        del stack[k:]
                        break
                self.tokens.append(self._token(path + "/" + tag + ">"))
                continue
            rest = m[3]
            if tag in VOID or tag in RAW:
                self.tokens.append(self._token(path + "<" + tag))
                if tag in RAW and not rest.endswith("/"):
                    end = END[tag].search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in REOPENS and stack and stack[-1][0] in REOPENS[tag]:
                _, path, away, box = stack.pop()
            stack.append((tag, path, away, box))
            names, main, named = "", 0, False
            inside = any(self.boxes[b].main >= 2 for b in self._above(box))
            if rest and not rest.isspace():
                names, away, main, named = self._attributes(rest, away)
            if tag in AWAY and not (tag == "header" and inside):
                away = True
            if tag == "article":
                main = 3
            elif tag == "main":
                main = max(main, 2)
            path = f"{path}/{tag}{names}"
            self.tokens.append(self._token(path))
            if tag in CONTAINERS or named or main:
                self.boxes.append(Box(box, self.tokens[-1], main, named))
                box = len(self.boxes) - 1
        self._flush(text, path, away, box)

    def _above(self, box: int) -> Iterator[int]:
        while box >= 0:
            yield box
            box = self.boxes[box].parent

    def _attributes(self, rest: str, away: bool) -> tuple[str, bool, int, bool]:
        names, main, named = "", 0, False
        for a in ATTRIBUTE.finditer(rest):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key not in KEYS:
                continue
            if key in ("class", "id"):
                names += "." + DIGITS.sub("0", value.split(" ")[0]) if key == "class" else ""
                if furniture_name(value):
                    named = True
                elif {w.lower() for w in NAME.findall(value)} & MAIN_NAMES:
                    main = max(main, 1)
            elif key == "role":
                away = away or value.lower() in ROLES
                main = max(main, 2 * (value.lower() == "main"))
            elif key == "itemprop":
                main = max(main, 3 * (value.lower() == "articlebody"))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                away = True
        return names, away, main, named


PARSED = (
    "key long, page_id long, url string, host string, same long, tokens array<struct<h:bigint,n:int,at:int,chars:bigint,links:bigint>>, "
    "blocks array<struct<text:string,h:bigint,box:int>>, boxes array<struct<parent:int,h:bigint,main:int,named:boolean>>"
)
_TOKEN = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("chars", pa.int64()), ("links", pa.int64())])
_BLOCK = pa.struct([("text", pa.string()), ("h", pa.int64()), ("box", pa.int32())])
_BOX = pa.struct([("parent", pa.int32()), ("h", pa.int64()), ("main", pa.int32()), ("named", pa.bool_())])


def parse(pages: DataFrame) -> DataFrame:
    """A row for each page: its host, its tokens with counts, its texts that may be article, and their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                b = whole.slice(k, 128)
                ids, urls, keys, same, tokens, blocks, boxes, hosts = b.column("page_id"), b.column("url"), [], [], [], [], [], []
                for url, html in zip(urls.to_pylist(), b.column("html").to_pylist()):
                    page = Page(html or "")
                    hosts.append(host_of(url))
                    same.append(xxhash.xxh64_intdigest(max((x for x, _, _ in page.blocks), key=len, default=html or "")) - (1 << 63))
                    keys.append(key := key + 1)
                    kinds, first, count = np.unique(np.array(page.tokens, np.int64), return_index=True, return_counts=True)
                    held = np.zeros((2, len(kinds)), np.int64)
                    for x in page.boxes[1:]:
                        held[:, np.searchsorted(kinds, x.h)] += x.chars, x.links
                    tokens.append((kinds, count, first, *held))
                    blocks.append([(x, page.tokens[at], box) for x, at, box in page.blocks])
                    boxes.append([(x.parent, x.h, x.main, x.named) for x in page.boxes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), ids, urls, pa.array(hosts, pa.string()), pa.array(same, pa.int64()), _lists(tokens, _TOKEN), _rows(blocks, _BLOCK), _rows(boxes, _BOX)],
                    names=["key", "page_id", "url", "host", "same", "tokens", "blocks", "boxes"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, PARSED)


def _lists(rows: list[tuple], kind: pa.StructType) -> pa.Array:
    """Lists of structs from the columns of each row."""
    at = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
    cols = [pa.array(np.concatenate([r[j] for r in rows])).cast(kind.field(j).type) for j in range(kind.num_fields)]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(cols, fields=list(kind)))


def _rows(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of structs from the structs of each row."""
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    cols = [pa.array([x[j] for r in rows for x in r], kind.field(j).type) for j in range(kind.num_fields)]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(cols, fields=list(kind)))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def templates(parsed: DataFrame) -> DataFrame:
    """Per host: the tokens of its classes, with their place and the text in them; one row for each class and token."""
    first = parsed.groupBy("host", "same").agg(F.min("key").alias("key"))
    pages = first.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT)
    vector = (
        parsed.select("host", "key", "tokens").join(first.select("key"), "key", "left_semi").select("host", "key", F.inline("tokens"))
        .groupBy("host", "h").agg(F.count("*").alias("seen"), F.bit_xor(F.xxhash64("key", "n")).alias("vector"), F.avg("at").alias("place"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    )
    often = vector.join(pages, "host").where((F.col("seen") >= SUPPORT) & (F.col("seen") >= SHARE * F.col("pages")))
    classes = often.groupBy("host", "vector", "seen").agg(F.count("*").alias("size"), F.min("h").alias("class")).where(F.col("size") >= SIZE)
    return often.join(classes, ["host", "vector", "seen"]).select("host", "class", "h", "place", "chars", "links")


class Template:
    """The classes of a host, largest first, its main box and its boxes of links."""

    def __init__(self, rows: list[dict]):
        classes: dict[int, list[tuple[float, int]]] = {}
        for r in rows:
            classes.setdefault(r["class"], []).append((r["place"], r["h"]))
        self.classes = [[h for _, h in sorted(c)] for c in sorted(classes.values(), key=lambda c: (-len(c), c))]
        most = max((r["chars"] for r in rows), default=0)
        large = [r for r in rows if r["chars"] > MAIN_SHARE * most]
        self.main = min(large, key=lambda r: (r["chars"], -r["place"]))["h"] if large else None
        self.links = {r["h"] for r in rows if r["links"] > LINK_SHARE * r["chars"]}

    def found(self, at: dict[int, tuple[int, int]]) -> set[int]:
        """Tokens of a page that belong to valid classes; ``at`` has each token's first place and count.

        A class is valid on the page if all its tokens are there, as often as each other, in the
        class's order, and if its span doesn't cross that of a larger class.
        """
        spans, out = [], set()
        for members in self.classes:
            order = [at.get(h) for h in members]
            if None in order or len({n for _, n in order}) > 1:
                continue
            places = [p for p, _ in order]
            if any(x >= y for x, y in zip(places, places[1:])):
                continue
            lo, hi = places[0], places[-1]
            if order[0][1] == 1 and any(a < lo < b < hi or lo < a < hi < b for a, b in spans):
                continue
            spans.append((lo, hi))
            out.update(members)
        return out


def article(blocks: list[dict], boxes: list[dict], found: set[int], template: Template | None) -> list[str]:
    """The texts of a page that stand in its article's slots."""
    above = []
    for k, x in enumerate(boxes):
        above.append({k} | (above[x["parent"]] if x["parent"] >= 0 else set()))
    full = set().union(*(above[x["box"]] for x in blocks)) if blocks else set()
    middle = {k for k in full if template and template.main in found and boxes[k]["h"] == template.main}
    if middle:
        around = {max(near, key=lambda j: boxes[j]["main"]) for k in middle if (near := [j for j in above[k] if boxes[j]["main"] >= 2])}
        places = {boxes[j]["h"] for j in around}
        region = {k for k in full if boxes[k]["h"] in places} or full
        gone = {k for k in full if boxes[k]["h"] in found and (boxes[k]["named"] or boxes[k]["h"] in template.links)}
    else:
        middle = {k for k in full if boxes[k]["main"] >= 2}
        best = max((boxes[k]["main"] for k in full), default=0)
        region = {k for k in full if boxes[k]["main"] == best} if best else full
        gone = {k for k in full if boxes[k]["named"]}
    gone -= set().union(*(above[k] for k in middle)) if middle else set()
    return [x["text"] for x in blocks if x["h"] not in found and not region.isdisjoint(above[x["box"]]) and gone.isdisjoint(above[x["box"]])]


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars, host, n_slots."""
    ws = common.Workspace(pages.sparkSession, "html")
    parsed = ws.save(parse(pages), "parsed")
    rows = ws.save(templates(parsed), "templates")
    n = rows.count()
    template = rows.groupBy("host").agg(F.collect_list(F.struct("class", "h", "place", "chars", "links")).alias("template"))
    joined = parsed.join(F.broadcast(template) if n <= BROADCAST_ROWS else template, "host", "left").select("page_id", "url", "host", "tokens", "blocks", "boxes", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts, slots = [], []
                hosts, templates_, tokens = b.column("host").to_pylist(), b.column("template"), b.column("tokens")
                for j, (blocks, boxes) in enumerate(zip(b.column("blocks").to_pylist(), b.column("boxes").to_pylist())):
                    own, found = None, set()
                    if templates_[j].is_valid and blocks:
                        own = known.get(hosts[j])
                        if own is None:
                            if len(known) > 64:
                                known.clear()
                            own = known[hosts[j]] = Template(templates_[j].as_py())
                        h, n, at = (tokens[j].values.field(c).to_numpy().tolist() for c in ("h", "n", "at"))
                        found = own.found(dict(zip(h, zip(at, n))))
                    kept = article(blocks, boxes, found, own)
                    texts.append("\n".join(kept))
                    slots.append(len(kept))
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column("host"), pa.array(slots, pa.int32())],
                    names=["page_id", "url", "text", "n_chars", "host", "n_slots"],
                )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string, n_slots int")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
