"""Main text of web pages, with site templates removed.

Every element of a page is hashed with all it holds, once with its texts and once as a skeleton:
tags, classes and ids of the subtree and of its place, runs of alike siblings as one, no text. A
page's main part is the innermost element with more than half of its text. Spark counts hashes
per host: a skeleton that recurs beside the main parts of many pages of a host, and is seldom a
main part itself, is template, and so is a subtree that recurs with its very text in different main
parts, as many as half of the host's pages.
Templates are deleted from all pages of the host, and what remains is the text.

Names that markup gives to menus, adverts and the like (NAMED, MARKED) are used where counts
can't tell: inside main parts, and on hosts of too few pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import freed, plain, stash

#: Pages of a host that "many" means at least, and the share of its pages from where skeletons
#: count as many: no more than a page's elements over that share can, some ten thousand.
TEMPLATE_PAGES = 10
LEAST_SHARE = 0.001
#: A template's pages are so many times those where it is on the way to the main part.
BESIDE = 3
#: Share of a host's pages from where a subtree of equal text is template inside main parts too.
EQUAL_SHARE = 0.5
#: Template hashes that may be broadcast, 8 bytes each; checked by a sum.
HASHES_BROADCAST = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu"
    " nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset(
    "head script style noscript template button select option input textarea iframe object embed"
    " svg canvas audio video map datalist noframes title".split()
)
#: Elements that by their tag are not the article.
MARKED = frozenset("nav footer aside form dialog menu".split())
#: Elements that hold text rather than parts of a page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd li ul ol dl figcaption legend summary tr".split())

#: Elements that a start tag of the key's kind ends, inside the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
#: Words of class, id and role names that mark what is not the article.
NAMED = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager"
    " footer masthead sidebar aside widget widgets related recommended"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social comment comments disqus replies respond"
    " complementary contentinfo search skip toolbar".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Element:
    __slots__ = ("hash", "items", "kids", "kind", "n", "named", "parts", "shape", "sign", "tag")

    def __init__(self, tag: str, sign: str, kind: str, named: bool):
        self.tag, self.sign, self.kind, self.named = tag, sign, kind, named
        self.items: list[Element | str] = []
        self.parts = xxhash.xxh64(tag)
        self.kids: list[int] = []
        self.hash = self.shape = self.n = 0

    def close(self) -> None:
        self.hash = self.parts.intdigest() - (1 << 63)
        self.shape = xxhash.xxh64_intdigest(f"{self.kind}{self.kids}")

    def add(self, done: Element) -> None:
        """A closed child's hashes and characters. Inline elements have no part in a skeleton."""
        self.parts.update(f"\x01{done.hash}")
        if done.tag not in SILENT:
            self.n += done.n
        if done.tag in BLOCKS:
            if not self.kids or self.kids[-1] != done.shape:
                self.kids.append(done.shape)
        else:
            self.kids.extend(k for k in done.kids if not self.kids or self.kids[-1] != k)


def _named(tag: str, attributes: str) -> tuple[str, str, bool]:
    """Tag, classes and id of an element, without numbers and with those of classes, and whether
    its names say that it is not the article. Elements around a main part may carry the number of
    their page (``postid-7``), but elsewhere ``x3`` and ``x9`` may be of two kinds."""
    named = tag in MARKED or bool(attributes and _HIDDEN.search(attributes))
    sign, kind = [tag], [tag]
    for m in _NAMES.finditer(attributes or ""):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() != "role":
            name, words = m[1].lower(), " ".join(sorted(value.split()))
            sign.append(name + re.sub(r"\d+", "0", words))
            kind.append(name + words if name == "class" else sign[-1])
        if tag not in ("html", "body", "main", "article") and not NAMED.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            named = True
    return "|".join(sign), "|".join(kind), named


def parse(page: str) -> Element:
    """A tree of any markup, in one pass: unclosed and stray tags, comments and raw text as
    browsers take them, or nearly so."""
    root = Element("", "", "", False)
    stack = [root]

    def text(s: str) -> None:
        if s:
            stack[-1].items.append(s)
            if words := " ".join(s.split()):
                stack[-1].parts.update("\x00" + words)
                stack[-1].n += len(words)

    def pop() -> None:
        done = stack.pop()
        done.close()
        stack[-1].add(done)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(entities.unescape(page[at:]))
            break
        if lt > at:
            text(entities.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in ENDS:
            closed, inside = ENDS[tag]
            last = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in inside:
                    break
                if stack[k].tag in closed:
                    last = k
            while last and len(stack) > last:
                pop()
        sign, kind, named = _named(tag, m[3])
        named |= tag == "header" and not any(x.tag in ("article", "main") for x in stack)
        e = Element(tag, sign, kind, named)
        stack[-1].items.append(e)
        stack.append(e)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = end.start() if end else n
            if tag not in SILENT:
                text(page[at:stop])
            else:
                e.parts.update(page[at:stop])
            at = stop
            if not end:
                break
        elif tag in VOID:
            pop()
    while len(stack) > 1:
        pop()
    root.close()
    return root


def _placed(path: int, e: Element, on_way: bool) -> int:
    """Path of an element's children."""
    return xxhash.xxh64_intdigest(f"{path}/{e.sign if on_way else e.kind}")


def _key(path: int, e: Element) -> int:
    """Skeleton of an element at its place."""
    return xxhash.xxh64_intdigest(f"{path}:{e.shape}") - (1 << 63)


def _inner(e: Element) -> Iterator[Element]:
    return (x for x in e.items if isinstance(x, Element) and x.tag not in SILENT)


def main_part(root: Element) -> list[Element]:
    """The elements that hold more than half of the text, outermost first."""
    chain = [root]
    while True:
        for x in _inner(chain[-1]):
            if 2 * x.n > root.n and x.tag in BLOCKS and x.tag not in LEAVES:
                chain.append(x)
                break
        else:
            return chain


#: What a hash was seen as: beside the main part, on the way to it, and inside it with its text.
ASIDE, ON_WAY, INSIDE = 0, 1, 2


def subtree_hashes(page: str) -> set[tuple[int, int]]:
    """Distinct hashes of a page's elements, and what each was seen as."""
    root = parse(page)
    return _hashes(root, main_part(root))


def _hashes(root: Element, chain: list[Element]) -> set[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    todo: list[tuple[Element, int, int]] = [(root, 0, ON_WAY)]
    way = set(map(id, chain))
    while todo:
        e, path, seen = todo.pop()
        if seen == INSIDE:
            if e.n and e.tag in BLOCKS:
                found.add((e.hash, INSIDE))
        elif e.n and e.tag in BLOCKS and e.tag not in ("html", "body"):
            found.add((_key(path, e), seen))
        below = INSIDE if e is chain[-1] else seen
        inner = _placed(path, e, id(e) in way)
        for x in _inner(e):
            if below == ON_WAY:
                todo.append((x, inner, ON_WAY if id(x) in way else ASIDE))
            else:
                todo.append((x, inner, below))
    return found


def main_text(page: str, template: frozenset[int] = frozenset(), counted: bool = False) -> str:
    """The blocks that remain, one a line. ``counted``: the host has pages enough for counts to
    tell templates beside main parts."""
    root = parse(page)
    text = _remains(root, template, counted)
    return text or (_remains(root, frozenset(), False) if template else text)


def _remains(root: Element, template: frozenset[int], counted: bool) -> str:
    chain = main_part(root)
    part, way = chain[-1], set(map(id, chain))
    lines: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(words).split()):
            lines.append(line)
        words.clear()

    todo: list = [(root, 0, part is root or not counted, False)]
    while todo:
        x, path, by_name, after = todo.pop()
        if isinstance(x, str):
            words.append(x)
            continue
        if after:
            flush()
            continue
        gone = x.tag in SILENT or (by_name and x.named and 2 * x.n <= root.n)
        if template and not gone and x is not root:
            gone = x.hash in template or _key(path, x) in template
        if gone:
            words.append(" ") if x.tag not in BLOCKS else flush()
            continue
        if x.tag == "br":
            words.append(" ")
        if x.tag in BLOCKS:
            flush()
            todo.append((x, 0, False, True))
        inner = _placed(path, x, id(x) in way)
        by_name = by_name or x is part
        todo.extend((y, inner, by_name, False) for y in reversed(x.items))
    flush()
    return "\n".join(lines)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, hashes)`` of hosts of many pages: the template subtrees of each. Pages
    without a host have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, seen, mains = [], [], [], []
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                root = parse(page.as_py() or "")
                chain = main_part(root)
                each = _hashes(root, chain)
                hosts.extend([host.as_py()] * len(each))
                hashes.extend(x[0] for x in each)
                seen.extend(x[1] for x in each)
                mains.extend(chain[-1].hash if x[1] == INSIDE else None for x in each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(seen, pa.int32()), pa.array(mains, pa.int64())],
                ["host", "hash", "seen", "main"],
            )

    some = pages.where("host <> ''")
    seen = some.select("host", "html").mapInArrow(freed(run), "host string, hash long, seen int, main long")
    # Copies of one main part say once what is in it, else they would lose what they share.
    each = seen.groupBy("host", "hash").agg(
        *[F.count_if(F.col("seen") == i).alias(f"n{i}") for i in (ASIDE, ON_WAY)], F.count_distinct("main").alias(f"n{INSIDE}")
    )
    many = each.where((F.col("n0") >= TEMPLATE_PAGES) | (F.col("n2") >= TEMPLATE_PAGES))
    total = some.groupBy("host").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= TEMPLATE_PAGES)
    beside = (F.col("n0") >= F.greatest(F.lit(TEMPLATE_PAGES), F.col("total") * LEAST_SHARE)) & (F.col("n0") >= BESIDE * F.col("n1"))
    equal = F.col("n2") >= F.greatest(F.lit(TEMPLATE_PAGES), F.col("total") * EQUAL_SHARE)
    return total.join(many, "host", "left").groupBy("host").agg(F.sort_array(F.collect_set(F.when(beside | equal, F.col("hash")))).alias("hashes"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text. Null urls have no host and so no site template. A
    page that is template throughout keeps its text. Rows that repeat are extracted each. Extra
    columns are ignored; an empty table gives an empty result.
    """
    p = plain(pages, page_id="long", url="string", html="string")
    p = p.withColumn("host", host_of(F.col("url")))
    known = stash(templates(p), "templates").select(F.col("host").alias("site"), "hashes")
    size = known.agg(F.sum(F.size("hashes") + 4)).first()[0] or 0
    side = F.broadcast(known) if size <= HASHES_BROADCAST else known
    both = p.join(side, p["host"] == F.col("site"), "left").select("page_id", "url", "html", "site", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, frozenset[int]] = {}  # of the hosts of a task's last pages
        for batch in batches:
            texts = []
            for i, (page, site) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                if site is not None and site not in sites:
                    if len(sites) >= 256:
                        sites.clear()
                    sites[site] = frozenset(batch.column(4)[i].as_py())
                texts.append(main_text(page.as_py() or "", sites.get(site, frozenset()), site is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return both.mapInArrow(freed(run), "page_id long, url string, text string, n_chars long")
