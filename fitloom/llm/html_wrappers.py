"""Main text of web pages by wrappers inferred per host.

A page is read as a token stream of structural tags and text. Its skeleton is folded
first: equal neighbours (and runs of two or three) inside one element become a repeated
group, so pages that differ in the number of paragraphs or links have one skeleton. Pages are
counted per (host, skeleton) with partial sums, and only distinct skeletons are aligned: two at
a time, element by element, by a longest common subsequence of the children. What only one
side has becomes an optional group, what repeats on either side a repeated group, and text a
slot; the result is a union-free regular expression, the host's wrapper. Alignment runs per
(host, part) first and then per host, so a host with a third of all pages is split over tasks.

Every page is then matched against its host's wrapper, element by element: as many children as can be are
assigned to children of the wrapper in order, repeated ones again, repeated groups from their
beginning. A slot is known by its place in the wrapper. Its statistics over all pages of the
host with any text (characters, whether every page has the same texts there) choose the main
region: the lowest container that holds all the varying text, so an article in several
containers, or a host with two layouts, is read whole. Slots with the same texts on all pages are template text when most of the text varies, and
otherwise where they lie outside the container with most of the varying text. A page's text is
its blocks inside the region, outside of elements that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments by tag, role or a word of class or
id. A form, or an element skipped for a word of its class or id (comments apart), that holds most
of a page's text counts as a wrapper of the page if that text is mostly paragraphs or holds an
article, main or h1 element: it is not skipped.

A block ends where a block-level tag begins or ends; inline tags vanish, ``<br>`` is white space;
character references are decoded, white space becomes one space, blocks are joined by
newlines in page order. MathML elements are inline, without their annotations.

Edge cases: NULL or empty html gives the empty text; a cut page is read as far as it goes (an
unfinished last tag is dropped); a NULL url is a host of its own (the empty one); text that the
wrapper has no slot for belongs to the deepest element that was matched and is never template text; a page
without its host's region gives all blocks outside excluded elements; repeated rows get
the same result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch

# Element names and words by their role on a page.
SKIPPED = frozenset(
    "nav header footer aside form script style noscript template iframe svg button select option textarea head title "
    "menu dialog object canvas audio video map input label fieldset".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "respond reply replies disqus discussion share sharing social related recommended newsletter subscribe subscription login signup "
    "search pager pagination widget copyright toolbar skip".split())
# never a wrapper of the page: readers can write more than the author
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus discussion".split())
# skipped unless they hold most of the page
WRAPPING = frozenset("form fieldset".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img math mi mn mo ms mrow mfrac msqrt mroot mtext mspace mstyle merror mpadded mphantom mfenced menclose msub msup "
    "msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr !doctype".split())
CONTAINERS = frozenset("html body div main article section td table tbody tr center #page".split())
WHOLE = frozenset("html body main article".split())
# an element on the left is closed by the start of one on the right
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|annotation-xml|annotation)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z!][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z!][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
PARTS = 16
LONGEST_FOLD = 3
TEMPLATE_PAGES = 5
NEST = 100              # elements nested deeper are children of the one at this depth: every tree function is that deep at most
ALIGN_CELLS = 1_000_000  # pairs of children up to which the best alignment is sought; beyond, each goes to the nearest that follows


def _tag(name: str, attributes: str) -> tuple[str, int]:
    """Signature (name, and class or id with digits masked) and how the element is skipped: 0 not, 1 unless it
    holds most of the page, 2 always."""
    skipped, sig = 2 if name in SKIPPED and name not in WRAPPING else int(name in WRAPPING), name
    if attributes:
        for key, a, b, c in NAMES.findall(attributes):
            value, key = (a or b or c).lower(), key.lower()
            if key == "role":
                if value in SKIP_ROLES:
                    skipped = max(skipped, 1 if value in WRAPPING else 2)
            else:
                sig += ("#" if key == "id" else ".") + re.sub(r"\d+", "0", value).replace(">", "")
                words = SKIP_WORDS.intersection(WORDS.findall(value))
                if words:
                    skipped = max(skipped, 2 if words & COMMENT_WORDS else 1)
    return sig, 0 if name in WHOLE else skipped


class Page:
    """Blocks (path, text, skipped) in page order and the skeleton tree of one page."""

    def __init__(self, html: str, skeleton: bool = False):
        read: list[tuple[str, str, bool, tuple[int, ...]]] = []
        self.root: list = ["#page", 0, []]  # signature, flags, children
        # name, path, skipped, node, numbers of the elements around that may turn out to be wrappers of the page
        stack: list[tuple[str, str, bool, list, tuple[int, ...]]] = [("#page", "#page", False, self.root, ())]
        opened: dict[str, int] = {}  # open elements by name
        doubtful: list[list] = []  # characters, those in paragraphs, whether a title or an article is inside
        pieces: list[str] = []
        at = 0

        def flush() -> None:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                name, path, skipped, node, around = stack[-1]
                read.append((path, text, skipped, around))
                if not skipped:
                    for k in around:
                        doubtful[k][0] += len(text)
                        doubtful[k][1] += len(text) if name == "p" else 0
                if skeleton:
                    node[2].append(["#text", 0, [], len(read) - 1])

        for m in TOKEN.finditer(html):
            if m.start() > at:
                pieces.append(unescape(html[at:m.start()]))
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name or name in INLINE:
                continue
            if name == "br":
                pieces.append(" ")
                continue
            flush()
            if m[2] or m[5]:
                while opened.get(name, 0):
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            elif name not in VOID:
                closing = CLOSED_BY.get(stack[-1][0], ())
                if closing is None or name in closing:
                    opened[stack.pop()[0]] -= 1
                sig, skipped = _tag(name, m[4] or m[7] or "")
                node = [sig, 0, []]
                top = stack[min(len(stack) - 1, NEST)]
                if skeleton:
                    top[3][2].append(node)
                around = stack[-1][4]
                if name in ("article", "main", "h1"):
                    for k in around:
                        doubtful[k][2] = True
                if skipped == 1 and len(stack) <= NEST:
                    around = (*around, len(doubtful))
                    doubtful.append([0, 0, False])
                opened[name] = opened.get(name, 0) + 1
                stack.append((name, f"{top[1]}>{sig}", skipped == 2 or stack[-1][2], node, around))
        if at < len(html):
            pieces.append(unescape(html[at:]))
        flush()
        total = sum(len(text) for _, text, skipped, _ in read if not skipped)
        out = {k for k, (chars, prose, article) in enumerate(doubtful) if 2 * chars <= total or not (article or 2 * prose > chars)}
        self.blocks: list[tuple[str, str, bool]] = [(path, text, skipped or not out.isdisjoint(around)) for path, text, skipped, around in read]


# Skeletons: [signature, flags, children]; flag 1: repeated, 2: optional. A page's text has its block's number besides.


def fold(node: list) -> list:
    """``node`` with equal neighbouring runs of children made one repeated group."""
    children = [fold(c) for c in node[2]]
    for size in range(1, LONGEST_FOLD + 1):
        out: list = []
        for c in children:
            out.append(c)
            while len(out) >= 2 * size and [_shape(x) for x in out[-size:]] == [_shape(x) for x in out[-2 * size:-size]]:
                del out[-size:]
                if size == 1:
                    out[-1] = [out[-1][0], out[-1][1] | 1, out[-1][2]]
                else:
                    for k in range(-size, 0):
                        out[k] = [out[k][0], out[k][1] | 1, out[k][2]]
        children = out
    return [node[0], node[1], children]


def _shape(node: list) -> tuple:
    return node[0], tuple(_shape(c) for c in node[2])


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of very long lists, each name goes to the nearest that follows in the other."""
    lead = 0
    while lead < min(len(x), len(y)) and x[lead] == y[lead]:
        lead += 1
    out = [(k, k) for k in range(lead)]
    x, y = x[lead:], y[lead:]
    if len(x) * len(y) > ALIGN_CELLS:
        places: dict[str, list[int]] = {}
        for j, name in enumerate(y):
            places.setdefault(name, []).append(j)
        at = 0
        for i, name in enumerate(x):
            mine = places.get(name, [])
            k = bisect_left(mine, at)
            if k < len(mine):
                out.append((lead + i, lead + mine[k]))
                at = mine[k] + 1
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((lead + i, lead + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper of two skeletons with one signature: common children aligned, others optional."""
    x, y = a[2], b[2]
    out, i, j = [], 0, 0
    for i2, j2 in [*_common([c[0] for c in x], [c[0] for c in y]), (len(x), len(y))]:
        out += [[c[0], c[1] | 2, c[2]] for c in (*x[i:i2], *y[j:j2])]
        if i2 < len(x):
            out.append(align(x[i2], y[j2]))
        i, j = i2 + 1, j2 + 1
    return fold([a[0], a[1] | b[1], out])


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    if node[0] == "#text":
        body = "#text"
    else:
        body = " ".join([f"<{node[0]}>", *[expression(c) for c in node[2]], f"</{re.split('[.#]', node[0])[0]}>"]) if node[0] != "#page" else " ".join(expression(c) for c in node[2])
    mark = {0: "", 1: "+", 2: "?", 3: "*"}[node[1]]
    return f"({body}){mark}" if mark else body


class Wrapper:
    """A host's wrapper with its nodes numbered from the root (0) in page order."""

    def __init__(self, tree: list):
        self.sig: list[str] = []
        self.repeated: list[bool] = []
        self.parent: list[int] = []
        self.kids: list[list[int]] = []
        self.known: dict[tuple, list[int]] = {}
        stack = [(tree, -1)]
        while stack:
            node, parent = stack.pop()
            number = len(self.sig)
            self.sig.append(node[0]), self.repeated.append(bool(node[1] & 1)), self.parent.append(parent), self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(number)
            stack.extend((c, number) for c in reversed(node[2]))
        # the nodes under k are those from k to end[k]
        self.end = list(range(1, len(self.sig) + 1))
        for k in range(len(self.sig) - 1, 0, -1):
            self.end[self.parent[k]] = max(self.end[self.parent[k]], self.end[k])

    def path(self, number: int) -> str:
        return (self.path(self.parent[number]) + ">" if number else "") + self.sig[number]

    def _pairs(self, number: int, sigs: tuple[str, ...]) -> list[int]:
        """For each of a page element's children the wrapper's child that it is, -1: none."""
        key = number, sigs
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            kids = self.kids[number]
            names, repeated = [self.sig[k] for k in kids], [self.repeated[k] for k in kids]
            found = self._in_turn(sigs, names, repeated)
            if found is None:
                found = self._most(sigs, names, repeated)
            self.known[key] = [kids[j] if j >= 0 else -1 for j in found]
        return self.known[key]

    @staticmethod
    def _back(j: int, repeated: list[bool]) -> int:
        """The first child that may follow child ``j``: of a repeated group the beginning."""
        if not repeated[j]:
            return j + 1
        least = j
        while least > 0 and repeated[least - 1] and j - least < LONGEST_FOLD - 1:
            least -= 1
        return least

    def _in_turn(self, sigs: tuple[str, ...], names: list[str], repeated: list[bool]) -> list[int] | None:
        """The nearest choice for each child, None where one has none."""
        at, out = -1, []
        for s in sigs:
            if at >= 0 and repeated[at] and names[at] == s:
                pass
            elif at + 1 < len(names) and names[at + 1] == s:
                at += 1
            else:
                back = range(self._back(at, repeated), at) if at >= 0 else ()
                at = next((j for j in (*back, *range(at + 2, len(names))) if names[j] == s), None)
                if at is None:
                    return None
            out.append(at)
        return out

    def _most(self, sigs: tuple[str, ...], names: list[str], repeated: list[bool]) -> list[int]:
        """The choice that gives the most children one."""
        m, k = len(sigs), len(names)
        if m * k > ALIGN_CELLS:
            return self._nearest(sigs, names, repeated)
        after = [self._back(j, repeated) for j in range(k)]
        best = [[0] * (k + 1) for _ in range(m + 1)]
        for i in range(m - 1, -1, -1):
            for j in range(k - 1, -1, -1):
                best[i][j] = max(best[i][j + 1], best[i + 1][j], 1 + best[i + 1][after[j]] if names[j] == sigs[i] else 0)
        i = j = 0
        out = []
        while i < m:
            if j < k and names[j] == sigs[i] and best[i][j] == 1 + best[i + 1][after[j]]:
                out.append(j)
                i, j = i + 1, after[j]
            elif j < k and best[i][j] == best[i][j + 1]:
                j += 1
            else:
                out.append(-1)
                i += 1
        return out

    def _nearest(self, sigs: tuple[str, ...], names: list[str], repeated: list[bool]) -> list[int]:
        """For each child the nearest choice that may follow the one before it, if there is one."""
        found: dict[str, list[int]] = {}
        for j, name in enumerate(names):
            found.setdefault(name, []).append(j)
        at, out = 0, []
        for s in sigs:
            mine = found.get(s, [])
            k = bisect_left(mine, at)
            out.append(mine[k] if k < len(mine) else -1)
            if k < len(mine):
                at = self._back(mine[k], repeated)
        return out

    def places(self, page: Page) -> list[int]:
        """The slot of each of the page's blocks; where it has none, the deepest element that was matched."""
        out = [0] * len(page.blocks)
        stack = [(page.root, 0, True)]
        while stack:
            node, number, matched = stack.pop()
            pairs = self._pairs(number, tuple(c[0] for c in node[2])) if matched else [-1] * len(node[2])
            for c, to in zip(node[2], pairs, strict=True):
                if c[0] == "#text":
                    out[c[3]] = number if to < 0 else to
                elif c[2]:
                    stack.append((c, number if to < 0 else to, to >= 0))
        return out

    def region(self, mass: dict[int, int], whole: bool = True) -> int:
        """From the root down into the container that holds all of ``mass`` (not ``whole``: more than half)."""
        before = [0]
        for k in range(len(self.sig)):
            before.append(before[-1] + mass.get(k, 0))
        at, total = 0, before[-1]
        while True:
            best = max(self.kids[at], key=lambda k: before[self.end[k]] - before[k], default=None)
            if best is None or re.split("[.#]", self.sig[best])[0] not in CONTAINERS:
                return at
            held = before[self.end[best]] - before[best]
            if held < total if whole else 2 * held <= total:
                return at
            at = best


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> skeleton counts, added up per batch."""
    for batch in batches:
        skeletons: dict[tuple[str, str], int] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = host, json.dumps(fold(Page(html or "", skeleton=True).root), separators=(",", ":"))
            skeletons[key] = skeletons.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([h for h, _ in skeletons], pa.string()), pa.array([k for _, k in skeletons], pa.string()), pa.array(list(skeletons.values()), pa.int64()),
        ], names=["host", "skeleton", "pages"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, tree) -> sums of each slot of the wrapper, added up per batch; place 0 counts the pages with text."""
    known: dict[str, Wrapper] = {}
    for batch in batches:
        slots: dict[tuple[str, int], list] = {}
        for host, html, tree in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            page = Page(html or "", skeleton=True)
            own: dict[int, list[str]] = {}
            for place, (_, text, skipped) in zip(_wrapper(known, host, tree).places(page), page.blocks, strict=True):
                if not skipped:
                    own.setdefault(place, []).append(text)
            if own:
                own.setdefault(0, [])
            for place, texts in own.items():
                mark = xxhash.xxh3_64_hexdigest("\0".join(texts))
                s = slots.setdefault((host, place), [0, 0, mark, mark])
                s[0] += 1
                s[1] += sum(map(len, texts))
                s[2], s[3] = min(s[2], mark), max(s[3], mark)
        yield pa.RecordBatch.from_arrays([
            pa.array([h for h, _ in slots], pa.string()), pa.array([p for _, p in slots], pa.int32()),
            *[pa.array([s[k] for s in slots.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
        ], names=["host", "place", "pages", "chars", "low", "high"])


def _wrapper(known: dict[str, Wrapper], host: str, tree: str) -> Wrapper:
    if host not in known:
        if len(known) >= 1000:
            known.clear()
        known[host] = Wrapper(json.loads(tree))
    return known[host]


def _merged(skeletons: pd.Series) -> str:
    trees = [json.loads(s) for s in sorted(skeletons, key=lambda s: (len(s), s))]
    whole = trees[0]
    for t in trees[1:]:
        whole = align(whole, t)
    return json.dumps(whole, separators=(",", ":"))


def _with_trees(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages`` plus ``__h`` and the columns of ``known``. As many rows as hosts: Spark broadcasts them only under its size limit."""
    rows = pages.withColumn("__h", host_of(F.col("url")))
    return rows.join(known.withColumnRenamed("host", "__host"), F.col("__h") == F.col("__host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (expression), region (path), template (places of template slots), and the tree and the
    region's place in it: one row per host."""
    pages = pages.select("url", "html")
    read = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_read, "host string, skeleton string, pages long")
    distinct = read.groupBy("host", "skeleton").agg(F.sum("pages").alias("pages"))
    distinct = distinct.withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(PARTS)).cast("int"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "skeleton": [_merged(pdf["skeleton"])]})

    schema = "host string, skeleton string"
    merged = scratch(distinct.groupBy("host", "part").applyInPandas(merge, schema).groupBy("host").applyInPandas(merge, schema), "html-trees")
    slots = (_with_trees(pages, merged).select("__h", "html", "skeleton")
             .mapInArrow(_slots, "host string, place int, pages long, chars long, low string, high string"))
    slots = slots.groupBy("host", "place").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high"))

    def choose(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = left["skeleton"].iloc[0]
        whole = Wrapper(json.loads(tree))
        n = int(right["pages"].max()) if len(right) else 0
        chars = {int(p): int(c) for p, c in zip(right["place"], right["chars"], strict=True)}
        constant = {int(p) for p, pages, lo, hi in zip(right["place"], right["pages"], right["low"], right["high"], strict=True)
                    if whole.sig[p] == "#text" and pages == n >= TEMPLATE_PAGES and lo == hi}
        mass = {p: c for p, c in chars.items() if p not in constant}
        varies = 2 * sum(mass.values()) > sum(chars.values())
        mass = mass if any(mass.values()) else chars
        region, core = whole.region(mass), whole.region(mass, whole=False)
        template = sorted(p for p in constant if varies or not core <= p < whole.end[core])
        return pd.DataFrame({"host": [key[0]], "wrapper": [expression(json.loads(tree))], "region": [whole.path(region)], "template": [template],
                             "tree": [tree], "place": [region]})

    return merged.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(
        choose, "host string, wrapper string, region string, template array<int>, tree string, place int")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    known = scratch(wrappers(pages), "html-wrappers").select("host", "tree", "place", "template")
    rows = _with_trees(pages.select("page_id", "url", "html"), known).select("page_id", "url", "html", "__h", "tree", "place", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for html, host, tree, region, template in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                page, whole, template = Page(html or "", skeleton=True), _wrapper(trees, host, tree), set(template)
                blocks = [(p, t) for p, (_, t, skipped) in zip(whole.places(page), page.blocks, strict=True) if not skipped]
                inside = [(p, t) for p, t in blocks if region <= p < whole.end[region]] or blocks
                texts.append("\n".join(t for p, t in inside if p not in template))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
