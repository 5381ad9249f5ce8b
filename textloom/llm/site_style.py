"""Main text of web pages by site style trees (operator 1).

The DOMs of a host are merged: an element is identified by its host and by the way down to it,
each step being the sequence of a parent's children (a style) and a place in it. An element
whose pages choose among many styles, or whose content (text runs, links, images) is spread
over few pages each, is important; one that looks and reads the same on every page is not.

    presentation:  - sum over styles of p log_m p        (m pages, 1 if m = 1)
    content:       1 - mean over features of - sum over pages of q log_m q
    composite:     (1 - g^k) * own + g^k * mean of the k children's

Branches of low composite importance go, and so do those that their tag, role or whole class or
id declares to be no article (menus, headers, footers, sidebars, notices, adverts, forms,
comments). A word of a longer name (``right-sidebar``, ``related-work``) only raises the importance
that a branch needs; names say nothing of pages, headings, code and what holds the main part.
Where a page marks its article or main part, branches outside need the higher importance too,
seen on more than one page, and of that part only containers, not its paragraphs and headings,
can fall to their importance. Every page is judged so, whatever it marks. Pages are parsed twice:
to observe all sites, and to judge each page by what was observed.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table, staged

DAMPING, LEAST = 0.9, 0.5
#: Importance that branches need which a part of their name, or a place outside the marked part, speaks against.
DOUBTED = 0.8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LETTERS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
# HTML's element classes, and names that declare what is no article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("ul ol dl table select article section div main body html".split())
_NO_TEXT = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe svg math canvas object audio video dialog menu xmp noembed noframes title".split())
_NO_ROLE = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form toolbar".split())
_NO_CLASS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs notice notices cookie cookies consent gdpr "
    "newsletter subscribe subscription popup modal overlay comment comments disqus reply replies respond share sharing social related recommended footer header masthead pagination pager widget toolbar login signup".split()
)
#: Words that add nothing to such a name but a place or a form: with these alone it declares noise (``comment-list``, ``main-nav``, ``ad-slot-2``).
_FILL = frozenset(
    "list lists item items body slot slots box block area section sections wrap wrapper container holder inner outer content unit bar row col column columns grid panel form field thread text title author meta date label "
    "link links button buttons icon icons logo posts articles stories main site page global top bottom left right side center primary secondary sub mobile desktop sticky fixed floating horizontal vertical upper lower "
    "post article entry blog user reader wp js id search policy settings message messages count toggle template google dfp leaderboard skyscraper rail zone placement".split()
)
#: Names of these stay what a page's own title is in, unless the name says that it is the site's.
_TITLES, _SITE = frozenset("header masthead".split()), frozenset("site global top main".split())
#: What layouts hardly name: these declare noise whatever they hold.
_SAID = frozenset("comment comments reply replies respond disqus".split())
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_KEPT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre code figure figcaption b i em strong span a br".split())
_LANDMARK = frozenset(("article", "main"))
_UNNAMED = _LANDMARK | frozenset("html head body h1 h2 h3 h4 h5 h6 hgroup pre code".split())


def _composed(words: list[str]) -> bool:
    """Whether a name of several words declares noise: one that does, and else words that only place or shape it."""
    rest = [w for w in words if w not in _NO_CLASS]
    if len(rest) == len(words) or not _FILL.issuperset(rest):
        return False
    said = [w for w in words if w in _NO_CLASS]
    return not _TITLES.issuperset(said) or not _SITE.isdisjoint(rest)


class Page:
    """Elements in page order (``tag``, ``parent``, ``sign``, ``noise``, ``part``: landmark or inside one) and text runs (element, text).

    Elements that are noise themselves are ``declared`` (by tag, role, hiding, or a name of several words that is ``composed`` of one for noise
    and of places or forms) or ``named``; ``doubted`` are those that a word of their name speaks against.
    """

    __slots__ = ("tag", "parent", "sign", "noise", "part", "declared", "named", "doubted", "composed", "forms", "runs", "features", "kids")

    def __init__(self, html: str):
        self.tag, self.parent, self.sign, self.noise, self.part = ["#page"], [-1], ["#page"], [False], [False]
        self.declared: set[int] = set()
        self.named: set[int] = set()
        self.doubted: set[int] = set()
        self.composed: dict[int, bool] = {}
        self.forms: set[int] = set()
        self.kids: list[list[int]] = [[]]
        self.runs: list[tuple[int, str]] = []
        self.features: list[tuple[int, str]] = []
        stack, at, end = [0], 0, len(html)
        runs, tags = self.runs, self.tag
        while at < end:
            m = _TOKEN.search(html, at)
            upto = m.start() if m else end
            if upto > at:
                runs.append((stack[-1], html[at:upto]))
            if m is None:
                break
            at = m.end()
            if m[1]:
                name = m[1].lower()
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                if name not in _INLINE:
                    runs.append((stack[-1], " "))
            elif m[2]:
                name = m[2].lower()
                if name in _CLOSES_P or name in _SIBLING:
                    self._imply(stack, name)
                i = self._open(name, m[3], stack[-1])
                if name not in _INLINE:
                    runs.append((i, " "))
                if name in _RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                    at = close.start() if close else end
                    stack.append(i)
                elif name not in _VOID:
                    stack.append(i)
        if self.forms or self.composed:
            self._free()
        if self.named:
            self._lift()
        if self.doubted:
            self.doubted -= self.above()

    def _lift(self) -> None:
        """Names of what holds the page's main part say nothing."""
        lifted = set()
        for i, tag in enumerate(self.tag):
            if tag == "main":
                above = []
                while i > 0:
                    above.append(i)
                    i = self.parent[i]
                if self.declared.isdisjoint(above):
                    lifted |= self.named.intersection(above)
        self.named -= lifted
        if lifted:
            self._spread()

    def _spread(self) -> None:
        """Noise and landmarks go down to what they hold."""
        for i in range(1, len(self.tag)):
            self.noise[i] = i in self.declared or i in self.named or self.noise[self.parent[i]]
            self.part[i] = self.part[self.parent[i]] or (self.tag[i] in _LANDMARK and not self.noise[i])

    def _free(self) -> None:
        """A form that holds a landmark, or most of the page's text, is the page itself.

        So is what has a composed name, which then is only doubted; on a page with a landmark elsewhere
        such names are believed whatever share of the text they hold, and readers' comments everywhere.
        """
        self.declared -= self.forms | self.composed.keys()
        self._spread()
        text, holds = [0] * len(self.tag), [tag in _LANDMARK and not noise for tag, noise in zip(self.tag, self.noise, strict=True)]
        for i, run in self.runs:
            text[i] += 0 if self.noise[i] else len(run.strip())
        for i in range(len(text) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            holds[self.parent[i]] |= holds[i]
        closed = {i for i in self.forms if not holds[i] and 2 * text[i] <= text[0]}
        for i, said in self.composed.items():
            own = holds[i] and not said  # comments may be articles themselves
            if not own and (said or holds[0] or 2 * text[i] <= text[0]):
                closed.add(i)
            elif i not in self.forms:
                self.doubted.add(i)
        if closed:
            self.declared |= closed
            self._spread()

    def above(self) -> set[int]:
        """Elements that hold a landmark and are in none."""
        out = set()
        for i, part in enumerate(self.part):
            if part and not self.part[self.parent[i]]:
                j = self.parent[i]
                while j >= 0:
                    out.add(j)
                    j = self.parent[j]
        return out

    def _imply(self, stack: list[int], name: str) -> None:
        closes = {"p"} if name in _CLOSES_P else _SIBLING[name]
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in closes:
                del stack[k:]
                return
            if tag in _SCOPE:
                return

    def _open(self, name: str, attributes: str, parent: int) -> int:
        i, sign = len(self.tag), name
        noise = name in _NO_TEXT and not (name == "header" and self.part[parent])  # an article's own header has its title
        if attributes and not attributes.isspace():
            values = {}
            for m in _ATTRIBUTE.finditer(attributes):
                values[m[1].lower()] = m[2] or m[3] or m[4] or ""
            kind = (values.get("class", "") + " " + values.get("id", "")).lower()
            if kind != " ":
                sign = f"{name}.{' '.join(kind.split())}"
                if name not in _UNNAMED and self.tag[parent] not in ("pre", "code"):
                    plain = _CAMEL.sub(r"\1-\2", values.get("class", "") + " " + values.get("id", "")).lower()
                    names = [found for x in plain.split() if (found := _LETTERS.findall(x))]
                    if any(map(_NO_CLASS.issuperset, names)):
                        self.named.add(i)
                    elif any(map(_composed, names)):
                        self.composed[i] = any(not _SAID.isdisjoint(x) for x in names)
                        noise = True
                    elif any(not _NO_CLASS.isdisjoint(x) for x in names):
                        self.doubted.add(i)
            noise = noise or values.get("role", "").lower() in _NO_ROLE or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
            link = values.get("href") or values.get("src")
            if link:
                self.features.append((i, "@" + link))
            if values.get("role", "").lower() in ("article", "main"):
                name = values["role"].lower()
        self.tag.append(name)
        self.parent.append(parent)
        self.sign.append(sign)
        if noise:
            self.declared.add(i)
            if name == "form":
                self.forms.add(i)
        self.noise.append(noise or i in self.named or self.noise[parent])
        self.part.append(self.part[parent] or (name in _LANDMARK and not self.noise[-1]))
        self.kids.append([])
        self.kids[parent].append(i)
        return i

    def keys(self, host: str) -> tuple[list[int], list[int]]:
        """Identity of each element in the host's style tree, and of the style of its children."""
        h = xxhash.xxh3_64_intdigest
        key, style = [0] * len(self.tag), [0] * len(self.tag)
        key[0] = h(host.encode())
        for i, kids in enumerate(self.kids):
            style[i] = s = h("\0".join([self.sign[k] for k in kids]).encode()) if kids else 0
            for n, k in enumerate(kids):
                key[k] = h(b"%d %d %d" % (key[i], s, n))
        return key, style

    def undecided(self) -> list[int]:
        """Elements that their importance judges."""
        marked, above = any(self.part), self.above()
        return [
            i
            for i in range(1, len(self.tag))
            if not self.noise[i] and i not in above and self.tag[i] not in ("html", "body") and (not marked or not self.part[i] or i in self.doubted or (self.tag[i] not in _KEPT and self.tag[i] not in _LANDMARK))
        ]

    def gone(self, own: dict[int, tuple[float, float]], least: float) -> set[int]:
        """Elements that fall, from (own importance, times seen on the host) of those that can be judged."""
        whole, marked, out = composite(self, {i: x for i, (x, _) in own.items()}), any(self.part), set()
        above = self.above()
        for i in self.undecided():
            seen, outside = own.get(i, (1.0, 1.0))[1], marked and not self.part[i]
            if i in self.doubted or (outside and (self.tag[i] not in _INLINE or self.parent[i] in above)):
                if whole.get(i, 1.0) < max(least, DOUBTED) or (outside and seen <= 1):
                    out.add(i)
            elif whole.get(i, 1.0) < least and self.tag[i] not in _INLINE:
                out.add(i)
        return out

    def below(self, nodes: list[int]) -> list[int]:
        """``nodes`` and what lies under them, noise aside."""
        inside = [False] * len(self.tag)
        for i in nodes:
            inside[i] = True
        for i in range(1, len(inside)):
            inside[i] = not self.noise[i] and (inside[i] or inside[self.parent[i]])
        return [i for i, x in enumerate(inside) if x]

    def text(self, gone: set[int] | None = None) -> str:
        """The text without ``gone``; None: of the marked part, or of all if there is none."""
        marked, out, lost = any(self.part), [], list(self.noise)
        above = self.above()
        for i in range(1, len(lost)):
            lost[i] = lost[i] or (gone is not None and i in gone) or lost[self.parent[i]]
        for i, run in self.runs:
            if not lost[i] and (self.part[i] or not marked or (gone is not None and i not in above)):
                out.append(run)
            elif run == " " and out and out[-1] != " ":
                out.append(run)
        return " ".join(entities.unescape("".join(out)).split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _s(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_OBSERVED = "kind tinyint, key bigint, item bigint, total double, logs double, keys array<bigint>, nodes array<int>"


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's styles (kind 0) and content features (kind 1) by (key, item), its pages summed up; for each page (``item``) the elements that are judged (kind 2)."""
    seen: dict[tuple[int, int, int], list[float]] = {}
    looks: list[tuple[int, list[int], list[int]]] = []
    held = 0

    def made() -> pa.RecordBatch:
        rows = [(k[1], _s(k[0]), _s(k[2]), x[0], x[1], None, None) for k, x in seen.items()] + [(2, None, row, None, None, keys, nodes) for row, keys, nodes in looks]
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        seen.clear(), looks.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "key", "item", "total", "logs", "keys", "nodes"])

    h = xxhash.xxh3_64_intdigest
    for batch in batches:
        for row, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not html:
                continue
            page = Page(html)
            key, style = page.keys(host_of(url))
            own: dict[tuple[int, int, int], int] = {}
            for i in range(len(key)):
                k = (key[i], 0, style[i])
                own[k] = own.get(k, 0) + 1
            for i, run in page.runs + page.features:
                if run != " " and not run.isspace():
                    k = (key[i], 1, h(" ".join(run.split()).encode("utf-8", "replace")))
                    own[k] = own.get(k, 0) + 1
            for k, n in own.items():
                x = seen.setdefault(k, [0.0, 0.0])
                x[0] += n
                x[1] += n * math.log(n)
            nodes = page.below(page.undecided())
            looks.append((row, [_s(key[i]) for i in nodes], nodes))
            held += len(nodes)
            if len(seen) > 1 << 18 or held > 1 << 20:
                held = 0
                yield made()
    if seen:
        yield made()


def importance(observed: DataFrame) -> DataFrame:
    """(key, own, m): own importance of every element of the style trees of all hosts, and how often it was seen."""
    items = observed.filter("kind < 2").groupBy("key", "kind", "item").agg(F.sum("total").alias("total"), F.sum("logs").alias("logs"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    t = F.col("total")
    by_key = items.groupBy("key").agg(
        F.sum(F.when(style, t)).alias("m"),
        F.sum(F.when(style, t * F.log(t))).alias("styles"),
        F.sum(F.when(content, F.log(t) - F.col("logs") / t)).alias("spread"),
        F.sum(content.cast("double")).alias("features"),
    )
    m = F.log("m")
    own = F.when(F.col("m") <= 1, 1.0).when(F.col("features") > 0, 1 - F.col("spread") / F.col("features") / m).otherwise((m - F.col("styles") / F.col("m")) / m)
    return by_key.select("key", F.least(F.lit(1.0), F.greatest(F.lit(0.0), own)).alias("own"), "m")


def composite(page: Page, own: dict[int, float]) -> dict[int, float]:
    out: dict[int, float] = {}
    for i in range(len(page.tag) - 1, 0, -1):
        if i in own:
            kids = [out[k] for k in page.kids[i] if k in out]
            g = DAMPING ** len(kids)
            out[i] = (1 - g) * own[i] + g * sum(kids) / len(kids) if kids else own[i]
    return out


def _judged(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for html, own in zip(batch.column("html").to_pylist(), batch.column("own").to_pylist(), strict=True):
            page = Page(html or "")
            gone = page.gone({x["node"]: (x["own"], x["m"]) for x in own or ()}, least)
            text.append(page.text(gone) or page.text())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, least: float = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row: its main text, blocks in page order joined by one space.

    Null and empty html have an empty text; a page without any tags is its text; pages may have
    any length. Pages without a host form a site. If every branch is of low importance, none goes
    for that reason. Rows that repeat, share an id or have none are pages of their own; an empty
    table gives an empty one. Other columns are ignored.
    """
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("row", F.xxhash64("page_id", "url", "html"))
    observed = staged(rows.select("row", "url", "html").mapInArrow(_observed, _OBSERVED), "observed")
    looks = observed.filter("kind = 2").select(F.col("item").alias("row"), F.explode(F.arrays_zip("nodes", "keys")).alias("x")).select("row", F.col("x.nodes").alias("node"), F.col("x.keys").alias("key"))
    known = staged(importance(observed), "importance")  # written, so that the join can split a hot element
    found = staged(looks.join(known, "key").groupBy("row").agg(F.collect_set(F.struct("node", "own", "m")).alias("own")), "judged")  # written, so that pages only move if there is much to judge
    return rows.join(found, "row", "left").select("page_id", "url", "html", "own").mapInArrow(lambda b: _judged(b, least), f"page_id {kind}, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


#: The text of pages that are built as the test tables' are: the article's, without tags (the rule for these pages, not for all).
ORACLE = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '&amp', '&'), '[\s]+', ' ', 'g')) AS text FROM pages)
"""
