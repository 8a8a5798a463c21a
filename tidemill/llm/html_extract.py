"""Main text of web pages by consensus host paths.

1. Every page's containers are scored, each alone: by their own text, less what stands in links and in boilerplate, with a premium for
   article-like tags. A page votes for its best container's generalised path: tags with their classes (digits
   dropped), without positions. Votes are counted by host in Spark, where partial sums go before the shuffle, so a host
   with a third of all pages costs no more than another.
2. A host's winning path (most votes, then the higher score, then the smaller path) goes to all its pages, each of which
   is read again: the containers on that path give the text. A page without them uses its own best container, and so does
   one whose own best is an article or main element while the winner is none and scores less than a quarter of it there.

Out go menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments (both kinds) and markup, inside
the container too. Elements say so by tag, role or attribute, or by a class or id all of whose words are names of boilerplate or
of mere layout ("share-buttons"); where such a word is only part of a name ("share-price"), half of the element's text must
stand in links as well, as it must for a paragraph of any name. What holds an h1, or the first heading of an article or main
element, stays, but for a header right below the body; if nothing would be left, names don't count. Character
references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by a
newline. Whatever else the container holds stays, however short, long, deep or frequent.

Null and empty pages have an empty text. A null url belongs to the host ''. Pages are whole, of any length and depth; reading
takes time in proportion to it, also where tags are cut off or never closed. A quote opens an attribute's value only right after "="; from the first tag on whose quotes never close, a
tag ends at its first ">". Of equally good containers the first counts. Repeated rows vote alike, rows of equal page_id
are told apart by nothing and all return, an empty table gives no rows, and extra columns are ignored."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import materialize, pick, sliced

# Names of elements and of classes, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
CUT_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset head object canvas audio video".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
PREMIUM = {"article": 3.0, "main": 2.0, "body": 0.25, "section": 1.2}
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion discussions disqus"
    " feedback footer gdpr guestbook header masthead menu menubar nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion"
    " reactions related remarks replies reply respond sharing share sidebar side-bar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert".split()
)
#: Words that say where or how something stands, not what it is.
LAYOUT_WORDS = frozenset(
    "area bar bottom box block button buttons column container content floating group icons inline inner item items label layer left line link links list main"
    " outer overlay page panel post posts primary reader right row secondary section site slot sticky sub the thread top trail unit user visitor wrap wrapper".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: A start tag of the key, if an element of the value is open, ends that element first.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Ends of scope: an implied end doesn't reach beyond these.
SCOPES = frozenset("article aside body button details div footer form header main nav section table td th ul ol dl blockquote html".split())

_TOKEN = re.compile(r"<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)")
#: A quote opens a value only right after "=".
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Only these attributes matter here.
_NAMED = re.compile("class|id|role|hidden", re.I)
_BLANKS = re.compile(r"[\s\x85\xa0]+")
_WORD = re.compile(r"[a-z]+(?:-bar)?")
#: How an element is cut: not, if links make up half of it, unless it holds an h1, always.
NOT, IF_LINKS, UNLESS_TITLE, ALWAYS = range(4)


def _cut_rule(tag: str, attributes: dict[str, str]) -> int:
    if tag in CUT_TAGS and tag != "header" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return ALWAYS
    if attributes.get("role", "").lower() in CUT_ROLES:
        return ALWAYS
    rule = NOT
    if attributes and tag not in ("html", "body", "main"):
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
            words = _WORD.findall(name)
            cut = [w for w in words if w in CUT_WORDS]
            if not cut or tag == "article" and not {"comment", "comments"} & set(cut):
                continue
            whole = len(cut) > 1 or all(w in CUT_WORDS or w in LAYOUT_WORDS or len(w) == 1 for w in words)
            rule = max(rule, UNLESS_TITLE if whole and tag != "p" else IF_LINKS)
    return max(rule, UNLESS_TITLE) if tag == "header" else rule


def _name(tag: str, attributes: dict[str, str]) -> str:
    if "class" not in attributes:
        return tag.replace("/", "_")
    classes = sorted({c for x in attributes.get("class", "").lower().split() if (c := re.sub(r"\d+", "", x).strip("-_"))})
    return (tag + "".join(f".{c}" for c in classes)).replace("/", "_")


class Page:
    """A page's elements, in page order, as lists; element 0 is the page. `pieces` has (element, text), and (-1, "") where a
    block begins or ends. An element's path is a number that stands for its parent's path and its own name."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.path, self.rule = [""], [0], [0], [NOT]
        self.paths: dict[tuple[int, str], int] = {}
        self.pieces: list[tuple[int, str]] = []
        self._open = [0]
        self._open_by_tag: dict[str, list[int]] = {}
        self._open_scopes: list[int] = []
        self._parse(html or "")
        self._weigh()

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            tag = self.tag[self._open.pop()]
            self._open_by_tag[tag].pop()
            if tag in SCOPES:
                self._open_scopes.pop()

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        up = self._open[-1]
        key = self.path[up], _name(tag, attributes)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.parent.append(up)
        self.tag.append(tag)
        self.rule.append(_cut_rule(tag, attributes))
        self._open_by_tag.setdefault(tag, []).append(len(self._open))
        if tag in SCOPES:
            self._open_scopes.append(len(self._open))
        self._open.append(len(self.tag) - 1)

    def _nearest(self, *tags: str) -> int:
        """The depth of the innermost open element of these tags, 0 without one."""
        return max([0, *[at[-1] for t in tags if (at := self._open_by_tag.get(t))]])

    def _parse(self, page: str) -> None:
        at, size, quotes = 0, len(page), True
        pieces, scopes = self.pieces, self._open_scopes
        while at < size:
            m = _TOKEN.search(page, at)
            if not m:
                pieces.append((self._open[-1], page[at:]))
                return
            if m.start() > at:
                pieces.append((self._open[-1], page[at : m.start()]))
            opener = m[0]
            if opener == "<!--":
                end = page.find("-->", m.end())
                at = size if end < 0 else end + 3
                continue
            close = page.find(">", m.end())
            if close < 0:  # a tag that never ends is markup to the end of the page
                return
            if opener in ("<!", "<?"):
                at = close + 1
                continue
            tag = m[2].lower()
            if quotes:
                end = _tag_end(page, m.end())
                quotes = end >= 0
                close = end if quotes else close
            inside = page[m.end() : close]
            at = close + 1
            if m[1]:
                depth = self._nearest(tag)
                if depth and (tag in SCOPES or not scopes or depth > scopes[-1]):
                    self._close(depth)
                if tag in BLOCKS:
                    pieces.append((-1, ""))
                continue
            implied = CLOSES.get(tag)
            if implied:
                depth = self._nearest(*implied)
                if depth and (not scopes or depth >= scopes[-1]):
                    self._close(depth)
            if tag in BLOCKS:
                pieces.append((-1, ""))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                if not end:
                    return
                close = page.find(">", end.end())
                at = size if close < 0 else close + 1
                continue
            if tag == "body" and self.tag[self._open[-1]] == "head":
                self._close(len(self._open) - 1)
            self._start(tag, {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(inside)} if _NAMED.search(inside) else {})

    def _weigh(self) -> None:
        """Which elements are cut, and what containers hold: one pass down, one up, and again for what isn't cut."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        own = [0] * n
        for node, text in self.pieces:
            if node >= 0 and not text.isspace():
                own[node] += len(text) - text.count(" ")
        titled = [t == "h1" for t in tag]
        # An article's or main element's first heading is its title, of any level.
        inside, headed = [0] * n, set()
        for i in range(1, n):
            inside[i] = i if tag[i] in ("article", "main") else inside[parent[i]]
            if tag[i] in HEADINGS and inside[i] and inside[i] not in headed:
                headed.add(inside[i])
                titled[i] = True
        link = [t == "a" for t in tag]
        cut = [rule == ALWAYS for rule in self.rule]
        for i in range(1, n):
            up = parent[i]
            cut[i] = cut[i] or cut[up]
            link[i] = link[i] or link[up]
        total = [0 if c else o for c, o in zip(cut, own, strict=True)]
        linked = [t if x else 0 for t, x in zip(total, link, strict=True)]
        for i in range(n - 1, 0, -1):
            up = parent[i]
            total[up] += total[i]
            linked[up] += linked[i]
            titled[up] = titled[up] or titled[i]
        hard, rest = cut, self.rule
        for by_name in (True, False):
            cut = list(hard)
            for i in range(1, n):
                rule = rest[i]
                if cut[parent[i]]:
                    cut[i] = True
                elif tag[i] == "header":
                    cut[i] = cut[i] or not titled[i] or tag[parent[i]] in ("", "html", "body")
                elif by_name and rule == UNLESS_TITLE:
                    cut[i] = cut[i] or not titled[i]
                elif by_name and rule == IF_LINKS:
                    cut[i] = cut[i] or not titled[i] and 2 * linked[i] >= total[i]
            if any(o and not c for o, c in zip(own, cut, strict=True)):
                break
        self.cut = cut
        # The nearest container gets all of a text, those above a share: a wrapper must not win by size.
        nearest = [0] * n
        self.near, whole, linked = [0] * n, [0 if c else o for c, o in zip(cut, own, strict=True)], [0] * n
        for i in range(1, n):
            nearest[i] = i if tag[i] in CONTAINERS else nearest[parent[i]]
            self.near[nearest[i]] += whole[i]
            linked[i] = whole[i] if link[i] else 0
        # Of the articles within an element only the longest counts for it, as many are a list of other pages.
        longest = [0] * n
        for i in range(n - 1, 0, -1):
            whole[i] += longest[i]
            if tag[i] == "article":
                longest[parent[i]] = max(longest[parent[i]], whole[i])
            else:
                whole[parent[i]] += whole[i]
                linked[parent[i]] += linked[i]
        #: By path: what the best of its containers scores. Many small ones on a path are a list, which no article is.
        self.scores: dict[int, float] = {}
        for i in range(1, n):
            if whole[i] and tag[i] in CONTAINERS:
                score = (self.near[i] + 0.7 * (whole[i] - self.near[i]) - 1.5 * linked[i]) * PREMIUM.get(tag[i], 1.0)
                self.scores[self.path[i]] = max(self.scores.get(self.path[i], score), score)

    def named(self, path: int) -> str:
        """A path's names."""
        keys = list(self.paths)
        names = []
        while path:
            path, name = keys[path - 1]
            names.append(name)
        return "".join(f"/{x}" for x in reversed(names))

    def numbered(self, names: str) -> int:
        """The number of a path given by names, 0 if the page doesn't have it."""
        path = 0
        for name in names.split("/")[1:]:
            path = self.paths.get((path, name), 0)
            if not path:
                break
        return path

    def best(self) -> int:
        """The path of the best container, the first of equals; 0 without text."""
        best = max(self.scores, key=self.scores.__getitem__, default=0)
        return best if best and self.scores[best] > 0 else 0

    def text(self, path: int) -> str:
        inside = [False] * len(self.tag)
        for i in range(1, len(inside)):
            inside[i] = not self.cut[i] and (inside[self.parent[i]] or self.path[i] == path)
        blocks, now = [], []
        for node, text in [*self.pieces, (-1, "")]:
            if node < 0:
                if now:
                    text = _BLANKS.sub(" ", "".join(now)).strip(" ")
                    if text:
                        blocks.append(text)
                    now = []
            elif inside[node]:
                now.append(_html.unescape(text) if "&" in text else text)
        return "\n".join(blocks)


def _tag_end(page: str, at: int) -> int:
    """Where the tag's ">" outside quotes stands, -1 if nowhere."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            break
    return -1


def best_path(html: str | None) -> tuple[str, float]:
    """The generalised path of a page's best container, and its score; ("", 0) without text."""
    page = Page(html)
    path = page.best()
    return (page.named(path), page.scores[path]) if path else ("", 0.0)


def _is_article(names: str) -> bool:
    return names.rpartition("/")[2].partition(".")[0] in ("article", "main")


def extract(html: str | None, path: str | None) -> str:
    """The text in the containers on `path`, or in the page's own best one: without any on the path, and where the own is an
    article and the other is none and scores less than a quarter of it."""
    page = Page(html)
    best, known = page.best(), page.numbered(path or "")
    score = page.scores.get(known)
    if not known or score is None:
        return page.text(best) if best else ""
    if best and best != known and 4 * score < page.scores[best] and _is_article(page.named(best)) and not _is_article(path):
        known = best
    return page.text(known)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n, score: how many pages of a host chose a path. pages: host, html."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            found = [best_path(p) for p in pick(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pick(batch, "host"), pa.array([p for p, _ in found]), pa.array([float(s) for _, s in found], pa.float64())], ["host", "path", "score"])

    found = pages.mapInArrow(run, "host string, path string, score double").where("path != ''")
    return found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, then the higher score (to whole points), then the smaller path."""
    order = F.struct("n", F.round("score").alias("score"))
    best = counted.groupBy("host").agg(F.max(order).alias("best"))
    return counted.join(best, "host").where((F.col("n") == F.col("best.n")) & (F.round("score") == F.col("best.score"))).groupBy("host").agg(F.min("path").alias("path"))


def extract_main_text(pages: DataFrame, salts: int = 128, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars. The hosts' paths are counted and measured first.
    Up to `broadcast_bytes` of them go to all machines, and no page is shuffled; more are joined, pages being dealt by host
    and a salt, so that a host with a third of all pages is spread over `salts` groups. Both give the same rows."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    paths = materialize(winners(votes(own.select("host", "html"))), "host-paths")
    size = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        joined = own.join(F.broadcast(paths), "host", "left")
    else:
        salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        joined = salted.join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [extract(p, path) for p, path in zip(pick(batch, "html").to_pylist(), pick(batch, "path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pick(batch, "page_id"), pick(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
