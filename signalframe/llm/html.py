"""Main text of web pages: what recurs on a host's pages and what is marked as page furniture goes."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "math")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag that closes an open element of its kind, up to the nearest of the second set.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROP = frozenset("head nav footer aside script style noscript template iframe svg math button select textarea dialog menu object canvas audio video".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notices|newsletter|subscribe|subscription|signup|popup|modal|overlay|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|related|recommended|share|sharing|social|widget|pagination|pager|skip-link|print-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.IGNORECASE)
_NEVER_TEMPLATE = frozenset(("html", "body", "article", "main", ""))


class _Node:
    __slots__ = ("content", "drop", "holds", "in_article", "inside", "mark", "role", "start", "tag", "wrapper")

    def __init__(self, tag: str, mark: str, drop: bool, role: str, start: int, inside: bool, in_article: bool, wrapper: bool):
        self.tag, self.mark, self.drop, self.role, self.start, self.inside, self.in_article, self.content = tag, mark, drop, role, start, inside, in_article, []
        self.wrapper, self.holds = wrapper, False  # dropped unless it is a wrapper; encloses an article or main


class Page:
    """One page: ``subtrees`` are the hashes of its elements that hold text, ``text`` its main text.

    The body of a page is its articles, or else its main, or else all of it. Hashes of subtrees that share text with the
    body are odd, others even. A class, a role or a form doesn't drop an element that encloses an article or main, nor,
    on a page with neither, the outermost elements when all text stands in such.
    """

    def __init__(self, source: str, hashes: bool = True):
        self.out: list[str] = []
        self.hashes = hashes
        self.closed: list[tuple[int, int, int, bool]] = []  # start, end, hash, marked as furniture
        self.wrappers: list[tuple[int, int]] = []  # those of closed that may be wrappers
        self.mains: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.stack = [_Node("", "", False, "", 0, False, False, False)]
        self.open: dict[str, list[int]] = {}  # places in the stack by tag, and of all elements that aren't inline
        self.blocks = [0]
        at, find = 0, _TOKEN.search
        while m := find(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name:
                name = name.lower()
                if m[1] or m[4]:
                    self._end(name)
                else:
                    attrs = m[3] or m[6] or ""
                    self._start(name, attrs)
                    if name in _RAW and not attrs.endswith("/"):
                        at = _RAW[name].search(source, at).end()
                        self._end(name)
            elif m[0].startswith("<![CDATA["):
                self._text(entities.escape(m[0][9:].removesuffix("]]>")))
        if at < len(source):
            self._text(source[at:])
        while self.stack:
            self._pop()
        for spans in self.mains.values():  # those in dropped elements aren't the page's
            spans[:] = [(a, b) for a, b in spans if not any(drop and start <= a and b <= end for start, end, _, drop in self.closed)]
        if self.wrappers and not self.mains["article"] and not self.mains["main"]:
            self._unwrap()

    def _unwrap(self) -> None:
        """Keep the outermost marked elements as long as all text stands in marked ones."""
        marked = set(self.wrappers)
        while marked:
            gone = bytearray(len(self.out))
            for a, b, _, drop in self.closed:
                if drop:
                    gone[a:b] = b"\1" * (b - a)
            if any(not g and t.strip() for g, t in zip(gone, self.out, strict=True)):
                return
            hard = [(a, b) for a, b, _, drop in self.closed if drop and (a, b) not in marked]
            outer, end = set(), -1
            for a, b in sorted(marked, key=lambda x: (x[0], -x[1])):
                if a >= end:
                    outer.add((a, b))
                    end = b
            marked -= outer
            self.closed = [(a, b, v, drop and ((a, b) in marked or (a, b) in hard)) for a, b, v, drop in self.closed]

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.out.append(text)
        if self.hashes and (words := text.split()):
            self.stack[-1].content.append(" ".join(words))

    def _start(self, name: str, attrs: str) -> None:
        stack = self.stack
        if name in _ENDS_P:
            self._close({"p"}, {"button", "td", "th", "table", "body", "article", "main", "section", "div", "li"} if name != "p" else {"button", "td", "th", "table"})
        elif name in _SIBLINGS:
            self._close(*_SIBLINGS[name])
        if name not in _INLINE:
            self.out.append(" ")
        if name in _VOID:
            return
        mark = role = ""
        inside, in_article, wrapper = stack[-1].inside, stack[-1].in_article, name == "form"
        drop = name in _DROP or (name == "header" and not inside)
        if attrs and not attrs.isspace():
            own = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)}
            role = own.get("role", "").strip().lower()
            mark = f"{own.get('class', '')} {own.get('id', '')}".strip()
            href = own.get("href", "")
            if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
                drop = True
            elif role in _DROP_ROLE:
                wrapper = True
            elif mark and name not in ("html", "body", "main") and role != "main" and (_FURNITURE.search(mark) or (not inside and _HEADER.search(mark))):
                wrapper = True
            mark = f"{mark} {href}" if href else mark
        if in_article or name == "article":  # what it encloses isn't the page
            drop, wrapper = drop or wrapper, False
        self.open.setdefault(name, []).append(len(stack))
        if name not in _INLINE:
            self.blocks.append(len(stack))
        stack.append(_Node(name, mark, drop, role, len(self.out), inside or name in ("article", "main") or role == "main", in_article or name == "article", wrapper and not drop))

    def _last(self, names: set) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _close(self, names: set, stop: set) -> None:
        at = self._last(names)
        if at > self._last(stop):
            while len(self.stack) > at:
                self._pop()

    def _end(self, name: str) -> None:
        at = self._last({name})
        if at and (name not in _INLINE or at > self.blocks[-1]):
            while len(self.stack) > at:
                self._pop()
        if name not in _INLINE:
            self.out.append(" ")

    def _pop(self) -> None:
        node = self.stack.pop()
        end, tag = len(self.out), node.tag
        if self.stack:
            self.open[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
        value = 0
        if self.hashes and node.content:
            value = xxhash.xxh3_64_intdigest("\x1f".join([tag, node.mark, *node.content]))
            if self.stack:
                self.stack[-1].content.append(f"{value:x}")
        if node.wrapper and not node.holds:
            node.drop = True
            self.wrappers.append((node.start, end))
        if node.drop or (value and tag not in _NEVER_TEMPLATE):
            self.closed.append((node.start, end, value if tag not in _NEVER_TEMPLATE else 0, node.drop))
        kind = "article" if tag == "article" else "main" if tag == "main" or node.role == "main" else ""
        if kind and not node.drop:
            self.mains[kind].append((node.start, end))
        if self.stack and not node.drop and (kind or node.holds):
            self.stack[-1].holds = True

    def _body(self) -> tuple[list[tuple[int, int]], bytearray, bytearray]:
        """The spans of the body, and for each piece of text whether it is in the body and whether it is dropped."""
        spans = self.mains["article"] or self.mains["main"] or [(0, len(self.out))]
        keep, gone = bytearray(len(self.out)), bytearray(len(self.out))
        for a, b in spans:
            keep[a:b] = b"\1" * (b - a)
        for a, b, _, drop in self.closed:
            if drop:
                gone[a:b] = b"\1" * (b - a)
        if self.mains["article"] and not any(k and not g and t.strip() for k, g, t in zip(keep, gone, self.out, strict=True)):
            spans, keep = [(0, len(self.out))], bytearray(b"\1" * len(self.out))  # the article itself stands in furniture: the rest of the page counts
        return spans, keep, gone

    def _joined(self, keep: bytearray, gone: bytearray) -> str:
        return " ".join("".join([t if not g else " " for t, k, g in zip(self.out, keep, gone, strict=True) if k]).split())

    @staticmethod
    def _in(spans: list[tuple[int, int]], a: int, b: int) -> bool:
        return any(a < end and b > start for start, end in spans)

    def subtrees(self) -> tuple[int, set[int]]:
        """A hash of the body's text, and the hashes of the elements that hold text."""
        spans, keep, gone = self._body()
        return xxhash.xxh3_64_intdigest(self._joined(keep, gone)), {v & ~1 | self._in(spans, a, b) for a, b, v, _ in self.closed if v}

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        spans, keep, gone = self._body()
        if templates:
            marked = bool(self.mains["article"] or self.mains["main"])
            for a, b, v, _ in self.closed:
                if v and (v & ~1 | self._in(spans, a, b) in templates or (not marked and v & ~1 in templates)):
                    gone[a:b] = b"\1" * (b - a)
        return self._joined(keep, gone)


def _host(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


#: Hashes of templates that are sent to every task at most; beyond it they are joined.
BROADCAST_HASHES = 500_000


def host_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.5, around_pages: int = 3, around_share: float = 0.05) -> DataFrame:
    """Rows (host, templates): the subtrees that stand on ``min_pages`` pages and ``min_share`` of the pages of a host.

    Around the body ``around_pages`` and ``around_share`` are enough, as a menu's entries change from section to section
    and nothing of an article stands there; what is a template so goes from pages without a marked body, too. Pages with the same body count once for the subtrees in it, among the host's different bodies: copies of an article
    don't make a template of its text. As each takes its share, a host has at most 1 / around_share times the subtrees of
    its average page. Counts are summed before they are shuffled, so a host with a third of all pages is no hot key.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for batch in batches:
            hosts, values, bodies = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, own = Page(html.as_py() or "").subtrees()
                hosts += [host] * (len(own) + 2)
                values += [0, 1, *map(signed, own)]  # 0 and 1 count the pages and their bodies
                bodies += [0, signed(body), *(signed(body) if v & 1 else 0 for v in own)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(values, pa.int64()), pa.array(bodies, pa.int64())], ["host", "hash", "body"])

    rows = pages.select(_host("url").alias("host"), "html").mapInArrow(hashes, "host string, hash long, body long")
    odd = F.col("hash").bitwiseAND(1)
    once = rows.groupBy("host", "hash", "body").agg(F.count(F.lit(1)).alias("n"))
    counts = once.groupBy("host", "hash").agg(F.sum(F.when(odd == 1, F.lit(1)).otherwise(F.col("n"))).alias("n"))
    least, share = F.when(odd == 1, F.lit(min_pages)).otherwise(F.lit(around_pages)), F.when(odd == 1, F.lit(min_share)).otherwise(F.lit(around_share))
    counts = written(counts.filter((F.col("n") >= least) | F.col("hash").isin(0, 1)), "html-counts").withColumn("kind", odd)
    own = counts.filter("hash in (0, 1)").select("host", "kind", F.col("n").alias("pages"))
    return counts.filter(~F.col("hash").isin(0, 1) & (F.col("n") >= least)).join(own, ["host", "kind"]).filter(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def main_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.5, around_pages: int = 3, around_share: float = 0.05) -> DataFrame:
    """Rows (page_id, url, text, n_chars).

    The first pass hashes each element's subtree and counts on how many pages of its host it stands, in the body on how
    many different bodies; the second deletes the subtrees that recur and those marked as furniture by tag, role or class, and takes the article, or else main, or
    else all that is left. Character references are decoded; blocks are joined by one space; nothing is cut off.
    Null or empty html gives an empty text; a null url is a host of its own; repeated rows stay; very long pages count in
    full; other columns, of whatever names, are not looked at; no rows give no rows.
    """
    rows = pages.select("page_id", "url", _host("url").alias("host"), "html")
    templates = written(host_templates(pages, min_pages, min_share, around_pages, around_share), "html-templates")
    total = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("n")).first()["n"]
    rows = rows.join(F.broadcast(templates) if total <= BROADCAST_HASHES else templates, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, html, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if host not in sets:
                    if len(sets) > 5000:
                        sets.clear()
                    sets[host] = frozenset(v & (1 << 64) - 1 for v in own.as_py() or ())
                texts.append(Page(html.as_py() or "", bool(sets[host])).text(sets[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "templates").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
