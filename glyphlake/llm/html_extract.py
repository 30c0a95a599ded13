"""Main text of web pages with a site style tree.

First pass: every page is parsed into elements, each known by the hashes of its path of tags,
classes and ids.  Per page and path it reports the page's presentation there (the sequence of child
tags) and the content (its blocks of text), as hashes.  The tree has LEVELS levels; what lies deeper
counts for the element at the last of them, so no nesting makes a page large.  Merged over the pages of a host this is the site style
tree.  The importance of a path is the entropy of its presentations, and for content 1 minus the
mean entropy of its blocks over the pages; a branch combines its paths, weighted down by depth.
All of this is grouped counts, combined map-side, so a hot host is spread by path and content.

Second pass: each page drops what its markup declares not to be the article, then the branches of
low importance, and joins the blocks that are left.  A branch is only pruned if the host's pages
differ elsewhere: where they are copies of one page nothing tells template and article apart.
Article and main parts are a prior: inside them it takes a lower importance to prune a branch, and
what stands outside goes only where they hold most of the text that is left.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: A branch below this importance is template.
MIN_IMPORTANCE = 0.2
#: Pages of a host that must have a branch before it can be pruned.
MIN_PAGES = 10
#: Share of that importance below which a branch inside an article or main part is template.
INSIDE_SHARE = 0.5
#: Weight of a path in its ancestor's importance, for each level between them.
DECAY = 0.9
#: Levels of the tree; deeper elements belong to their ancestor there.
LEVELS = 64
#: Pruned branches, of 16 bytes each, that are broadcast; more are joined by host.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
#: For pages where a quotation mark is never closed: a tag ends at the first bracket.
_PLAIN_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>()()()|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_MASK = (1 << 64) - 1
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag closes if open: the closed ones, and what the search does not cross.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",))}
_NOT_TEXT = frozenset("head nav footer aside form button select dialog menu search object datalist".split())
_NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login comment comments commentlist replies disqus social share sharing related recommended toolbar pagination pager masthead".split()
)
#: Words that say nothing about a part, beside one that does: ``ad-slot``, ``site-nav``, ``cookie-banner``.
_NEUTRAL_WORDS = frozenset("area bar block bottom box btn button buttons container content global group holder inner item items js left link links list main outer page panel primary right row secondary section site slot sticky thread top unit widget wrap wrapper".split())


def _told(names: str, words: frozenset[str]) -> bool:
    """Whether a class or id is made of ``words``, apart from neutral ones, and not of others too.

    So ``share`` and ``ad-slot`` are told, ``share-price`` and ``social-history`` are not.
    """
    for token in names.split():
        parts = _NAME.findall(token)
        if any(p in words for p in parts) and all(p in words or p in _NOT_TEXT_WORDS or p in _NEUTRAL_WORDS for p in parts):
            return True
    return False


_SITE_WORDS = frozenset({"header", "footer"})
_ASIDE_WORDS = frozenset({"comment", "comments", "ad", "ads", "advert", "promo", "related"})


@dataclass(slots=True)
class _Open:
    """An open element: its path's hashes, whether they may be pruned, its block and what it is in."""

    tag: str
    chain: tuple[int, ...]
    prunable: tuple[int, ...]
    block: tuple[tuple[int, ...], tuple[int, ...]]
    article: bool
    main: bool
    declared: bool


@dataclass(slots=True)
class _Block:
    """A block of text: the path it stands at, those of its branches that may be pruned, and what it is in."""

    chain: tuple[int, ...]
    prunable: tuple[int, ...]
    text: str
    article: bool
    main: bool
    declared: bool


class Page:
    """Blocks of text and, per path, the child tags of one parsed page; linear in its length."""

    def __init__(self, source: str):
        self.blocks: list[_Block] = []
        self.children: dict[tuple[int, ...], list[str]] = {}
        self._stack = [_Open("", (), (), ((), ()), False, False, False)]
        self._places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
        self._held: list[str] = []
        self._parse(source)

    def _flush(self) -> None:
        if self._held:
            text = " ".join(html.unescape("".join(self._held)).split())
            self._held = []
            if text:
                top = self._stack[-1]
                self.blocks.append(_Block(*top.block, text, top.article, top.main, top.declared))

    def _open(self, tag: str, raw: str) -> None:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        up = self._stack[-1]
        article, main = up.article, up.main
        role = found.get("role", "").lower()
        named = names != " "
        declared = tag in _NOT_TEXT or role in _NOT_TEXT_ROLES or (named and _told(names, _NOT_TEXT_WORDS))
        if not article and not main:  # a site's header; an article's own holds its title
            declared = declared or tag == "header" or (named and _told(names, _SITE_WORDS))
        step = tag + "".join(f".{w}" for w in sorted(set(names.split()))) if named else tag
        self.children.setdefault(up.chain, []).append(step)
        # an article or main part stands for itself, unless it is declared to be something else
        if declared and tag in ("body", "html", "article", "main"):
            declared = tag == "article" and _told(names, _ASIDE_WORDS)
        article = article or (tag == "article" and not declared) or found.get("itemprop") == "articleBody"
        main = main or tag == "main" or role == "main"
        chain, prunable = up.chain, up.prunable
        if len(chain) < LEVELS:
            key = xxhash.xxh64_intdigest(step.encode(errors="surrogatepass"), chain[-1] & _MASK if chain else 0) - (1 << 63)
            chain = (*chain, key)
            prunable = prunable if tag in ("html", "body") else (*prunable, key)
        block = (chain, prunable) if tag in _BLOCK else up.block
        self._places[tag].append(len(self._stack))
        self._stack.append(_Open(tag, chain, prunable, block, article, main, up.declared or declared))

    def _cut(self, at: int) -> None:
        """Close the open elements from the place ``at`` on."""
        while len(self._stack) > at:
            self._places[self._stack.pop().tag].pop()

    def _close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close the outermost open element of ``tags`` above the innermost of ``limits``."""
        limit = max((p[-1] for t in limits if (p := self._places[t])), default=0)
        found = [p[i] for t in tags if (p := self._places[t]) and (i := bisect.bisect_right(p, limit)) < len(p)]
        if found:
            self._cut(min(found))

    def _parse(self, source: str) -> None:
        pos, end, token = 0, len(source), _TOKEN
        last = source.rfind(">")
        while pos < end:
            if pos > last:  # no tag ends any more; a comment may be open
                self._held.append(source[pos:].partition("<!--")[0])
                break
            m = token.search(source, pos)
            if m is not None and m[5] is not None and token is _TOKEN:
                # a quotation mark stays open to the end: from here on none of them counts
                token = _PLAIN_TOKEN
            if m is None:
                self._held.append(source[pos:])
                break
            if m.start() > pos:
                self._held.append(source[pos : m.start()])
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in _BLOCK:
                    self._flush()
                if tag == "br":
                    self._held.append(" ")
                elif places := self._places.get(tag):
                    self._cut(places[-1])
                continue
            raw = m[3] or m[6] or ""
            if tag in _RAW:
                close = _RAW_END[tag].search(source, pos)
                pos = close.end() if close else end
                continue
            if tag in _BLOCK:
                self._flush()
                if self._places.get("p"):
                    self._close(("p",), ("td", "th", "article", "div", "section", "li", "blockquote", "button", "object"))
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
            if tag == "br":
                self._held.append(" ")
            elif tag not in _VOID and not raw.endswith("/"):
                self._open(tag, raw)
            elif tag in _VOID:
                self.children.setdefault(self._stack[-1].chain, []).append(tag)
            else:  # a self-closed element of HTML is open, except the void ones above
                self._open(tag, raw[:-1])
        self._flush()

    def text(self, pruned: Mapping[int, float], min_importance: float = MIN_IMPORTANCE, by_tags: bool = True) -> str:
        """The article: declared parts and branches of low importance removed.

        Without ``by_tags`` what the markup declares counts for nothing and the tree decides alone.
        """
        left = []
        for b in self.blocks:
            limit = min_importance * INSIDE_SHARE if by_tags and (b.article or b.main) else min_importance
            if not (by_tags and b.declared) and not (pruned and any(pruned.get(k, 1.0) < limit for k in b.prunable)):
                left.append(b)
        for part in ("article", "main") if by_tags else ():  # an empty or small article does not stand for the page
            inside = sum(len(b.text) for b in left if getattr(b, part))
            if 2 * inside > sum(len(b.text) for b in left):
                left = [b for b in left if getattr(b, part)]
                break
        return "\n\n".join(b.text for b in left)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, value): presentations (0) and blocks (1) of each page, once a page.

    A path is the array of its elements' hashes, the root first.
    """
    for batch in batches:
        hosts, paths, kinds, values = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            seen = {(p, 0, xxhash.xxh64_intdigest(" ".join(c).encode(errors="surrogatepass"))) for p, c in page.children.items()}
            # an element without children has the empty presentation, so a path counts its pages
            seen |= {(b.chain, 0, xxhash.xxh64_intdigest("")) for b in page.blocks if b.chain not in page.children}
            seen |= {(b.chain, 1, xxhash.xxh64_intdigest(b.text.encode(errors="surrogatepass"))) for b in page.blocks}
            for p, k, v in seen:
                hosts.append(host)
                paths.append(p)
                kinds.append(k)
                values.append(v - (1 << 63))
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.list_(pa.int64())), "kind": pa.array(kinds, pa.int32()), "value": pa.array(values, pa.int64())})


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def template_branches(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, branch, importance) of the branches to prune, from the hosts' style trees."""
    seen = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_features, "host string, path array<long>, kind int, value long")
    value = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    # presentations of a path add up to its pages, since a page has one of each path
    node = value.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("n_log_n"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("blocks"),
        F.sum(F.when(F.col("kind") == 1, F.log("n"))).alias("log_n"),
    )
    node = node.withColumn("m", F.coalesce("pages", F.lit(0)))
    # entropy to base m: log m - sum(n log n) / m, over log m; a path of one page is important
    style = F.when(F.col("pages") > 1, (F.log("pages") - F.col("n_log_n") / F.col("pages")) / F.log("pages"))
    content = F.when((F.col("m") > 1) & (F.col("blocks") > 0), 1 - F.col("log_n") / F.col("blocks") / F.log("m"))
    node = node.select("host", "path", "m", F.when(F.col("m") <= 1, F.lit(1.0)).otherwise(F.coalesce(content, style, F.lit(1.0))).alias("importance"))
    # a path counts for itself and, ever less, for the branches above it; the outer form keeps the
    # optimizer from testing the path below the grouping, which would then be done once more
    up = node.select("host", "m", "importance", F.size("path").alias("depth"), F.posexplode_outer("path").alias("level", "branch")).where("branch is not null")
    below = F.col("depth") - 1 - F.col("level")
    weight = F.pow(F.lit(DECAY), below)
    branch = up.groupBy("host", "branch").agg((F.sum(F.col("importance") * weight) / F.sum(weight)).alias("importance"), F.max(F.when(below == 0, F.col("m"))).alias("pages"))
    # a host whose pages differ nowhere shows copies of one page
    host = node.groupBy("host").agg(F.max(F.when(F.col("m") > 1, F.col("importance"))).alias("whole"))
    low = branch.join(host, "host").where((F.col("pages") >= min_pages) & (F.col("importance") < min_importance) & (F.col("whole") >= min_importance))
    return low.select("host", "branch", "importance")


def _extract(min_importance: float, by_tags: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source or "").text({x["branch"]: x["importance"] for x in pruned or ()}, min_importance, by_tags) for source, pruned in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES, by_tags: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored.

    Defined results: a null html is empty and has empty text; pages with a null url or none that
    names a host share the empty host; a null page_id stays null; repeated rows give repeated
    rows.  An empty table gives no rows.  A branch seen on fewer than ``min_pages`` pages of its host
    is kept whatever its importance, as so few pages do not tell template from copies.  Elements
    nested deeper than LEVELS share the fate of their ancestor there.  A quotation mark that a tag
    never closes ends quoting for the rest of the page.  Without ``by_tags`` only the tree decides.
    """
    ws = Workspace(pages.sparkSession, "html")
    low = ws.write(template_branches(pages, min_importance, min_pages), "templates")
    pruned = low.groupBy("host").agg(F.collect_list(F.struct("branch", "importance")).alias("pruned"))  # branches of one host's templates
    pruned = F.broadcast(pruned) if low.count() <= BROADCAST_ROWS else pruned
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    return rows.join(pruned, "host", "left").select("page_id", "url", "html", "pruned").mapInArrow(_extract(min_importance, by_tags), "page_id long, url string, text string, n_chars long")
