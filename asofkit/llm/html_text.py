"""Main text of web pages: nearest-URL page differencing.

Pages of a host are put in the order of their URL paths, and each is paired with the neighbour
that shares more leading path segments (pages with the same lines count once, so a copy is never a
page's own partner). Both pages' text lines are aligned by longest common subsequence; lines that
the two share are the site's template and go. That holds at the edges of an article element too,
where a run of two or more shared lines goes on from outside of it; a shared line among lines of the page's own
is something that both articles say, and stays. A partner whose article is for the most part the
same tells nothing about this page's own lines. Markup settles what
comparison cannot see: elements that are no article by their meaning (navigation, header, footer,
aside, form, script, advert, comments) go even if their words differ from page to page. Where
class words contradict each other, the comparison decides. Where an ``article`` or ``main`` element
exists, the text outside it is not the article.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank
from .scratch import Scratch, cut, release

# No part may run past a "<", so that a page of unclosed tags is scanned once.
TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/><]*)(?P<attrs>(?:[^><"']++|"[^"]*"|'[^']*')*+)>)""", re.S)
ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# HTML elements by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "math", "select", "xmp", "noembed", "noframes"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "search", "audio", "video", "canvas"}
CONTENT = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "rp", "rt", "ruby"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
# Words of class and id attributes that name such parts.
CHROME_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
                "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent",
                "gdpr", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social",
                "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "widget", "toolbar", "pagination", "pager", "copyright"}


AD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner"}
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
CONTENT_WORDS = {"content", "article", "post", "entry", "body", "main", "story", "text", "page"}
# Elements that stay what they are around an article; others of CHROME may wrap a whole page.
STRONG = {"aside", "nav", "footer", "menu", "head"}
ARTICLE, PLAIN, CHROME_PART, DOUBTFUL = 2, 1, 0, 3


def _kind(name: str, attrs: str) -> tuple[int, bool] | None:
    """(part, strong) of an element that is no article by its name or attributes, or may be none."""
    found: tuple[int, bool] | None = (CHROME_PART, name in STRONG) if name in CHROME else None
    if name in ("html", "body") or "=" not in attrs:
        return found
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in CHROME_ROLES or key == "aria-hidden" and value == "true":
            found = found or (CHROME_PART, False)
        if key not in ("class", "id"):
            continue
        tokens = [set(re.split(r"[^a-z0-9]+", t)) for t in value.split() if not t.startswith(("no-", "without-", "has-", "with-"))]
        if any(COMMENT_WORDS & t for t in tokens):
            return CHROME_PART, True
        if found is None and name not in CONTENT and any(AD_WORDS & t for t in tokens):  # whatever else it is called
            found = (CHROME_PART, False)
        bad = any(CHROME_WORDS & t for t in tokens)
        good = any(CONTENT_WORDS & t and not CHROME_WORDS & t for t in tokens)
        if bad and found is None and name not in CONTENT:
            found = (DOUBTFUL if good else CHROME_PART, False)
    return found


def _tags(page: str) -> list[tuple[int, int, str, str, str, str | None]]:
    """(start, end, name, close, attrs, cdata) of each tag; raw elements are one tag with their content."""
    out, at, n = [], 0, len(page)
    ends: dict[str, re.Pattern] = {}
    while at < n and (m := TAG.search(page, at)):
        name, end = (m["name"] or "").lower(), m.end()
        if name in RAW and not m["close"] and not m["attrs"].endswith("/"):
            if name not in ends:
                ends[name] = re.compile(rf"</{re.escape(name)}\s*>", re.I)
            last = ends[name].search(page, end)
            end = last.end() if last else n
        out.append((m.start(), end, name, m["close"] or "", m["attrs"] or "", m["cdata"]))
        at = end
    return out


def _closes(tags: list) -> tuple[dict[int, int], dict[int, int]]:
    """(closing tag of each opening one, and the other way), by name, the last open one first."""
    open_: dict[str, list[int]] = defaultdict(list)
    match: dict[int, int] = {}
    for i, (_, _, name, close, attrs, _) in enumerate(tags):
        if not name or name in VOID or name in RAW:
            continue
        if not close:
            if not attrs.endswith("/"):
                open_[name].append(i)
        elif open_[name]:
            match[open_[name].pop()] = i
    return match, {j: i for i, j in match.items()}


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, part) of each block in page order; part is CHROME_PART, PLAIN, ARTICLE or DOUBTFUL."""
    page = page or ""
    tags = _tags(page)
    match, opener = _closes(tags)
    out: list[tuple[str, int]] = []
    text: list[str] = []
    regions: list[tuple[int | None, int, bool, int]] = []  # (closing tag, part, strong, opening tag)
    articles: list[int | None] = []  # closing tags of open article elements
    at = 0

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            parts = {r[1] for r in regions}
            out.append((line, CHROME_PART if CHROME_PART in parts else DOUBTFUL if DOUBTFUL in parts and articles else ARTICLE if articles else DOUBTFUL if DOUBTFUL in parts else PLAIN))

    for i, (start, end, name, close, attrs, cdata) in enumerate(tags):
        text.append(page[at:start])
        at = end
        if cdata is not None:
            text.append(html.escape(cdata))
        if not name or name in RAW:
            continue
        kind = None if close or name in VOID else _kind(name, attrs)
        over = [r for r in regions if r[0] == i or r[0] is None and (
            close and i in opener and opener[i] < r[3] or not close and name == tags[r[3]][2] and name in ("p", "li") or not close and name in CONTENT)]
        content = name in CONTENT and not close and not (kind and kind[0] == CHROME_PART)
        if content:  # what may wrap a page ends where the article begins
            over += [r for r in regions if not r[2] and r not in over]
        if name not in INLINE or kind or over:
            flush()
        elif name == "br":
            text.append(" ")
        if over:
            regions = [r for r in regions if r not in over]
        if close and name in CONTENT and articles:
            articles = [j for j in articles if j != i] if i in articles else articles[:-1] if i not in opener else articles
        if content and not any(r[1] == CHROME_PART for r in regions):
            articles.append(match.get(i))
        if kind and not attrs.endswith("/"):
            regions.append((match.get(i), *kind, i))
    text.append(page[at:])
    flush()
    return out


def _lengths(x: list, y: list) -> int:
    """Bits of y: the zeros among the low j ones count the longest common subsequence of x with y[:j] (bit-parallel)."""
    where: dict = defaultdict(int)
    for j, v in enumerate(y):
        where[v] |= 1 << j
    full = (1 << len(y)) - 1
    v = full
    for item in x:
        u = v & where.get(item, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _subsequence(x: list, y: list, shift: int, found: set[int]) -> None:
    """Indexes of x, plus ``shift``, in a longest common subsequence; halves x, so memory stays linear."""
    common = set(x) & set(y)
    if not common:
        return
    if len(x) == 1:
        found.add(shift)
        return
    keep = [j for j, v in enumerate(y) if v in common]
    y, half = [y[j] for j in keep], len(x) // 2
    ahead, behind = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
    best, cut, n = -1, 0, len(y)
    left, right = 0, n - behind.bit_count()
    for j in range(n + 1):  # left: with y[:j]; right: with y[j:]
        if left + right > best:
            best, cut = left + right, j
        if j < n:
            left += not ahead >> j & 1
            right -= not behind >> (n - 1 - j) & 1
    _subsequence(x[:half], y[:cut], shift, found)
    _subsequence(x[half:], y[cut:], shift + half, found)


def shared_lines(a: list, b: list) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence of both."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    _subsequence(a[lo : len(a) - hi], b[lo : len(b) - hi], lo, found)
    return found


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The article without the template; a page without an article element gives its unmarked lines that are not shared."""
    own = {i for i, (_, part) in enumerate(lines) if part == ARTICLE}
    size = lambda rows: sum(len(lines[i][0]) for i in rows)
    if own:
        inside = own & shared
        if 2 * size(inside) > size(own):  # the partner is a copy
            inside = set()
        edge: set[int] = set()
        for step in (1, -1):  # shared lines that follow shared lines outside of the article, from either side
            run = 0
            for i in range(len(lines))[::step]:
                run = run + 1 if i in shared and (i not in own or run >= 2 and i in inside) else 0
                if run and i in own:
                    edge.add(i)
        shared = shared - own | edge
    keep = (ARTICLE, DOUBTFUL) if own else (PLAIN, DOUBTFUL)
    return "\n".join(t for i, (t, part) in enumerate(lines) if part in keep and i not in shared)


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [[_hash(t) for t, _ in lines_of(x)] for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hk"), b.column("host"), b.column("path"), pa.array(lines, pa.list_(pa.int64()))],
                                         names=["id", "hk", "host", "path", "lines"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page, partner in zip(b.column("html").to_pylist(), b.column("partner").to_pylist()):
            lines = lines_of(page)
            out.append(main_text(lines, shared_lines([_hash(t) for t, _ in lines], partner) if partner else set()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a newline; a page without article text has empty text. Null html is empty; null or
    malformed URLs form a host of their own; a page without a different page on its host has no
    partner and keeps its unmarked lines. Ties in the URL are ordered by identifier and lines.
    An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    url = F.coalesce(F.col(url_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                     F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                     F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
                     F.xxhash64(url, F.coalesce(F.col(html_col), F.lit(""))).alias("hk"))
    seen = scratch.save(p.select("id", "hk", "host", "path", "html").mapInArrow(
        _signatures, "id bigint, hk bigint, host string, path string, lines array<bigint>").withColumn("sig", F.xxhash64("lines")), "signatures", compression="zstd")
    # Pages of a host with the same lines are one page here.
    kinds = seen.groupBy("host", "sig").agg(F.min(F.struct("path", "id")).alias("first"))
    ranked = cut(global_rank(kinds.select("host", "sig", F.col("first.path").alias("path"), F.col("first.id").alias("id")),
                             [F.col("host"), F.col("path"), F.col("id"), F.col("sig")], "rank").select("host", "sig", "path", "rank"))
    end = lambda shift, at: ranked.select("host", (F.col("rank") + shift).alias("rank"), F.struct("sig", "path").alias(at))
    pairs = ranked.join(end(1, "prev"), ["host", "rank"], "left").join(end(-1, "next"), ["host", "rank"], "left")
    near = lambda at: F.expr(f"size(filter(sequence(1, least(size(split(path, '/')), size(split({at}.path, '/')))), i -> slice(split(path, '/'), 1, i) = slice(split({at}.path, '/'), 1, i)))")
    pairs = pairs.select("host", "sig", F.when(near("next") > near("prev"), F.col("next.sig")).otherwise(F.coalesce("prev.sig", "next.sig")).alias("near"))
    lines = seen.groupBy("host", F.col("sig").alias("near")).agg(F.first("lines").alias("partner"))
    partners = (seen.select("id", "hk", "host", "sig").dropDuplicates(["id", "hk"]).join(pairs, ["host", "sig"])
                .join(lines, ["host", "near"], "left").select(F.col("id").alias("i"), F.col("hk").alias("k"), "partner"))
    partners = scratch.save(partners, "partners", compression="zstd")
    scratch.drop("signatures")
    release(spark)
    out = (p.join(partners.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("hk") == F.col("k")))
           .select("id", "url", "html", "partner").mapInArrow(_texts, "id bigint, url string, text string"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
