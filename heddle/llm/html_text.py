"""Main text of web pages by nearest-URL page differencing.

Each page is cut into lines (blocks of text). Pages of one host are put in the order of their URL paths, and each is paired
with the neighbour that shares more of its path. The lines of a pair are aligned by a longest common subsequence, and shared
lines are deleted, because a site repeats its frame on its pages. Where a page marks its article, and what the marks hold
is most of its text, the mark is trusted over the differences: mirrored articles share all lines, and a frame may differ on
every page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import pick, small_batches, steps, string_hashes
from heddle.session import running_position

# Elements and names that HTML pages use.
SILENT = {
    "script", "style", "iframe", "textarea", "title", "noscript", "template", "svg", "object", "canvas", "audio", "video",
    "annotation", "annotation-xml",
}
CODE = {"script", "style"}
RAW = CODE | {"iframe", "textarea", "title"}
FRAME = {"head", "nav", "footer", "aside", "menu", "form", "dialog", "button", "select", "header"}
ARTICLE = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACING = {"br", "td", "th", "wbr", "option", "img", "input"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
FRAME_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "alert", "aside", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "dropdown",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "sponsors", "subscribe", "subscription", "toc", "toolbar", "widget",
}

REST = r"""(?P<rest>(?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-z][^\s/>]*){REST}|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)
SILENT_TAGS = {name: re.compile(rf"<(?P<close>/?){name}(?=[\s/>]|\Z){REST}", re.S | re.I) for name in SILENT}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")
# Words that turn a name into a statement about something else, as in "no-sidebar".
TURNING = {"no", "not", "non", "without", "with", "has", "have", "is", "hide", "show", "off", "on", "open", "closed", "enabled", "disabled"}
# Frame names that headings use as well: in an id of several words they need a second one.
PLAIN_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "alert", "aside", "banner", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "header", "login", "menu", "navigation", "notice", "notification", "overlay",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "signup", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "widget",
}
IDS_IN_ARTICLE = {"comments", "disqus", "respond", "sidebar", "adsense"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What an opening tag closes where it is still open, what it looks for it through, and what does not close a paragraph.
ITEMS = dict.fromkeys(["li"], {"li"}) | dict.fromkeys(["dd", "dt"], {"dd", "dt"})
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = dict.fromkeys(["td", "th"], {"td", "th"}) | {"tr": {"td", "th", "tr"}} | dict.fromkeys(SECTIONS, {"td", "th", "tr"} | SECTIONS)
LOOSE = {"p", "div", "address"}
IN_P = {"caption", "summary", "tr", *SECTIONS}
KEPT_OPEN = BLOCK | {"td", "th"}

COMMENT_NAMES = {"comment", "comments", "reply", "replies"}
#: How much longer the rest has to be than what a page marks by <main>, which stands for its dominant part, before it is read too.
MAIN_COUNTS = 10

#: Where a line stands: in the page's frame, in no marked part, in the article, in the article by <main>, in the article's frame.
IN_FRAME, OPEN, IN_ARTICLE, IN_MAIN, ASIDE = 0, 1, 2, 3, 4


def closed_itself(rest: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    return rest.endswith("/") and not re.search(r"""=\s*[^\s"']+\Z""", rest)


def after_silent(page: str, name: str, begin: int, odd: dict[str, bool]) -> int:
    """Where a silent element ends whose tag ends at `begin`: behind its own closing tag, or behind the first one where not all
    that are open in it are closed. Without any, code runs to the end of the page, and of others only the tag is dropped.
    `odd` keeps the names that the page does not close in full, and whether it closes them at all, so that each is looked for once."""
    if odd.get(name, True):
        depth, first = 1, -1
        for tag in SILENT_TAGS[name].finditer(page, begin):
            if tag["close"]:
                first = tag.end() if first < 0 else first
                depth -= 1
                if not depth or name in odd:
                    return first if name in odd else tag.end()
            elif name not in RAW and not closed_itself(tag["rest"]):
                depth += 1
        odd[name] = first >= 0
        if first >= 0:
            return first
    return len(page) if name in CODE else begin


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag, names and values in lower case; of several with one name the first."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        if name:
            found.setdefault(name.lower(), (value[1:-1] if value[:1] in ("'", '"') else value).lower())
    return found


def is_frame(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is part of a page's frame, by its name or the names that its author gave it.

    A class counts by any of its words, an id outside articles if the whole is a frame's name or it cannot be that of a
    passage, and in an article only if no passage has it. Headings are told by their classes only."""
    if name in FRAME and not (name == "header" and in_article):
        return True
    if not rest or name in ("html", "body"):
        return False
    marks = attributes(rest)
    if "hidden" in marks and marks["hidden"] != "until-found" or marks.get("aria-hidden") == "true":
        return True
    if not FRAME_ROLES.isdisjoint(marks.get("role", "").split()[:1]) or re.search(r"display\s*:\s*none", marks.get("style", "")):
        return True
    for one in marks.get("class", "").split():
        words = set(re.split(r"[_-]+", one))
        if name in ARTICLE:
            words = words & TURNING | {one.replace("_", "-").split("-")[0]} & COMMENT_NAMES
        if in_article or name in HEADINGS:
            words.discard("header")
        if not FRAME_NAMES.isdisjoint(words) and TURNING.isdisjoint(words):
            return True
    mark = marks.get("id", "").strip()
    if not mark or name in HEADINGS:
        return False
    if in_article:
        return mark in IDS_IN_ARTICLE
    words = set(re.split(r"[\s_-]+", mark))
    told = words & FRAME_NAMES
    return mark in FRAME_NAMES or TURNING.isdisjoint(words) and (len(told) > 1 or not told <= PLAIN_WORDS)


class Elements:
    """The open blocks of a page and those that a tag closes with it, as browsers read pages that leave closing tags out."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, height: int) -> None:
        while len(self.names) > height:
            self.count[self.names.pop()] -= 1

    def _innermost(self, names: set[str], through: Callable[[str], bool]) -> int | None:
        if not any(self.count.get(x) for x in names):
            return None
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in names:
                return i
            if not through(self.names[i]):
                return None
        return None

    def before(self, name: str) -> None:
        """Closes what the opening tag of a block closes."""
        if self.names and self.names[-1] == "p" and name not in IN_P:
            self.cut(len(self.names) - 1)
        if name in ITEMS:
            at = self._innermost(ITEMS[name], LOOSE.__contains__)
        elif name in CELLS:
            # The outermost of them in this table.
            at = None
            while (inner := self._innermost(CELLS[name], lambda x: x not in ("table", *ARTICLE))) is not None:
                at = inner
                self.cut(at)
        else:
            return
        if at is not None:
            self.cut(at)

    def close(self, name: str) -> None:
        """Closes the innermost element of this name and all in it; not through cells, and not through articles."""
        stops = {"td", "th", "caption", "table", *ARTICLE} if name not in ("table", "tr", "td", "th", *SECTIONS) else {"table", *ARTICLE}
        if name == "li":
            stops |= {"ul", "ol", "menu"}
        if name in ("body", "html"):
            stops = set()
        at = self._innermost({name}, lambda x: x not in stops)
        if at is not None:
            self.cut(at)


def lines_of(page: str) -> list[tuple[int, str]]:
    """The text blocks of a page in order: where each stands, and its text with references decoded and white space
    turned into single blanks. Markup may be broken or cut off: an element that is never closed ends with the one around it, a
    frame element at the latest where an article begins or ends."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    articles = mains = 0  # open article elements, and how many of them are <main>
    open_blocks = Elements()
    frame: str | None = None  # the frame element that is open, and how many blocks are open around it
    height, frame_in_article = 0, False

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                inside = IN_MAIN if mains else IN_ARTICLE
                out.append(((ASIDE if articles else IN_FRAME) if frame else inside if articles else OPEN, text))
            pieces.clear()

    last = 0
    odd: dict[str, bool] = {}
    while token := TOKEN.search(page, last):
        begin = token.start()
        if begin > last:
            pieces.append(html.unescape(page[last:begin]))
        last = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        closing = token["close"]
        if name in SILENT:
            if not closing and (name in CODE or not closed_itself(token["rest"])):
                last = after_silent(page, name, last, odd)
            continue
        if name in BLOCK or frame == name:
            flush()
        elif name in SPACING:
            pieces.append(" ")
        if name in EMPTY:
            if name == "hr":
                open_blocks.before(name)
        elif closing:
            open_blocks.close(name)
            if name in ARTICLE and articles:
                if frame and frame_in_article:
                    flush()
                    frame = None
                articles -= 1
                mains = min(articles, mains - (name == "main" and mains > 0))
        elif name in KEPT_OPEN:
            open_blocks.before(name)
        if frame and len(open_blocks.names) <= height:
            flush()
            frame = None
        if closing or name in EMPTY:
            continue
        framed = (frame is None or name in ARTICLE) and is_frame(name, token["rest"], articles > 0)
        if name in ARTICLE and frame and not frame_in_article and not framed:
            flush()
            frame = None
        if frame is None:
            if framed:
                flush()
                frame, height, frame_in_article = name, len(open_blocks.names), articles > 0
            elif name in ARTICLE:
                articles += 1
                mains += name == "main"
        if name in KEPT_OPEN or name == frame:
            open_blocks.push(name)
    if last < len(page):
        pieces.append(html.unescape(page[last:]))
    flush()
    return out


def aligned(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`. Rows of the score table are bit sets, so that long
    pages cost little; tables too large to keep are halved along `a` first."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a_high, b_high = len(a) - high, len(b) - high
    common = set(a[low:a_high]).intersection(b[low:b_high])
    places = [i for i in range(low, a_high) if a[i] in common]
    inner = _aligned([a[i] for i in places], [x for x in b[low:b_high] if x in common])
    return [*range(low), *(places[i] for i in inner), *range(a_high, len(a))]


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """Row i as bits: bit j is 0 where b[j] lengthens the common subsequence with a[: i + 1]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _aligned(a: Sequence[int], b: Sequence[int], kept_bits: int = 1 << 26) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > kept_bits and len(a) > 1:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(left + right))
        return _aligned(a[:half], b[:cut], kept_bits) + [half + i for i in _aligned(a[half:], b[cut:], kept_bits)]
    rows = list(_rows(a, b))
    found: list[int] = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return found[::-1]


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with b[:j], for each j."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits)])


def main_text(lines: list[tuple[int, str]], hashes: list[int], neighbour: Sequence[int] | None) -> str:
    """The article's lines if the page marks one that holds, with its own frame, at least as much text as the open lines that
    the neighbour lacks, or a part of that where <main> marks it; else these open lines, and the marked ones among them that the
    neighbour lacks; all of them where the neighbour is a copy of the page."""
    long = [0] * 5
    for where, text in lines:
        long[where] += len(text)
    marked = (long[IN_ARTICLE] + long[IN_MAIN] > 0) * (long[IN_ARTICLE] + long[ASIDE] + long[IN_MAIN]) * (MAIN_COUNTS if long[IN_MAIN] else 1)
    shared: set[int] = set()
    if long[OPEN] > marked:
        shared = set(aligned(hashes, neighbour)) if neighbour is not None else shared
        long[OPEN] = sum(len(text) for i, (where, text) in enumerate(lines) if where == OPEN and i not in shared)
    if marked and long[OPEN] <= marked:
        return "\n\n".join(text for where, text in lines if where in (IN_ARTICLE, IN_MAIN))
    found = [i for i, (where, _) in enumerate(lines) if where in (OPEN, IN_ARTICLE, IN_MAIN)]
    own = [i for i in found if i not in shared]
    if not own and neighbour is not None and len(neighbour) == len(lines):  # a copy of its neighbour
        own = found
    return "\n\n".join(lines[i][1] for i in own)


def _place(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; null for what has no host."""
    pattern = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]+)([^?#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    return F.when(host != "", host), F.regexp_extract(url, pattern, 2)


def nearest(pages: DataFrame) -> DataFrame:
    """page_id and url of each page with other_id and other_url of the page of its host that stands next to it in the order of
    (path, url, page_id) and shares the longer beginning of the path; the one before, if both share as much.

    Only ids and URLs are read. Positions come from range-partitioned slices, so a host may hold any share of all pages.
    Pages without a host, and hosts with one page, have no pair. Equal (page_id, url) count once.
    """
    host, path = _place(F.col("url"))
    keys = pick(pages, "page_id", "url").distinct().withColumn("host", host).withColumn("path", path).filter("host is not null")
    placed = running_position(keys, ["host"], [F.col("path"), F.col("url"), F.col("page_id")], "place")
    sides = placed.select("host", F.col("page_id").alias("other_id"), F.col("url").alias("other_url"), F.col("path").alias("other_path"), F.explode(F.array(F.col("place") + 1, F.col("place") - 1)).alias("place"), F.col("place").alias("other_place"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("path"), F.length("other_path"))))
    differ = F.array_position(F.transform(places, lambda i: F.expr("path").substr(i, F.lit(1)) == F.expr("other_path").substr(i, F.lit(1))), False)
    shared = F.when(differ == 0, F.least(F.length("path"), F.length("other_path"))).otherwise(differ - 1)
    pairs = placed.join(sides, ["host", "place"]).withColumn("rank", F.struct(shared.alias("shared"), (-F.col("other_place")).alias("first")))
    best = F.max_by(F.struct("other_id", "other_url"), "rank").alias("other")
    return pairs.groupBy("page_id", "url").agg(best).select("page_id", "url", "other.*")


def _hashes(lines: list[tuple[int, str]]) -> np.ndarray:
    return string_hashes(pa.array([text for _, text in lines], pa.large_string())).view(np.int64)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars (code points of the text).

    A null html is an empty page; a page without main text has an empty text; an unmarked page whose neighbour is a copy keeps all its
    lines. Repeated rows each get their text; rows with
    one page_id and url but different html are read on their own, and of their lines the smallest list serves the neighbour.
    Null ids and URLs are kept. Whole pages count. What moves between tasks is each page's lines, compressed, once, and the
    64-bit hashes of its lines; two different lines would have to share a hash to be taken for one.
    """
    import zstandard

    rows = pick(pages, "page_id", "url", "html")
    small_batches(pages.sparkSession)
    kinds = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "html"):
            found = [lines_of(page or "") for page in table["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"page_id": table["page_id"].combine_chunks(), "url": table["url"].combine_chunks(), "hashes": pa.array([_hashes(x) for x in found], pa.list_(pa.int64()))}
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for table in steps(batches, "html"):
            found = [lines_of(page or "") for page in table["html"].to_pylist()]
            packed = [packer.compress("\n".join(f"{where}{text}" for where, text in x).encode("utf-8", "surrogatepass")) for x in found]
            yield pa.RecordBatch.from_pydict({"page_id": table["page_id"].combine_chunks(), "url": table["url"].combine_chunks(), "packed": pa.array(packed, pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for packed, other in zip(batch.column("packed").to_pylist(), batch.column("other").to_pylist(), strict=True):
                raw = unpacker.decompress(packed).decode("utf-8", "surrogatepass")
                lines = [(int(x[0]), x[1:]) for x in raw.split("\n")] if raw else []
                texts.append(main_text(lines, _hashes(lines).tolist() if other is not None else [], other))
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array(list(map(len, texts)), pa.int64())}
            )

    hashes = rows.mapInArrow(keep, f"{kinds}, hashes array<bigint>")
    lists = hashes.filter("url is not null").groupBy("page_id", "url").agg(F.min("hashes").alias("hashes"))
    pairs = nearest(rows).alias("p")
    of_other = lists.select(F.col("page_id").alias("other_id"), F.col("url").alias("other_url"), F.col("hashes").alias("other")).alias("o")
    known = pairs.join(of_other, F.col("p.other_id").eqNullSafe(F.col("o.other_id")) & (F.col("p.other_url") == F.col("o.other_url")))
    known = known.select("p.page_id", "p.url", "o.other").alias("k")
    packed = rows.mapInArrow(pack, f"{kinds}, packed binary").alias("r")
    met = packed.join(known, F.col("r.page_id").eqNullSafe(F.col("k.page_id")) & F.col("r.url").eqNullSafe(F.col("k.url")), "left")
    return met.select("r.page_id", "r.url", "r.packed", "k.other").mapInArrow(finish, f"{kinds}, text string, n_chars bigint")
