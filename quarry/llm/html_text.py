"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, and each is paired with the neighbour on its host whose path is nearest. The text lines of
the pair, those of menus and footers too, are aligned by their longest common subsequence, and lines that both share are deleted as
parts of the site's frame. Every page goes this way.

What the markup declares is checked afterwards, against the lines that are left. Lines of menus, headers, footers, asides, forms,
adverts, notices and reader comments go, since they may differ from page to page. If the page declares an article (or main part),
lines outside it go, and those in it come back that the neighbour has too: sites carry copies of an article and of its paragraphs.
Of several declared articles one that the neighbour has whole belongs to the frame, if the others are new to it.

The order is a range sort on (host, path), so that one host with a third of all pages is spread over many tasks; each task streams
its range and holds three pages at a time. The first and last page of a range meet those of the ranges beside it afterwards.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import new_path

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the frame of a page, not its article.
FRAME = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags before which an open paragraph ends.
_ENDS_P = BLOCK - {"br", "body", "html", "option"}
#: Names in class, id or role that mark the frame of a page: a word of the first list, alone or with more of them or of the second.
_FRAME_WORD = (
    r"(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|complementary|widget|ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|replies|discussion|respond|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|toolbar|search|contentinfo)\d*"
)
_FRAME_MORE = r"(?:site|page|global|top|bottom|left|right|primary|secondary|bar|box|list|links?|items?|buttons?|section|area|block|wrap|wrapper|container|inner|form|posts?|articles?|slot|unit|\d+)"
_FRAME_NAME = re.compile(rf"(?:^|\s)(?:{_FRAME_MORE}[_-]+)*{_FRAME_WORD}(?:[_-]+(?:{_FRAME_WORD}|{_FRAME_MORE}))*(?=$|\s)", re.I)
#: What may stand in an article and is none of it, as a whole block with such a class (or, of a div or list, such an id): reader
#: comments, adverts, notices of the site, forms to sign up, share bars. Other names say nothing there: ids are often slugs of headings.
_INNER_WORD = r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|comments?|commentlist|disqus|replies|respond|share|sharing|sidebar)\d*"
_INNER_MORE = r"(?:site|page|user|reader|social|top|bottom|left|right|bar|box|list|links?|items?|buttons?|section|area|block|wrap|wrapper|container|inner|form|slot|unit|notice|\d+)"
_INNER_NAME = re.compile(rf"(?:^|\s)(?:{_INNER_MORE}[_-]+)*{_INNER_WORD}(?:[_-]+(?:{_INNER_WORD}|{_INNER_MORE}))*(?=$|\s)", re.I)
_INNER_BY_ID, _INNER = frozenset("div ul ol".split()), frozenset("div ul ol section table span".split())
_MAIN_NAME = re.compile(r"(?:^|\s)(?:main|articleBody|(?:article|post|entry|story)[_-]?(?:body|content|text)|article|main-?content)(?:$|\s)", re.I)

#: Text and mark. The mark of a line of the frame is FRAME_LINE; others have their trust in the lowest two bits, and above them the
#: number of the outermost article or main part around them.
Block = tuple[str, int]
FRAME_LINE = -1


def _trust(mark: int) -> int:
    return 0 if mark == FRAME_LINE else mark & 3


def blocks(page: str | None) -> list[Block]:
    """(text, trust) of every line outside the frame, in page order."""
    return [(s, _trust(m)) for s, m in page_lines(page) if m != FRAME_LINE]


def page_lines(page: str | None, lift: bool = False) -> list[Block]:
    """(text, mark) of every line in page order; trust 2: in an article, 1: in a declared main part, 0: elsewhere.

    An article inside a main part makes all of that page's main parts trusted alike: an introduction before it belongs to it. In an
    article no heading, paragraph or list item is taken for frame, whatever its names. Work and memory grow with the page's length
    (and with how deep its elements nest).

    A page whose only article or main part lies in elements named or tagged as frame is read again: with `lift` such an element no
    longer counts as frame when an article or main part starts in it.
    """
    page = page or ""
    hidden = False
    out: list[Block] = []
    words: list[str] = []
    frame_words: list[str] = []
    # Open elements: (tag, whether it is frame, whether it is an article's header, trust).
    stack: list[tuple[str, bool, bool, int]] = []
    frame = in_header = heading = 0
    nested = False
    part = 0
    n_open: Counter[str] = Counter()

    def flush() -> None:
        for found, is_frame in ((words, False), (frame_words, True)):
            if found:
                text = _SPACE.sub(" ", "".join(found)).strip()
                found.clear()
                if text:
                    trust = 2 if trusts[2] else 1 if trusts[1] else 0
                    out.append((text, FRAME_LINE if is_frame else trust | part << 2 if trust else 0))

    trusts = [0, 0, 0]

    def pop_to(k: int) -> None:
        nonlocal frame, in_header, heading
        while len(stack) > k:
            tag, is_frame, is_header, t = stack.pop()
            frame -= is_frame
            in_header -= is_header
            heading -= tag in HEADINGS
            trusts[t] -= 1
            n_open[tag] -= 1

    at = 0
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            own = not frame and (not in_header or heading)
            (words if own else frame_words).append(html.unescape(text))  # a reference never spans a tag
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if n_open[tag]:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            if tag in BLOCK:
                flush()
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                # Without its end, a head lasts to the body; any other such element to the end of the page.
                body = re.compile(r"<body\b", re.I).search(page, at) if close is None and tag in ("head", "title") else None
                at = close.end() if close else body.start() if body else end
            continue
        if tag in BLOCK:
            flush()
        if tag in _ENDS_P or tag == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (tag == "li" and stack[k][0] == "li"):
                    pop_to(k)
                    break
                if stack[k][0] in ("div", "article", "section", "main", "ul", "ol", "td", "body", "nav", "footer", "header", "aside", "form", "blockquote"):
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        names = " ".join(given.get(k, "") for k in ("class", "id", "role"))
        article_header = tag == "header" and trusts[2] > 0
        is_frame = tag in FRAME and not article_header
        if not is_frame and trusts[2]:
            own = names if tag in _INNER_BY_ID else given.get("class", "")
            is_frame = tag in _INNER and bool(own.strip()) and bool(_INNER_NAME.search(own))
        elif not is_frame and tag not in ("html", "body", "article", "main", *HEADINGS):
            is_frame = bool(names.strip()) and bool(_FRAME_NAME.search(names))
        if tag == "article" and re.search(r"comment|repl(?:y|ies)|teaser|related|\bad\b", names, re.I):
            is_frame = True
        t = 2 if tag == "article" and not is_frame else 1 if tag == "main" or _MAIN_NAME.search(names + " " + given.get("itemprop", "")) else 0
        if t and not is_frame and frame and not trusts[2]:
            hidden = True
            if lift:
                stack = [(x[0], False, *x[2:]) for x in stack]
                frame = 0
        part += t > 0 and not trusts[1] and not trusts[2]
        nested = nested or (t == 2 and trusts[1] > 0)
        stack.append((tag, is_frame, article_header, t))
        n_open[tag] += 1
        frame += is_frame
        in_header += article_header
        heading += tag in HEADINGS
        trusts[t] += 1
    flush()
    if hidden and not lift and not any(_trust(m) for _, m in out):
        return page_lines(page, lift=True)
    return [(s, m & ~3 | 2 if _trust(m) else m) for s, m in out] if nested else out


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The longest common subsequence's length of p and each beginning of q, by a row of bits: a zero is a step up."""
    full = (1 << q.size) - 1
    row = full
    masks: dict[int, int] = {}
    for v in p.tolist():
        mask = masks.get(v)
        if mask is None:
            if len(masks) * q.size > 1 << 27:  # 16 MB
                masks.clear()
            mask = masks[v] = int.from_bytes(np.packbits(q == v, bitorder="little").tobytes(), "little")
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-q.size // 8), "little"), np.uint8), count=q.size, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a belong to a longest common subsequence of a and b. Memory stays in proportion to the lines."""
    shared = [False] * len(a)
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(s, len(codes)) for s in a], np.int64)
    y = np.array([codes.setdefault(s, len(codes)) for s in b], np.int64)
    # Lines that only one of them has belong to no common subsequence.
    places = np.flatnonzero(np.isin(x, y))
    x, y = x[places], y[np.isin(y, x)]
    todo = [(0, x.size, 0, y.size)]
    while todo:
        lo, hi, c, d = todo.pop()
        while lo < hi and c < d and x[lo] == y[c]:
            shared[places[lo]] = True
            lo, c = lo + 1, c + 1
        while lo < hi and c < d and x[hi - 1] == y[d - 1]:
            shared[places[hi - 1]] = True
            hi, d = hi - 1, d - 1
        if lo >= hi or c >= d:
            continue
        if hi - lo == 1:
            shared[places[lo]] = bool((y[c:d] == x[lo]).any())
            continue
        mid = (lo + hi) // 2
        split = int(np.argmax(_lengths(x[lo:mid], y[c:d]) + _lengths(x[mid:hi][::-1], y[c:d][::-1])[::-1]))
        todo += [(lo, mid, c, c + split), (mid, hi, c + split, d)]
    return shared


def _most_trusted(page: list[Block]) -> list[Block]:
    """The lines outside the frame, of which only those of the highest trust that the page has."""
    best = max((_trust(m) for _, m in page), default=0)
    return [(s, m) for s, m in page if m != FRAME_LINE and _trust(m) == best]


def main_text(page: list[Block], partner: list[Block] | None) -> str:
    """The lines that the partner doesn't share, checked against the page's markup.

    Frame lines among them go. Declared articles are the text, whole, and so are main parts if there is no article. Of several articles
    those without a line left go, if of each of the others half or more is left, and if the partner declares what this page lacks:
    otherwise the two are versions of one page, or what both have is the partner's own article.
    """
    shared = common_lines([s for s, _ in page], [s for s, _ in partner]) if partner else [False] * len(page)
    left = [block for block, gone in zip(page, shared) if not gone]
    declared = _most_trusted(page)
    if not any(_trust(m) for _, m in declared):
        return "\n".join(s for s, m in left if m != FRAME_LINE)
    parts = Counter(m for _, m in declared)
    if partner and len(parts) > 1 and _trust(declared[0][1]) == 2:
        new = Counter(m for _, m in left if m in parts)
        here = {s for s, _ in page}
        if new and all(2 * k >= parts[m] for m, k in new.items()) and any(s not in here for s, _ in _most_trusted(partner)):
            parts = new
    return "\n".join(s for s, m in declared if m in parts)


def _near(a: tuple[str, str], b: tuple[str, str]) -> int:
    """How many leading characters two paths of a host share; -1 for different hosts."""
    if a[0] != b[0]:
        return -1
    n = min(len(a[1]), len(b[1]))
    return next((k for k in range(n) if a[1][k] != b[1][k]), n)


#: A page's key and lines, and the written rows: a settled page has its text; a row with `part` stands for the borders of a range,
#: with its first two and last two pages.
_PAGE = "page_id long, url string, host string, path string, lines binary, marks binary"
_WRITTEN = f"page_id long, url string, text string, n_chars long, part int, head array<struct<{_PAGE}>>, tail array<struct<{_PAGE}>>"
_STRUCT = pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("marks", pa.binary())])
_SETTLED = (pa.int64(), pa.string(), pa.string(), pa.int64())
#: Rows, and characters of text, that leave a task at once.
_ROWS, _CHARS = 500, 4 << 20


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Markup as it is sorted: pressed page by page, which takes a quarter less than what a shuffle makes of it."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        raw = [x.as_py() for x in batch.column(4)]
        pressed = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in raw], pa.binary())
        sizes = pa.array([len(x or b"") for x in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pressed, sizes], names=["page_id", "url", "host", "path", "html", "size"])


def _packed(page: dict) -> dict:
    # No line holds a line feed.
    lines = zlib.compress("\n".join(s for s, _ in page["lines"]).encode(), 1)
    return {**page, "lines": lines, "marks": np.array([m for _, m in page["lines"]], np.int64).tobytes()}


def _unpacked(page: dict | None) -> dict | None:
    if page is None:
        return None
    marks = np.frombuffer(page["marks"], np.int64).tolist()
    return {**page, "lines": list(zip(zlib.decompress(page["lines"]).decode().split("\n"), marks))}


def _body(page: dict) -> list[str]:
    return [s for s, m in page["lines"] if m != FRAME_LINE]


def _settled(before: dict | None, now: dict, after: dict | None) -> tuple[int, str, str, int]:
    """The page's row, given the pages before and after it in the order."""
    around = [(_near((now["host"], now["path"]), (x["host"], x["path"])), -k, x) for k, x in enumerate((before, after)) if x is not None]
    # A copy of the page, in another frame or the same, says nothing of its frame.
    body = _body(now)
    best = max((x for x in around if x[0] >= 0 and _body(x[2]) != body), key=lambda x: x[:2], default=None)
    text = main_text(now["lines"], best[2]["lines"] if best else None)
    return now["page_id"], now["url"], text, len(text)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles all pages of a range but its first and last, which it hands on with their neighbours in the range."""
    context = TaskContext.get()
    part, n, chars = context.partitionId() if context else 0, 0, 0
    codec = pa.Codec("zstd")
    head: list[dict] = []
    tail: list[dict] = []
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = (*_SETTLED, pa.int32(), pa.list_(_STRUCT), pa.list_(_STRUCT))
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "text", "n_chars", "part", "head", "tail"])
        rows.clear()
        return batch

    for batch in batches:
        for k in range(batch.num_rows):
            page_id, url, host, path, pressed, size = (c[k].as_py() for c in batch.columns)
            markup = codec.decompress(pressed, size, asbytes=True).decode(errors="replace") if size else None
            page = {"page_id": page_id, "url": url, "host": host, "path": path, "lines": page_lines(markup)}
            if n > 1:
                rows.append((*_settled(tail[0], tail[1], page), None, None, None))
                chars += rows[-1][3]
            head, tail, n = head if n > 1 else [*head, page], [*tail, page][-2:], n + 1
            if len(rows) >= _ROWS or chars >= _CHARS:
                yield out()
                chars = 0
    if n:
        rows.append((None, None, None, None, part, [_packed(x) for x in head], [_packed(x) for x in tail]))
    yield out()


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last pages of ranges (head, tail), given the last page of the range before and the first one of that after."""
    for batch in batches:
        rows = []
        for head, tail, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            here = [(before, head[0], after)] if len(head) == 1 else [(before, head[0], head[1]), (tail[0], tail[1], after)]
            rows += [_settled(*map(_unpacked, x)) for x in here]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _SETTLED)], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty page, and one without text outside its frame, has the empty text. A page without a neighbour on its host keeps
    all lines that its markup leaves; of two equally near neighbours the earlier one is taken. The pairs are the same for any
    partitioning. A null URL counts as the empty one. Repeated rows are pages of their own. An empty table gives no row. Only page_id,
    url and html are read. A page of any length is parsed in one pass; aligning two long ones takes the product of the numbers of
    those lines that both have, 64 at a time.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    plain = F.regexp_replace(url, r"(?s)[?#].*$", "")
    host = F.lower(F.regexp_extract(plain, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/]*)", 1))
    path = F.regexp_replace(plain, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*", "")
    markup = F.col("html").cast("string").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), markup.alias("html"))
    # The hash spreads pages of one path over ranges, too.
    order = ["host", "path", F.xxhash64("page_id", "url"), F.xxhash64("html")]
    # Pages are parsed after the sort: it draws its sample from what it is given, all of which is made twice.
    pressed = rows.mapInArrow(_pressed, "page_id long, url string, host string, path string, html binary, size long")
    ranged = pressed.repartitionByRange(*order).sortWithinPartitions(*order)
    where = new_path(pages.sparkSession, "pages")
    ranged.mapInArrow(_extracted, _WRITTEN).write.option("compression", "zstd").parquet(where)
    written = pages.sparkSession.read.schema(_WRITTEN).parquet(where)
    settled = written.where("part IS NULL").select("page_id", "url", "text", "n_chars")
    edges = written.where("part IS NOT NULL").select("part", "head", "tail")
    parts = sorted(r[0] for r in edges.select("part").collect())  # one number a range
    if not parts:
        return settled
    links = pages.sparkSession.createDataFrame(list(zip(parts, [None, *parts], [*parts[1:], None])), "part int, earlier int, later int")
    before = edges.select(F.col("part").alias("earlier"), F.element_at("tail", -1).alias("before"))
    after = edges.select(F.col("part").alias("later"), F.col("head")[0].alias("after"))
    borders = edges.join(links, "part").join(before, "earlier", "left").join(after, "later", "left").select("head", "tail", "before", "after")
    return settled.unionByName(borders.mapInArrow(_borders, "page_id long, url string, text string, n_chars long"))
