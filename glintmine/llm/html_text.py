"""Main text of web pages: block structure first, then nearest-URL page differencing.

A page is read into blocks (lines) with the context of each. What stands in navigation, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments by its element or its class and id words
goes. Pages of a host are then ordered by URL path and paired with the nearest pages of another kind: lines
are aligned by longest common subsequence, and what a page shares with a neighbour is template and is deleted.

Copies share their text without being made of boilerplate, so pages are first put in classes: pages with
equal lines are one text, and texts with the same longest line inside an article or main element are one
class of near copies (a text without such lines is a class of its own). A class stands at its first path, its
neighbours are the classes before and after it, however many pages they have, and all copies of a text get
the same result. A line outside an article is template if the class before or after has it too. A line inside
one needs more evidence, since pages quote each other: the nearest four classes must all have it (all others,
of three or four classes; two classes can't tell).

Ranks of classes within a host, blocks of ranks and neighbours follow from hosts, paths and lines alone, so the
result does not depend on how rows are dealt over tasks. Lines are compared by 64-bit hashes, salted by the host.

White space inside a block becomes one space; blocks are joined by one newline in page order.

Edge cases: null and empty html give an empty text. A null url, or one without a host, has no neighbours: such
pages, and those of a host with one class, are judged by their structure. Texts at the same path are ordered by
their hash. Repeated rows are pages of their own, with equal results. Texts of any length are read whole. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, materialize, per_row, small_batches

# Elements by what they do to the text.
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input option iframe object embed svg canvas audio video head menu dialog datalist fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets related recommended "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social comment comments "
    "reply replies disqus respond pagination pager skip copyright legal contentinfo complementary".split()
)
#: Classes that hold the article even where a mark stands beside them.
KEPT = frozenset("article main".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("div article section main td th table ul ol dl body nav footer header aside form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")

#: Classes that have to share an article line before it is template; a host's edge has all of them on one side.
WITNESSES = 4
#: Ranks of classes that one task compares at once.
BLOCK = 512

Line = tuple[str, bool]


def _marked(tag: str, attributes: str) -> bool:
    """Whether an element's class, id or role says that it is not the article."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif tag not in ("html", "body", "article", "main") and MARKS.intersection(w.lower() for w in CAMEL.split(value)):
            return not KEPT.intersection(w.lower() for w in CAMEL.split(value))
    return False


def lines_of(html: str | None) -> list[Line]:
    """(line, whether it stands in an article or main element) of the blocks that structure leaves."""
    if not html:
        return []
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, drops, protects)
    piece: list[str] = []
    dropping = protecting = 0
    has_article = re.search(r"<(?:article|main)\b", html, re.I) is not None

    def flush() -> None:
        if piece:
            line = SPACE.sub(" ", "".join(piece)).strip()
            if line:
                out.append((line, protecting > 0))
            piece.clear()

    def pop() -> None:
        nonlocal dropping, protecting
        tag, drops, protects = stack[-1]
        if tag not in INLINE:
            flush()
        stack.pop()
        dropping -= drops
        protecting -= protects

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            if not dropping:
                piece.append(unescape(html[at:]))
            break
        if m.start() > at and not dropping:
            piece.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not dropping:
                piece.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                piece.append(" ")
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is None or tag in INLINE and any(s[0] in SCOPE for s in stack[depth + 1 :]):
                continue
            while len(stack) > depth:
                pop()
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, pop)
        if tag in CLOSES:
            _close(stack, CLOSES[tag], pop)
        if tag not in INLINE and tag != "br":
            flush()
        if tag in ("br", "hr"):
            piece.append(" ")
            continue
        if tag in VOID:
            continue
        in_article = protecting > 0
        # A page's header goes; the header inside an article holds its title.
        drops = tag in DROPPED or tag == "header" and not in_article or _marked(tag, m[3])
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if m[3].rstrip().endswith("/") and tag not in ENDS_P and tag not in SCOPE:
            continue
        protects = tag in ("article", "main") and has_article
        if drops:
            flush()
        stack.append((tag, drops, protects))
        dropping += drops
        protecting += protects
    flush()
    return out


def _close(stack: list, tags: set[str], pop) -> None:
    """Ends an open element of ``tags`` and what is in it, within the nearest container."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in tags:
            while len(stack) > k:
                pop()
            return
        if stack[k][0] in SCOPE:
            return


def shared_lines(mine: list, other: list) -> list[bool]:
    """Which of ``mine`` are in a longest common subsequence with ``other``. The table's rows are bit sets
    (one integer a line), so it stays small and quick for long pages."""
    places: dict = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, []
    for line in mine:
        rows.append(row)
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    rows.append(row)
    shared, j = [False] * len(mine), len(other)
    for i in range(len(mine) - 1, -1, -1):
        below = (1 << j) - 1
        # bits that are 0 count the length of the subsequence; a line that adds none is not in it
        if ((~rows[i + 1]) & below).bit_count() > ((~rows[i]) & below).bit_count():
            shared[i], j = True, _last_match(places[mine[i]], rows[i + 1], below)
    return shared


def _last_match(places: int, row: int, below: int) -> int:
    """The place just before the last match at which the subsequence's length is reached."""
    whole = ((~row) & below).bit_count()
    found = places & below
    while found:
        j = found.bit_length()
        if ((~row) & ((1 << j) - 1)).bit_count() == whole:
            return j - 1
        found &= ~(1 << (j - 1))
    return 0


def template(hashes: list[int], inside: list[bool], beside: list[tuple], witnesses: list[tuple]) -> list[int]:
    """Places of the lines that are template, given (hashes, inside) of the classes beside a page's own, and of
    the nearest ones that are asked about article lines."""
    gone: list[int] = []
    for protected, others, least in ((False, beside, 1), (True, witnesses, max(2, len(witnesses)))):
        at = [k for k, x in enumerate(inside) if x == protected]
        if not at or len(others) < least:
            continue
        mine, votes = [hashes[k] for k in at], [0] * len(at)
        for theirs in others:
            other = [x for x, y in zip(*theirs, strict=True) if y == protected]
            if not set(mine).isdisjoint(other):
                votes = [n + same for n, same in zip(votes, shared_lines(mine, other), strict=True)]
        gone += [k for k, n in zip(at, votes, strict=True) if n >= least]
    return sorted(gone)


def _parse():
    """Adds a page's lines, with their hashes (salted by the host), the hash of all, and its class."""
    import xxhash

    digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, flags, hashes, whole, kinds = [], [], [], [], []
        for host, html in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            parsed = lines_of(html)
            salt = host.encode("utf-8", "surrogatepass") + b"\n"
            hs = [digest(salt + x.encode("utf-8", "surrogatepass")) for x, _ in parsed]
            own = digest(salt + np.asarray(hs, np.int64).tobytes() + bytes(y for _, y in parsed))
            longest = max(((len(x), h) for (x, y), h in zip(parsed, hs, strict=True) if y), default=None)
            lines.append([x for x, _ in parsed])
            flags.append([y for _, y in parsed])
            hashes.append(hs)
            whole.append(own)
            kinds.append(own if longest is None else longest[1])
        new = [pa.array(lines, pa.list_(pa.string())), pa.array(flags, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64())), pa.array(whole, pa.int64()), pa.array(kinds, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names=[*batch.schema.names[:4], "lines", "inside", "hashes", "page", "kind"])

    return step


def _texts(parsed: DataFrame) -> DataFrame:
    """(host, page, kind, path, at, hashes, inside): each different text of a host at its first path, with those
    of its lines that some page of another class may have too (by a bit filter, which may let others pass)."""
    hosted = parsed.where("host != ''")
    seen = hosted.select("kind", F.explode(F.array_distinct("hashes")).alias("x")).groupBy("x").agg(F.min("kind").alias("low"), F.max("kind").alias("high"))
    maybe = bit_filter(seen.where("low != high").select("x"), "x", marks=2)

    def shared():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists, flags = batch.column(4), batch.column(5)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            keep = maybe.value.maybe(flat.view(np.uint64))
            inside = flags.flatten().to_numpy(zero_copy_only=False)
            place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
            cuts = pa.array(np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32))
            some = [pa.array(place[keep].astype(np.int32)), pa.array(flat[keep]), pa.array(inside[keep])]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.ListArray.from_arrays(cuts, x) for x in some)], names=["host", "page", "kind", "path", "at", "hashes", "inside"])

        return step

    kept = hosted.select("host", "page", "kind", "path", "hashes", "inside").mapInArrow(per_row(shared), "host string, page long, kind long, path string, at array<int>, hashes array<long>, inside array<boolean>")
    return kept.groupBy("host", "page", "kind").agg(F.min("path").alias("path"), *[F.first(x).alias(x) for x in ("at", "hashes", "inside")])


def _neighbours(texts: DataFrame) -> DataFrame:
    """(host, kind, rank, near): each class with the nearest classes of its host, ``near`` as (rank, hashes,
    inside). Classes are ranked within their host by path: sorted in ranges, so that a host of any size is dealt
    over many tasks, numbered within each range and shifted by the ranges before. Neighbours are found in
    blocks of ranks, with the classes just outside added to each block."""
    first = F.struct("path", "page")
    classes = texts.groupBy("host", "kind").agg(F.min(first).alias("first"), F.min_by(F.struct("hashes", "inside"), first).alias("body"))
    classes = materialize(classes.select("host", "kind", "first.path", "first.page", "body"), "html-classes")
    ranges = materialize(classes.repartitionByRange("host", "path", "page").withColumn("part", F.spark_partition_id()), "html-ranges")
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("host")
    shift = ranges.groupBy("host", "part").agg(F.count("*").alias("n"))
    shift = shift.select("host", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(whole).alias("classes")).where("classes > 1")
    number = F.row_number().over(Window.partitionBy("host", "part").orderBy("path", "page")) - 1
    ranked = ranges.withColumn("number", number).join(shift.hint("merge"), ["host", "part"]).withColumn("rank", F.col("number") + F.col("shift"))
    block = F.floor(F.col("rank") / BLOCK)
    edges = F.array_distinct(F.transform(F.array(F.lit(-WITNESSES), F.lit(0), F.lit(WITNESSES)), lambda d: F.floor((F.col("rank") + d) / BLOCK)))
    dealt = ranked.select("host", "kind", "rank", "classes", "body", block.alias("own"), F.explode(edges).alias("block"))
    around = Window.partitionBy("host", "block").orderBy("rank").rowsBetween(-WITNESSES, WITNESSES)
    near = dealt.withColumn("near", F.collect_list(F.struct("rank", "body.hashes", "body.inside")).over(around)).where("own = block")
    # as many on one side as on the other, more on one side at the host's edge
    start = F.greatest(F.lit(0), F.least(F.col("rank") - WITNESSES // 2, F.col("classes") - 1 - WITNESSES))
    asked = F.filter("near", lambda x: (x["rank"] >= start) & (x["rank"] <= start + WITNESSES) & (x["rank"] != F.col("rank")))
    return near.select("host", "kind", "rank", asked.alias("near"))


def _templates(texts: DataFrame) -> DataFrame:
    """(page, gone): the places of template lines, of the texts that have any. A class that a third of all texts
    belong to is a skewed partition of the join, which Spark splits; it streams through, one text at a time."""
    pairs = texts.where(F.size("at") > 0).join(_neighbours(texts).hint("merge"), ["host", "kind"]).select("page", "at", "hashes", "inside", "rank", "near")

    def compare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pages, gone = [], []
            for page, at, hashes, inside, rank, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bodies = [(x["hashes"], x["inside"], abs(x["rank"] - rank)) for x in near]
                places = template(hashes, inside, [x[:2] for x in bodies if x[2] == 1], [x[:2] for x in bodies])
                if places:
                    pages.append(page)
                    gone.append([at[k] for k in places])
            return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["page", "gone"])

        return step

    return pairs.mapInArrow(per_row(compare), "page long, gone array<int>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Pages are parsed once; hashes of lines travel, not lines, but
    for pages that lose some."""
    small_batches(pages.sparkSession)
    rest = F.substring_index(F.substring_index(F.coalesce(F.col(url), F.lit("")), "#", 1), "?", 1)
    chosen = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.lower(F.regexp_extract(rest, r"^[^:/]*://([^/]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^:/]*://[^/]*(.*)$", 1).alias("path"), F.col(html).alias("html"),
    )
    kind = chosen.schema["page_id"].dataType.simpleString()
    columns = f"page_id {kind}, url string, host string, path string, lines array<string>, inside array<boolean>, hashes array<long>, page long, kind long"
    parsed = materialize(chosen.mapInArrow(per_row(_parse), columns), "html-lines")
    gone = materialize(_templates(materialize(_texts(parsed), "html-texts")), "html-templates")
    losing = bit_filter(gone, "page", marks=2)

    def split(wanted: bool):
        def work():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array(losing.value.maybe(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)) == wanted))

            return step

        return parsed.select("page_id", "url", "lines", "page").mapInArrow(per_row(work), f"page_id {kind}, url string, lines array<string>, page long")

    # pages that surely lose nothing take no part in the join
    cut = split(True).join(gone, "page", "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~F.array_contains("gone", k)))
    both = cut.select("page_id", "url", left.alias("lines")).unionByName(split(False).select("page_id", "url", "lines"))
    text = both.select("page_id", "url", F.array_join("lines", "\n").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
