"""Main text of web pages: page structure, and differencing against the page of the nearest URL."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|select|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that start or end a block, that hold no content, and that are not part of an article.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form button dialog menu head".split())
#: Words in class, id or role that mark what is not part of an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply respond search share sharing sidebar signup site-footer site-header social sponsor sponsored subscribe subscription toolbar widget".split())
#: Those of them that hold even for an article element.
REMARKS = frozenset("ad advert comment comments promo related reply respond sponsored".split())
_PART = re.compile(r"site-(?:footer|header)|[a-z0-9]+")


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, region) of the blocks of a page in order. Region: "article n" inside the n-th outermost article element,
    "main" elsewhere inside a main element, "aside" inside an element that is not part of an article, else "open". White
    space in a block is one space; empty blocks go."""
    out: list[tuple[str, str]] = []
    articles = 0
    stack: list[tuple[str, str]] = []  # open elements that set a region
    held: list[str] = []
    region = "open"

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, region))

    for m in _TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            held.append(text)
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            close()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                if name not in BLOCKS and stack[at][1] == "aside":
                    close()
                del stack[at:]
                region = stack[-1][1] if stack else "open"
        elif name not in EMPTY and not m[4].endswith("/"):
            if name in BLOCKS and stack and stack[-1][0] == "p":  # a paragraph holds no block
                stack.pop()
                region = stack[-1][1] if stack else "open"
            tokens = [w for v in _NAMED.finditer(m[4]) for w in next(x for x in v.groups() if x is not None).lower().split()] if m[4] else []
            own = ""
            if name in ("article", "main"):
                own = "aside" if REMARKS.intersection(tokens) else "main"
                while own == "main" and region == "aside" and stack[-1][0] in ("nav", "head", "header", "footer", "menu", "form", "button"):
                    stack.pop()  # none of these holds an article: it was left open
                    region = stack[-1][1] if stack else "open"
                if region == "aside":
                    own = "aside"
                elif own == "main" and region.startswith("article"):
                    own = region
                elif own == "main" and name == "article":
                    own, articles = f"article {articles + 1}", articles + 1
            elif name in ASIDE or name == "header" and region in ("open", "aside"):
                own = "aside"
            elif name not in ("html", "body") and any(not MARKS.isdisjoint(_PART.findall(w)) for w in tokens):
                own = "aside"
            if own == "aside" and name not in BLOCKS:
                close()
            if own or any(s[0] == name for s in stack):
                stack.append((name, own or region))
                region = own or region
    close()
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The longest common subsequence's length of a and each start of b, by sums of integers with a bit for each line of b."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    frequent = {}
    for line, places in where.items():
        if len(places) > 16:
            bits = np.zeros(len(b), np.uint8)
            bits[places] = 1
            frequent[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        here = frequent.get(line)
        if here is None:
            here = sum(1 << j for j in where.get(line, ()))
        if here:
            rising = row & here
            row = ((row + rising) | (row - rising)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[str], b: list[str], matches: int = 200_000) -> set[int]:
    """Places in a of a longest common subsequence of two lists of lines: matches by falling place in b, of which the
    longest rising chain is kept. Lists with more matching pairs than `matches` (a table's cells, say) are cut in two
    where the lengths of both halves say that a longest one can be cut, so memory stays bounded."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = set(range(start)) | set(range(len(a) - stop, len(a)))
    where: dict[str, list[int]] = {}
    for j in range(len(b) - stop - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    inner, other = a[start : len(a) - stop], b[start : len(b) - stop]
    if len(inner) > 1 and sum(len(where.get(x, ())) for x in inner) > matches:
        half = len(inner) // 2
        cut = int(np.argmax(_lengths(inner[:half], other) + _lengths(inner[half:][::-1], other[::-1])[::-1]))
        found |= {start + i for i in common_lines(inner[:half], other[:cut], matches)}
        return found | {start + half + i for i in common_lines(inner[half:], other[cut:], matches)}
    tails: list[int] = []
    links: list[tuple[int, int] | None] = []
    nodes: list[int] = []
    for i in range(start, len(a) - stop):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            links.append((i, nodes[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                nodes.append(len(links) - 1)
            elif j < tails[k]:
                tails[k], nodes[k] = j, len(links) - 1
            else:
                links.pop()
    at = nodes[-1] if nodes else -1
    while at >= 0:
        i, at = links[at]
        found.add(i)
    return found


def decided(page: str) -> tuple[str, str]:
    """(regions, lines) of a page: a letter for each block, and their texts joined by line feeds, of which no block holds
    one. The letter is A for an article's first block and a for its others, m for a main element's outside of articles,
    else o. Blocks that are not part of an article are left out."""
    kept = [(t, r) for t, r in blocks(page) if r != "aside"]
    before = [""] + [r for _, r in kept]
    return "".join((r[0] if r == last else "A") if r[0] == "a" else r[0] for (_, r), last in zip(kept, before, strict=False)), "\n".join(t for t, _ in kept)


def candidates(regions: str) -> list[int]:
    """Places of the lines that structure lets be the text: those inside articles and main elements, if there are any, else all."""
    return [i for i, r in enumerate(regions) if r != "o"] or list(range(len(regions)))


def differing(regions: str, sizes: list[int], lines: list, near: list) -> list[int]:
    """Places of the candidates that the difference to the lines of the page of the nearest URL leaves.

    Lines of a longest common subsequence are shared. What has no line of its own goes: where nothing is marked a line,
    where articles are marked an article, or a line of a main element outside of them; a main element without an article
    counts as one. An article with any line of its own is kept whole, with its shared lines. If what would go from a page
    with marks is as long as what would stay (sizes are in code points), the other page is a version of this one, tells
    nothing about the site, and all candidates stay."""
    shared, places = common_lines(lines, near), candidates(regions)
    if "A" in regions:
        units: list[list[int]] = []
        for i in places:
            if regions[i] == "a":
                units[-1].append(i)
            else:
                units.append([i])
    else:
        units = [places] if "m" in regions else [[i] for i in places]
    kept = [i for unit in units if not shared.issuperset(unit) for i in unit]
    if units and regions[places[0]] != "o" and 2 * sum(sizes[i] for i in kept) <= sum(sizes[i] for i in places):
        return places
    return kept


def main_text(own: tuple[str, str], near: tuple[str, str] | None) -> str:
    """The main text of a page's (regions, lines), given those of the page of the nearest URL, if there is one."""
    regions, lines = own[0], own[1].split("\n") if own[0] else []
    if near and near[0]:
        return "\n".join(lines[i] for i in differing(regions, [len(t) for t in lines], lines, near[1].split("\n")))
    return "\n".join(lines[i] for i in candidates(regions))


def extract_text(pages: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points of the text).

    Every page that has a line is compared with the page of the nearest URL of its host, whether it marks an article or
    not: the difference of their lines decides (see `differing`), structure says what can be text at all. Pages are
    compared by their lines' digests of 128 bits and lengths; texts are not exchanged for it. Pages of a host with the
    very same lines (regions and texts, by a digest of 128 bits) are copies: they count as one page at the first of their
    URLs and get the same text, however many there are and wherever they stand. These distinct pages are
    range-partitioned by host and path, so near URLs are neighbours and a host with a third of all pages is spread; a
    page is compared with that neighbour whose path has the longer common start (the one before, if equal). The first and
    the last page of a partition meet their neighbours of the adjacent ones in a second step, so where partitions are cut
    changes nothing. A page whose URL has no host, or whose host has no other page with a line, is taken by its structure.

    Null html or url counts as empty; text is empty where nothing is left. Rows with equal ids or URLs are pages of their
    own; other columns are not read. Pages are read twice, for their lines and for their texts, and stream through a task
    three at a time. Only decisions that take some candidate away go back to the texts: Spark broadcasts them or joins
    them by exchange, as their size is.
    """
    import pyarrow as pa

    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.lower(F.coalesce("url", F.lit("")))
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("host", F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).withColumn("path", F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)", 1))

    def digest(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def read(batches):
        for batch in batches:
            rows = [(digest("\n".join(own)), main_text(own, None)) for own in map(decided, batch.column("html").to_pylist())]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "host")] + new, ["page_id", "url", "host", "print", "text"])

    #: A page to compare: its lines' sizes in code points and digests, one after the other.
    compared = {"host": pa.string(), "print": pa.binary(), "path": pa.string(), "regions": pa.string(), "sizes": pa.list_(pa.int32()), "lines": pa.binary()}

    def lines(batches):
        for batch in batches:
            rows = []
            for host, path, html in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "html")), strict=True):
                regions, text = decided(html)
                if regions:
                    texts = text.split("\n")
                    rows.append((host, digest(f"{regions}\n{text}"), path, regions, [len(t) for t in texts], b"".join(digest(t) for t in texts)))
            yield batch_of(rows, compared)

    def batch_of(rows, columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(columns), columns.values(), strict=True)], list(columns))

    shape = "host string, print binary, path string, regions string, sizes array<int>, lines binary"
    lined = page.where("host != ''").select("host", "path", "html").mapInArrow(lines, shape)
    distinct = written(lined.groupBy("host", "print").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("regions", "sizes", "lines"))), "pages")
    n = max(2, -(-distinct.count() // part_rows))
    ranged = distinct.repartitionByRange(n, "host", "path", "print").sortWithinPartitions("host", "path", "print")
    #: Rows with part are pages at the edge of a partition, for that part; the others are decisions.
    columns = {"host": pa.string(), "print": pa.binary(), "kept": pa.list_(pa.bool_()), "part": pa.int32(), "place": pa.int64(), "asked": pa.bool_(), **{c: compared[c] for c in ("path", "regions", "sizes", "lines")}}
    beyond = 1 << 62

    def shared_start(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def apart(lines: bytes) -> list[bytes]:
        return [lines[i : i + 16] for i in range(0, len(lines), 16)]

    def decision(before, here, after) -> list[tuple]:
        """Whether each candidate of a page is kept, if not all are; pages are (host, print, path, regions, sizes, lines)."""
        near = [x for x in (before, after) if x is not None and x[0] == here[0]]
        if not near:
            return []
        best = max(near, key=lambda x: shared_start(x[2], here[2]))
        kept, places = set(differing(here[3], here[4], apart(here[5]), apart(best[5]))), candidates(here[3])
        return [(*here[:2], [i in kept for i in places])] if len(kept) < len(places) else []

    def decisions(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def edge(row, to, place, asked=False):
            return (*row[:2], None, to, place, asked, *row[2:])

        out: list[tuple] = []
        first = before = here = None
        count = 0
        for batch in batches:
            for after in zip(*(batch.column(c).to_pylist() for c in compared), strict=True):
                if count == 0:  # also for the partition before, which asks it of its last page
                    first = after
                    out += [edge(after, part - 1, beyond)]
                elif count > 1:
                    out += [(*x, *[None] * 7) for x in decision(before, here, after)]
                if count == 1:
                    out += [edge(first, part, 0, True), edge(after, part, 1, False)]
                before, here, count = here, after, count + 1
                if len(out) >= 512:
                    yield batch_of(out, columns)
                    out = []
        if count == 1:
            out.append(edge(first, part, 0, True))
        elif count:
            out += [edge(before, part, count - 2), edge(here, part, count - 1, True)]
        if count:
            out.append(edge(here, part + 1, -1))
        yield batch_of(out, columns)

    def at_edges(key, table):
        rows: dict = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["place"], r["asked"])):
            rows[r["place"]] = r  # of a page that came twice the asked one
        rows = list(rows.values())
        held = [tuple(r[c] for c in compared) for r in rows]
        out = []
        for i, r in enumerate(rows):
            if r["asked"]:
                out += decision(held[i - 1] if i else None, held[i], held[i + 1] if i + 1 < len(held) else None)
        return pa.Table.from_batches([batch_of(out, {c: columns[c] for c in ("host", "print", "kept")})])

    # partitions of a range exchange have rows, but for the last ones: each is bounded by a key that it holds
    result = "host string, print binary, kept array<boolean>"
    found = written(ranged.mapInArrow(decisions, f"{result}, part int, place long, asked boolean, path string, regions string, sizes array<int>, lines binary"), "decisions")
    edges = found.where("part is not null").drop("kept").groupBy("part").applyInArrow(at_edges, result)
    differ = written(found.where("part is null").select("host", "print", "kept").unionByName(edges), "differ")
    whole = page.select("page_id", "url", "host", "html").mapInArrow(read, f"page_id {kind}, url string, host string, print binary, text string")
    numbered = F.arrays_zip(F.split("text", "\n").alias("line"), F.col("kept").alias("kept"))
    left = F.array_join(F.transform(F.filter(numbered, lambda x: x["kept"]), lambda x: x["line"]), "\n")
    text = whole.join(differ, ["host", "print"], "left").withColumn("text", F.when(F.col("kept").isNull(), F.col("text")).otherwise(left))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
