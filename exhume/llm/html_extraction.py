"""Main text of web pages: declared structure, and a suffix array per host for what the structure leaves open.

The token streams of a host's pages, declared articles included, are one long text. A token is boilerplate if it
lies in a substring of ``DEPTH`` tokens or more that ``PAGES`` pages of the host with stories of their own have. Those substrings are the
intervals of the host's suffix array with a common prefix of ``DEPTH``, so suffixes are ranked to that depth only: by
prefix doubling within a page, and by grouping equal ranks over all pages of the host.

A block of a declared article is boilerplate if every token of it lies in such substrings, and
more than half of the host's pages have each of those in their articles. So what articles quote of each other stays, and copies of an article, which have one story, do as well.
Few substrings are that common, so articles are not laid out suffix by suffix: a substring on more than half of a host's pages is on more than half of those in some
part of the pages. Each task names the substrings that are so common in its part, and only those are counted over all pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from exhume.session import Scratch

#: Tokens of the shortest substring that counts as repeated.
DEPTH = 6
#: A substring is boilerplate if so many pages of a host have it, with as many stories.
PAGES = 3
#: Parts of a host in joins by host alone.
PARTS = 64
#: Hosts fall to so many numbers, which tell a task what it has to do for its pages; a task looks at so many suffixes of articles together.
NUMBERS, TOGETHER = 1 << 16, 1 << 22
#: Outside of elements with telling names must be this share of the words, or such an element is a wrapper of the page.
WRAPPED = 0.1
ARTICLE, OPEN, DROPPED = 2, 1, 0

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Element names of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th wbr option img".split())
CHROME = frozenset("nav aside form footer menu dialog button select head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Words in class names and ids that mark what is not part of an article; those of the second list only outside one.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist disqus respond reply replies share sharing social related recommended pagination pager skip toolbar".split()
)
OUTER_MARKS = frozenset("header footer masthead topbar banner widget widgets search copyright legal".split())


def _marked(rest: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether attributes make an element chrome (state or role), whether by name only, and whether they make it the main part."""
    named = main = False
    for name, a, b, c in _NAMES.findall(rest):
        value = (a or b or c).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True, False, False
        if name.lower() == "role":
            main |= value == "main"
            if value in ROLES:
                return True, False, False
        elif name.lower() in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            named |= bool(words & MARKS or not in_article and words & OUTER_MARKS)
    return False, named, main


class Place(NamedTuple):
    """Where a block stands: in an ``article`` (2) or main part (1) or neither; named elements and forms around that part,
    and within it around the block; whether in chrome."""

    part: int = 0
    around: int = 0
    within: int = 0
    chrome: bool = False


def _kinds(found: list[tuple[Place, str]]) -> list[tuple[int, str]]:
    """(kind, text). A name tells little of what wraps the page: one around all articles, or around nearly all text, drops nothing."""
    words: Counter[tuple[int, int]] = Counter()
    for place, text in found:
        if not place.chrome and not (place.part and place.within):
            words[place.part, place.around + place.within] += len(text.split())
    levels = {part: min((n for p, n in words if p == part), default=None) for part in (1, 2)}
    if levels[1] is None and levels[2] is None:
        total, level = sum(words.values()), 0
        while sum(n for (_, at), n in words.items() if at <= level) < WRAPPED * total:
            level += 1
        return [(OPEN if not x.chrome and x.within <= level else DROPPED, text) for x, text in found]
    level = min(n for n in levels.values() if n is not None)
    # an article within a named element of a main part counts if it is the larger piece
    if levels[2] is not None and words[2, levels[2]] > words[1, level]:
        level = levels[2]
    kind = lambda x: DROPPED if x.chrome or x.within or x.part and x.around > level else ARTICLE if x.part else OPEN
    return [(kind(x), text) for x, text in found]


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of all blocks in page order, white space settled; scripts, styles, comments and the head are left out."""
    found: list[tuple[Place, str]] = []
    stack: list[tuple[str, Place]] = []  # open elements with the place of their content
    here, parts = Place(), []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append((here, text))
        parts.clear()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        breaks = tag in BLOCKS or tag in CHROME
        if breaks:
            end_block()
        elif tag in SPACES:
            parts.append(" ")
        if tag in VOID:
            continue
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # an inline end tag never closes blocks around it
            if depth is not None and (breaks or not any(x in BLOCKS for x, _ in stack[depth + 1 :])):
                before = here
                after = stack[depth - 1][1] if depth else Place()
                if after != before:
                    end_block()
                del stack[depth:]
                here = after
            continue
        if m["rest"].endswith("/") and not breaks:
            continue
        if tag == "p" and stack and any(x == "p" for x, _ in stack):  # a paragraph ends the one before
            depth = max(i for i, x in enumerate(stack) if x[0] == "p")
            if not any(x in BLOCKS for x, _ in stack[depth + 1 :]):
                del stack[depth:]
                here = stack[-1][1] if stack else Place()
        in_part = here.part and not here.within and not here.chrome
        chrome, named, main = _marked(m["rest"], bool(in_part)) if m["rest"].strip() and tag not in ("html", "body") else (False, False, False)
        chrome |= tag in CHROME and tag != "form" or tag == "header" and not in_part
        named |= tag == "form"
        part = 2 if tag == "article" else 1 if main or tag == "main" else 0
        if here.chrome or chrome:
            inner = here._replace(chrome=True)
        elif part and not (named and here.part) and (part > here.part or here.within):
            inner = Place(max(part, here.part), here.around + here.within + named)
        else:
            inner = here._replace(within=here.within + named)
        if inner != here:
            end_block()
        stack.append((tag, inner))
        here = inner
    if at < len(page):
        parts.append(unescape(page[at:]))
    end_block()
    return _kinds(found)


def stream(found: list[tuple[int, str]]) -> list[list[str]]:
    """Tokens of all blocks, those of the article as well."""
    return [text.split() for _, text in found]


def ranks(tokens: list[list[str]]) -> np.ndarray:
    """Names of the first ``DEPTH`` tokens of each suffix, blocks parted by a token of their own.

    A shorter stream has one name for all of it, and none if it is empty.
    """
    names = [xxhash.xxh3_64_intdigest(t) for block in tokens if block for t in (*block, "\n")]
    if not names:
        return np.zeros(0, np.int64)
    rank = np.array(names + [0] * max(0, DEPTH - len(names)), np.uint64)
    one = rank
    pair = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) ^ (b >> np.uint64(31))
    depth, done = 1, None
    left, at = DEPTH, 0
    while left:  # the ranks of depths 1, 2, 4, ... put together to DEPTH
        if left & depth:
            part = rank[at : at + len(one) - DEPTH + 1]
            done = part if done is None else pair(done, part)
            at, left = at + depth, left - depth
        rank = pair(rank[:-depth], rank[depth:]) if len(rank) > depth else rank
        depth *= 2
    return done.view(np.int64)


def article(found: list[tuple[int, str]]) -> tuple[np.ndarray, list[int]]:
    """Names of the suffixes of the article's blocks, and how many tokens each block has."""
    tokens = [text.split() for kind, text in found if kind == ARTICLE]
    return ranks(tokens), [len(block) for block in tokens]


def _covered(at: np.ndarray, sizes: list[int]) -> list[int]:
    """The blocks of which every token lies in one of the suffixes at the places ``at``, taken to ``DEPTH``."""
    depth = np.zeros(sum(sizes) + len(sizes) + DEPTH + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + DEPTH, -1)
    bare = np.concatenate([[0], np.cumsum(np.cumsum(depth) == 0)])
    starts = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + 1)]).astype(np.int64)
    return [i for i, n in enumerate(sizes) if n and bare[starts[i] + n] == bare[starts[i]]]


def _story(names: np.ndarray, sizes: list[int], common: list[int]) -> int | None:
    """The least suffix of the blocks that are not common, or of all if those hold less than a tenth of the article (then the pages are near copies)."""
    shared, starts = set(common), np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + 1)])
    # within a block; a shorter one has none
    least = [int(names[starts[i] : starts[i] + n - DEPTH + 1].min()) if n >= DEPTH else None for i, n in enumerate(sizes)]
    own = [i for i in range(len(sizes)) if i not in shared]
    asked = own if 10 * sum(sizes[i] for i in own) >= sum(sizes) else range(len(sizes))
    return min((least[i] for i in asked if least[i] is not None), default=None)


def assemble(found: list[tuple[int, str]], repeated: set[int]) -> str:
    """What the page has of its own; ``repeated`` has the article's blocks, or the suffixes of a page without article, that other pages share."""
    told = [text for kind, text in found if kind == ARTICLE]
    if told:
        return "\n".join(text for at, text in enumerate(told) if at not in repeated)
    kept, at, covered = [], 0, -1
    for kind, text in found:
        tokens, hidden = text.split(), []
        for _ in tokens:
            covered = at + DEPTH if at in repeated else covered
            hidden.append(at < covered)
            at += 1
        covered = at + DEPTH if at in repeated else covered
        at += 1
        own = _unique(tokens, hidden)
        if own and kind == OPEN:
            kept.append(" ".join(own))
    return "\n".join(kept)


def _unique(tokens: list[str], hidden: list[bool]) -> list[str]:
    """A block's tokens without hidden runs; a few tokens at its edge, which a run around it happens to include, stay."""
    own, start = [], 0
    while start < len(tokens):
        end = next((i for i in range(start, len(tokens)) if hidden[i] != hidden[start]), len(tokens))
        if not hidden[start] or end - start < min(DEPTH, len(tokens)):
            own += tokens[start:end]
        start = end
    return own


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def _spread(rows: DataFrame, by: str = "th") -> DataFrame:
    """``rows`` with a part of their host, so that a host with most of the rows is joined in several tasks."""
    return rows.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id(), by), F.lit(PARTS)))


def _copied(hosts: DataFrame) -> DataFrame:
    """A row of every host for each of its parts."""
    return hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("part", F.col("part").cast("bigint"))


def _shared(suffixes: DataFrame) -> DataFrame:
    """(host, name) of suffixes on ``PAGES`` pages or more that stand among as many stories, and one story for two pages at least.

    A story names what a page has of its own, so that near copies of a page have one mostly: the least suffix of the article;
    of an open page, the least one that no more than half of the host's pages have, or of all if those are less than
    a tenth (then the pages themselves are near copies).
    """
    once = suffixes.groupBy("host", "name", "th").agg(F.first("story").alias("story"))
    sizes = suffixes.groupBy("host").agg(F.count_distinct("th").alias("n_pages"))
    common = once.groupBy("host", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES)
    opened = once.filter("story is null").join(common, ["host", "name"], "left")
    opened = _spread(opened).join(_copied(sizes), ["host", "part"])
    rare = F.coalesce(2 * F.col("n") <= F.col("n_pages"), F.lit(True))
    own = opened.groupBy("host", "th").agg(F.min(F.when(rare, F.col("name"))).alias("rare"), F.sum(rare.cast("int")).alias("n_rare"), F.count("*").alias("n"), F.min("name").alias("any"))
    own = own.select("host", "th", F.when(10 * F.col("n_rare") >= F.col("n"), F.col("rare")).otherwise(F.col("any")).alias("own"))
    told = once.join(common, ["host", "name"]).join(own, ["host", "th"], "left")
    stories = told.groupBy("host", "name").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("story", "own")).alias("n_stories"))
    return stories.filter((F.col("n_stories") >= PAGES) & (2 * F.col("n_stories") >= F.col("n"))).select("host", "name")


def _candidates(pages: list[tuple[str, int, np.ndarray]], least: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(host, names) of the suffixes that more pages of (host, th, names) have than any suffix on half of all the host's pages must have in some part.

    ``least`` has that share by a host's number: a half, and less where pages come several times, as copies count once.
    """
    by_host: dict[str, dict[int, np.ndarray]] = {}
    for host, th, names in pages:
        by_host.setdefault(host, {})[th] = names
    for host, held in by_host.items():
        found, counts = np.unique(np.concatenate([np.unique(x) for x in held.values()]), return_counts=True)
        often = found[counts > least[_number(host)] * len(held)]
        if len(often):
            yield host, often


def _shared_blocks(told: DataFrame, candidates: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, th, marks): article blocks that lie in suffixes on ``PAGES`` pages or more, and more than half of the host's, with half as many stories.

    ``told`` has the names and block sizes of the articles of all hosts with ``candidates`` (host, name). The story of a page is the least suffix of
    those article blocks that do not lie in suffixes of more than half of the pages, or of all if those hold less than
    a tenth of the article (then the pages are near copies); a suffix needs half as many stories as pages.
    """
    met = told.select("host", "th", F.posexplode("names").alias("at", "name")).join(candidates, ["host", "name"])
    met = scratch.write(met.dropDuplicates(["host", "th", "at"]))
    counts = met.select("host", "name", "th").distinct().groupBy("host", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES)
    # no more names than twice the suffixes of a page are on more than half of a host's pages
    wide = _spread(counts, "name").join(_copied(sizes), ["host", "part"]).filter(2 * F.col("n") > F.col("n_pages")).select("host", "name", "n")
    common = scratch.write(met.join(wide, ["host", "name"]).groupBy("host", "th").agg(F.collect_list(F.struct("at", "name")).alias("common")))
    asked = common.join(told.dropDuplicates(["host", "th"]), ["host", "th"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stories = []
            for common, names, sizes in zip(*(batch.column(c) for c in ("common", "names", "sizes"))):
                at = np.array([x["at"] for x in common.as_py()], np.int64)
                stories.append(_story(np.array(names.as_py(), np.int64), sizes.as_py(), _covered(at, sizes.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("host", "th", "common", "sizes")] + [pa.array(stories, pa.int64())], ["host", "th", "common", "sizes", "story"])

    stories = scratch.write(asked.select("host", "th", "common", "names", "sizes").mapInArrow(
        tell, "host string, th bigint, common array<struct<at:int,name:bigint>>, sizes array<int>, story bigint"
    ))
    named = stories.select("host", "th", "story", F.explode("common").alias("x")).select("host", "th", "story", "x.name", "x.at")
    shared = named.groupBy("host", "name").agg(F.count_distinct("th").alias("n"), F.count_distinct("story").alias("n_stories"))
    shared = shared.filter((F.col("n_stories") >= PAGES) & (2 * F.col("n_stories") >= F.col("n"))).select("host", "name")
    places = named.join(shared, ["host", "name"], "left_semi").groupBy("host", "th").agg(F.collect_set("at").alias("at"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_covered(np.array(at.as_py(), np.int64), sizes.as_py()) for at, sizes in zip(batch.column("at"), batch.column("sizes"))]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("th"), pa.array(marks, pa.list_(pa.int32()))], ["host", "th", "marks"])

    marks = places.join(stories.select("host", "th", "sizes"), ["host", "th"]).select("host", "th", "at", "sizes")
    return marks.mapInArrow(mark, "host string, th bigint, marks array<int>").filter(F.size("marks") > 0)


def _number(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host) % NUMBERS


@F.arrow_udf(IntegerType())
def _number_of(hosts: pa.Array) -> pa.Array:
    return pa.array([_number(h) for h in hosts.to_pylist()], pa.int32())


@F.arrow_udf(StringType())
def _host_of(urls: pa.Array) -> pa.Array:
    return pa.array([_host(u) for u in urls.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_repeated) of every row of ``pages`` (page_id, url, html).

    ``text`` has the article's blocks in page order, one line each, without those that a host repeats; of a page that declares none, the open
    blocks without what is repeated on other pages of its host (``n_repeated`` counts repeated blocks, or shared suffixes). A null or empty html has an empty text; a null or
    broken url is a host of its own; pages with equal html count as one page, so that copies don't erase each
    other; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"th": F.xxhash64("html"), "host": _host_of("url")})
    copies = page.groupBy("host", "th").agg(F.count("*").alias("n"))
    sizes = scratch.write(copies.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_copies")))
    numbers = lambda hosts: hosts.select(_number_of("host").alias("k"))
    # a share for each number: less than a half where a host has copies, which may fill some part of the pages; hosts of too few pages name nothing
    share = F.when(F.col("n_copies") > F.col("n_pages"), 0.999999 * F.col("n_pages") / (2 * F.col("n_copies"))).otherwise(0.5)
    shares = sizes.filter(F.col("n_pages") >= PAGES).select(_number_of("host").alias("k"), share.alias("share")).groupBy("k").agg(F.min("share").alias("share")).toArrow()
    least = np.full(NUMBERS, np.inf)
    least[shares.column("k").to_numpy()] = shares.column("share").to_numpy()

    def rank_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hosts of pages without article, and candidates among the suffixes of articles."""
        held: list[tuple[str, int, np.ndarray]] = []
        total = 0

        def told() -> pa.RecordBatch:
            found = [*_candidates(held, least)]
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.list_(pa.int64()))], ["host", "names"])

        for batch in batches:
            hosts = batch.column("host").to_pylist()
            open_ = set()
            for host, th, html in zip(hosts, batch.column("th").to_pylist(), batch.column("html")):
                names, sizes = article(blocks(html.as_py()))
                if not sizes:
                    open_.add(host)
                held.append((host, th, names))
                total += len(names) + 1
                if total >= TOGETHER:
                    yield told()
                    held, total = [], 0
            if open_:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(open_), pa.string()), pa.array([None] * len(open_), pa.list_(pa.int64()))], ["host", "names"])
        if held:
            yield told()

    ranked = scratch.write(page.select("html", "th", "host").mapInArrow(rank_pages, "host string, names array<bigint>"))
    # only hosts with a page that the structure leaves open need their suffixes counted
    unsettled = ranked.filter("names is null").select("host").distinct()
    candidates = scratch.write(ranked.select("host", F.explode("names").alias("name")).distinct())
    asked = np.zeros(NUMBERS, np.int8)
    for bit, hosts in ((1, unsettled), (2, candidates)):
        asked[numbers(hosts).distinct().toArrow().column("k").to_numpy()] |= bit

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names and stories of the pages of hosts that have to be looked at; those of their articles, too."""
        for batch in batches:
            rows: list[tuple] = []
            for host, th, html in zip(batch.column("host").to_pylist(), batch.column("th").to_pylist(), batch.column("html")):
                need = asked[_number(host)]
                if not need:
                    continue
                found = blocks(html.as_py())
                own, sizes = article(found)
                least = int(own.min()) if len(own) else None
                rows.append((host, th, least, ranks(stream(found)) if need & 1 else None, own if need & 2 and sizes else None, sizes))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "th", "story", "suffixes", "names", "sizes"])

    schema = "host string, th bigint, story bigint, suffixes array<bigint>, names array<bigint>, sizes array<int>"
    laid = scratch.write(page.select("html", "th", "host").mapInArrow(lay_out, schema))
    suffixes = _spread(laid).join(_copied(unsettled), ["host", "part"], "left_semi").select("host", "th", "story", F.posexplode("suffixes").alias("at", "name"))
    shared = _shared(suffixes)
    # which suffixes of a page are shared
    marks = suffixes.filter("story is null").join(shared, ["host", "name"]).groupBy("host", "th").agg(F.collect_set("at").alias("marks"))
    told = laid.filter("names is not null").select("host", "th", "names", "sizes")
    marks = scratch.write(marks.unionByName(_shared_blocks(told, candidates, sizes.select("host", "n_pages"), scratch)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for html, shared_at in zip(batch.column("html"), batch.column("marks")):
                repeated = set(shared_at.as_py() or ())
                texts.append(assemble(blocks(html.as_py()), repeated))
                counts.append(len(repeated))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["page_id", "url", "text", "n_repeated"])

    kind = page.schema["page_id"].dataType.simpleString()
    marked = page.join(marks, ["host", "th"], "left").select("page_id", "url", "html", "marks")
    return marked.mapInArrow(finish, f"page_id {kind}, url string, text string, n_repeated int")


def text_length(text: Column) -> Column:
    return F.length(text).cast("bigint")
