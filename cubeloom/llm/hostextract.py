"""Main text of web pages: block structure and host suffix arrays.

A page is read into blocks of text with what encloses them. Menus, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are known by element,
role or class and never kept; a class does not tell where its element encloses the
article. Where the page marks its article (article, main, or the role main), only
blocks inside it are kept, and those of prose elements (paragraphs, headings, quotes,
list items, cells and text right in the article) are fixed: passages that repeat there
are the author's.

The token streams of all pages of a host are concatenated into a suffix array and runs
of at least RUN tokens that two distinct pages share are covered. Of pages that mark no
article, blocks keep their uncovered runs. Of marked pages, blocks that are not fixed
(bare text of division, section and the like) go if they are wholly covered. A host's
pages are dealt into groups of about GROUP_PAGES, each with an array of its own; runs
that repeat only across groups are then met by their hash, so the split of a large host
changes nothing.

Defined cases: null, empty or markup-only html gives an empty text. Null urls share
the host "". Rows that repeat a page_id are extracted one by one; pages whose blocks
are all alike count as one page, so copies do not make each other boilerplate. A tag
or comment that never ends takes the rest of the page with it, as in browsers. Further
columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm import texthash
from cubeloom.llm.runtime import ship, written

RUN, GROUP_PAGES, BROADCAST_HOSTS = 8, 2_000, 100_000
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"']))|[\"'])*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
RAW = frozenset("script style textarea title iframe noframes xmp".split())
SKIP = frozenset("nav footer aside form button select menu dialog audio video canvas head noscript template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LOOSE = frozenset("div section ul ol dl table tbody tr figure details center hgroup address header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus respond related recommended widget toolbar pagination pager".split()
)
#: Words that make a class the state of a page and not the kind of an element.
STATES = frozenset("no not non without with has have is hide hidden show shown enable enabled disable disabled allow open closed on off".split())


@lru_cache(10_000)
def _named(value: str) -> bool:
    """Whether one class or id names what is never kept: by its first or last word."""
    words = [w for w in re.split(r"[_-]+", value) if w]
    return bool(words) and (words[0] in NAMES or words[-1] in NAMES) and not STATES.intersection(words)


def _kind(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """(never kept by element or role, by name, marks the article)."""
    marks = tag in ("article", "main")
    if tag in SKIP:
        return True, False, False
    if "=" not in raw:
        return False, False, marks
    hard = soft = False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            soft |= any(_named(v) for v in value.split())
        elif name == "role":
            hard |= value in ROLES
            marks |= value == "main"
        elif (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hard = True
    return hard, soft and tag not in ("html", "body"), marks and not hard


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def _items(page: str):
    """Text as strings and tags as (name, shuts, attributes), in one pass."""
    at, n, find = 0, len(page), page.find
    while at < n:
        lt = find("<", at)
        while 0 <= lt < n - 1 and not (page[lt + 1].isascii() and (page[lt + 1].isalpha() or page[lt + 1] in "/!?")):
            lt = find("<", lt + 1)
        if lt < 0 or lt == n - 1:
            yield page[at:]
            return
        if lt > at:
            yield page[at:lt]
        mark = page[lt + 1]
        if page.startswith("<!--", lt):
            end = find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
            continue
        shuts = mark == "/"
        m = NAME.match(page, lt + 1 + shuts)
        if not m:  # a declaration, or an end tag without a name
            end = find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        tag = m.group().lower()
        end = find(">", m.end())
        if end < 0:
            return
        if (page.find('"', m.end(), end) >= 0) or (page.find("'", m.end(), end) >= 0):
            rest = REST.match(page, m.end())
            if not rest:  # never ends
                return
            end = rest.end() - 1
        at = end + 1
        raw = page[m.end() : end]
        yield tag, shuts, raw
        if tag in RAW and not shuts:
            stop = _end_of(tag).search(page, at)
            at = stop.end() if stop else n
            yield tag, True, ""


def _extents(items: list) -> tuple[list[int], list[bool]]:
    """For each start tag the item that ends it, and whether that is its own end tag."""
    ends, own = [len(items)] * len(items), [False] * len(items)
    stack: list[tuple[str, int]] = []
    count: Counter = Counter()

    def pop(at: int) -> str:
        tag, k = stack.pop()
        count[tag] -= 1
        ends[k] = at
        return tag

    for at, item in enumerate(items):
        if isinstance(item, str):
            continue
        tag, shuts, raw = item
        if shuts:
            if count[tag]:
                while stack[-1][0] != tag:
                    pop(at)
                own[stack[-1][1]] = True
                pop(at)
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if "=" not in raw:
                continue  # nothing to skip: its end does not matter
        elif stack and stack[-1][0] == "p":
            pop(at)
        if stack and stack[-1][0] in LIKE.get(tag, ()):
            pop(at)
        stack.append((tag, at))
        count[tag] += 1
    return ends, own


def blocks(page: str) -> tuple[list[str], bool, list[bool]]:
    """(kept blocks in page order, whether they come from a marked article, which of
    them are fixed)."""
    items = list(_items(page))
    ends, own = _extents(items)
    kinds = {k: _kind(x[0], x[2]) for k, x in enumerate(items) if not isinstance(x, str) and not x[1]}
    marks = [k for k, kind in kinds.items() if kind[2]]
    hidden, main = -1, -1  # the first mark that no menu or the like encloses
    for k, (hard, _, mark) in kinds.items():
        if k >= hidden and hard and own[k]:
            hidden = ends[k]
        elif k >= hidden and mark:
            main = k
            break
    kept: dict[bool, list] = {True: [], False: []}
    parts: list[str] = []
    around: list[tuple[int, str]] = []  # (where it ends, block element)
    until, inside = 0, 0

    def close(at: int) -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            kept[at <= inside].append((text, not around or around[-1][1] not in LOOSE))

    for at, item in enumerate(items):
        if at < until:
            continue
        while around and around[-1][0] <= at:
            close(at)
            around.pop()
        if isinstance(item, str):
            parts.append(entities.unescape(item) if "&" in item else item)
            continue
        tag, shuts, _ = item
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close(at)
        if shuts or tag in VOID:
            continue
        if tag in RAW:
            until = at + 1
            continue
        hard, soft, mark = kinds[at]
        end = ends[at]
        encloses = at <= main < end
        hard |= tag == "header" and at >= inside and not encloses
        if hard and not own[at]:  # never closed: at most up to the next article
            end = min([end, *marks[bisect_right(marks, at) :][:1]])
        if (hard and not (tag == "header" and encloses)) or (soft and not encloses):
            until = end
            continue
        if mark:
            inside = max(inside, end)
        if tag not in INLINE:
            around.append((end, tag))
    close(len(items))
    marked = bool(kept[True])
    texts, fixed = zip(*kept[marked]) if kept[marked] else ((), ())
    return list(texts), marked, [marked and f for f in fixed]


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = np.argsort(values)
    ascending = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ascending[1:] != ascending[:-1]))) if len(values) else order
    return out


def suffix_order(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first `length` tokens (a power of two), by
    prefix doubling; equal ranks share that many tokens, 0 where fewer are left."""
    rank = _ranks(tokens) + 1
    k = 1
    while k < length:
        later = np.zeros(len(rank), np.int64)
        later[:-k] = rank[k:]
        both = rank * (len(rank) + 2) + later
        both[later == 0] = 0
        rank = _ranks(both) + (0 if (both == 0).any() else 1)
        k *= 2
    return rank


def covered(pages: list[np.ndarray], owners: list, run: int = RUN) -> list[np.ndarray]:
    """For each page which of its tokens lie in a run of `run` tokens that a page of
    another owner also has."""
    gap = 1 << 62
    stream = np.concatenate([np.append(p, np.int64(gap + k)) for k, p in enumerate(pages)])
    page_of = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    who = _ranks(np.array(owners))[page_of]
    rank = suffix_order(stream, run)
    order = np.argsort(rank, kind="stable")
    edge = np.flatnonzero(np.diff(rank[order], prepend=-1))
    low, high = np.minimum.reduceat(who[order], edge), np.maximum.reduceat(who[order], edge)
    shared = np.zeros(len(stream), bool)
    shared[order] = np.repeat(low != high, np.diff(np.append(edge, len(order))))
    shared &= rank > 0
    return spread(shared, run, page_of, len(pages))


def spread(begins: np.ndarray, run: int, page_of: np.ndarray, n: int) -> list[np.ndarray]:
    """Marks the run tokens from every begin; one array for each page, its gap left out."""
    step = np.zeros(len(begins) + run, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(step, at, 1)
    np.add.at(step, at + run, -1)
    inside = np.cumsum(step)[: len(begins)] > 0
    ends = np.searchsorted(page_of, np.arange(n), "right")
    starts = np.searchsorted(page_of, np.arange(n))
    return [inside[a : b - 1] for a, b in zip(starts, ends)]


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _tokens(own: list[str]) -> np.ndarray:
    """Hashes of the words of blocks, A-Z lowered."""
    return (texthash.words(pa.array([" ".join(own)], pa.large_string()))[0] >> np.uint64(2)).view(np.int64)


_CODEC = pa.Codec("zstd", compression_level=3)


def _packed(own: list[str], fixed: list[bool], marked: bool) -> bytes:
    """A page's blocks as they are shuffled: compressed, a line each."""
    raw = "\n".join([f"{int(marked)}{''.join('01'[f] for f in fixed)}", *own]).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(packed: bytes) -> tuple[list[str], list[bool], bool]:
    raw = _CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")
    flags, *own = raw.split("\n")
    return own, [f == "1" for f in flags[1:]], flags[0] == "1"


def _read(batches):
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        found = [blocks(h or "") for h in batch.column(2).to_pylist()]
        packed = [_packed(own, fixed, marked) for own, marked, fixed in found]
        # pages whose blocks are alike are one page
        who = [texthash.words(pa.array(["\x00".join(own).replace(" ", "\x01") or "\x00"], pa.large_string()))[0].view(np.int64)[0] for own, _, _ in found]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([_host(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array(packed, pa.binary()), pa.array(who, pa.int64()), batch.column(3)], names=["page_id", "url", "host", "packed", "owner", "rk"])


def _hosts(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([_host(u) for u in batch.column(0).to_pylist()], pa.string())], names=["host"])


def _loose(batches):
    """Whether pages have blocks that are not fixed, of large hosts."""
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        loose = [not all(blocks(h or "")[2]) for h in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(loose, pa.bool_())], names=["host", "loose"])


def _kept(packed: bytes, mask: np.ndarray) -> str:
    """The page's text, of whose words those in the mask are covered."""
    own, fixed, marked = _unpacked(packed)
    out, k = [], 0
    for block, stays in zip(own, fixed):
        n = block.count(" ") + 1
        hit = mask[k : k + n]
        k += n
        if stays or not hit.any():
            out.append(block)
        elif not hit.all():
            out.append(block if marked else " ".join([w for w, m in zip(block.split(" "), hit.tolist()) if not m]))
    return "\n\n".join(out)


_ARRAYS = "rk long, page_id long, url string, host string, owner long, text string, packed binary, mask binary, runs array<long>"


def _array(run: int):
    """One group of pages of a host: covers what the group shares. Where other groups
    matter too, it hands out the hashes of the runs instead of the text."""

    def of(table: pa.Table) -> pa.Table:
        packed, across = table["packed"].to_pylist(), bool(table["across"][0].as_py())
        pages = [_tokens(_unpacked(p)[0]) for p in packed]
        masks = covered(pages, table["owner"].to_pylist(), run)
        none = [None] * len(pages)
        return pa.table(
            {
                **{n: table[n] for n in ("rk", "page_id", "url", "host", "owner")},
                "text": pa.array(none if across else [_kept(p, m) for p, m in zip(packed, masks)], pa.string()),
                "packed": pa.array(packed if across else none, pa.binary()),
                "mask": pa.array([m.astype(np.uint8).tobytes() for m in masks] if across else none, pa.binary()),
                "runs": pa.array([texthash.runs(p.view(np.uint64), run).view(np.int64) for p in pages] if across else none, pa.list_(pa.int64())),
            }
        )

    return of


def _unique(run: int):
    def keep(batches):
        for batch in batches:
            texts = []
            for packed, mask, begins in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                inside = np.frombuffer(mask, np.uint8).astype(bool)
                for b in begins or []:
                    inside[b : b + run] = True
                texts.append(_kept(packed, inside))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return keep


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    ship(spark)
    if run & (run - 1):
        raise ValueError("run must be a power of two")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    counts = base.select("url").mapInArrow(_hosts, "host string").groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups"))
    large = written(counts.where("groups > 1"), "large")  # a row for each host of more than group_pages pages
    few = large.count() <= BROADCAST_HOSTS
    small = lambda df: F.broadcast(df) if few else df
    hosted = base.withColumn("rk", F.monotonically_increasing_id()).mapInArrow(_read, "page_id long, url string, host string, packed binary, owner long, rk long")
    # Runs leave a group only of large hosts on which some block is not fixed.
    if large.isEmpty():
        asked = large.select("host", "groups", F.lit(False).alias("across"))
    else:
        named = base.select("url", "html").mapInArrow(_with_host, "host string, html string").join(small(large.select("host")), "host", "left_semi")
        loose = named.mapInArrow(_loose, "host string, loose boolean").groupBy("host").agg(F.max("loose").alias("across"))
        asked = written(large.join(loose, "host"), "asked")
    dealt = hosted.join(small(asked), "host", "left").withColumn("across", F.coalesce("across", F.lit(False))).withColumn("grp", F.pmod(F.xxhash64("rk"), F.coalesce("groups", F.lit(1)))).drop("groups")
    arrays = dealt.repartition("host", "grp").groupBy("host", "grp").applyInArrow(  # never dealt by host alone
        _array(run), _ARRAYS
    )
    done = ["page_id", "url", "text", F.length("text").cast("long").alias("n_chars")]
    if asked.where("across").isEmpty():
        return arrays.select(*done)
    arrays = written(arrays, "arrays")
    each = arrays.where("runs is not null").select("host", "rk", "owner", F.posexplode("runs").alias("begin", "hash"))
    across = each.groupBy("host", "hash").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("host", "hash")
    begins = each.join(across, ["host", "hash"]).groupBy("rk").agg(F.collect_list("begin").alias("begins"))
    rest = arrays.where("text is null").join(begins, "rk", "left").select("page_id", "url", "packed", "mask", "begins").mapInArrow(_unique(run), "page_id long, url string, text string")
    return arrays.where("text is not null").select("page_id", "url", "text").unionByName(rest).select(*done)


def _with_host(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([_host(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["host", "html"])
