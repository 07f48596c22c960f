"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags, told apart by the path of containers they stand in, and its text blocks. Over the pages
of a host every token has an occurrence vector, how often it occurs in each page; tokens of equal vectors form an
equivalence class. The class of the highest support is the root of the template, as single pages may be broken or of
another layout. Another class is valid if it occurs in enough of the host's pages, its tokens come in one order wherever
it occurs, and all of them lie between the same two tokens of the root: so it is nested into that slot. What lies between
the template's tokens are slots. Text of the template's classes, and text that almost all pages have, is the template's
own; slots in containers of menus, headers, notices and the like are not the page's main text, and what remains is
extracted whole.

Each page is parsed once, into a written table. A vector is kept as a sum of hashes over pages, and orders and places are
counted, so both are aggregated with partial sums, however many pages a host has; a host's template is bounded by the
tokens of a page. Nothing of a host is gathered but its template.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

# Names of HTML elements by the part they play.
SKIPPED = frozenset("head script style noscript template svg iframe object select button textarea option canvas math audio video map noembed noframes".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
_EVIDENCE = 4  # text in a main element, or in a page's only article, weighs so many times other text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = (BLOCKS | SKIPPED) - frozenset(["hr"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
# Words in a class, id or role that mark what is not main text: strong ones wherever a name begins or ends
# with them, all of them where a name has no other words than these and those of layout.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comments disqus consent cookie cookies gdpr copyright footer masthead menu menubar nav navbar navigation newsletter "
    "pagination popup modal promo sidebar sponsor sponsored subscribe contentinfo".split()
)
HINTS = STRONG | frozenset(
    "header notice notices notification notifications alert pager promotion promoted related recommended recommendation recommendations reply replies respond comment search share sharing social subscription signup login "
    "toolbar complementary".split()
)
LAYOUT = frozenset(
    "area bar bars block body bottom box buttons button card center col column container content global grid group holder icons inner item items left link links list main message middle module outer page panel "
    "post posts primary right row secondary section site slot space stories story text thread title top unit widget widgets wrap wrapper zone article articles form side skip to".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ATTRIBUTES = r"""(?:[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|[\s/=]++)*+"""
TAG = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^A-Za-z>][^>]*(?:>|\Z))|<(/?)([A-Za-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
BLANK = re.compile(r"\s+")


def tokens(page: str):
    """(kind, name, attributes or text) of each token: kind 1 opens, -1 closes, 0 is text."""
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            yield 0, "", page[at:]
            return
        if m.start() > at:
            yield 0, "", page[at : m.start()]
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            yield -1, name, ""
            continue
        yield 1, name, m.group(3)
        if name in RAW:  # its text is not markup
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            yield 0, "", page[at:stop]
            at = stop


def _attributes(text: str) -> dict[str, str]:
    if not text or "=" not in text and "hidden" not in text:
        return {}
    return {m.group(1).lower(): html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in ATTRIBUTE.finditer(text)}


def hinted(marks: str) -> bool:
    """Whether one of the names in a class, id or role says that this is no main text."""
    for name in marks.split():
        words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
        if words and (words[0] in STRONG or words[-1] in STRONG or any(w in HINTS for w in words) and all(w in HINTS or w in LAYOUT for w in words)):
            return True
    return False


class Block:
    """A text block: its text, token, how it is away (0: not, 1: by a hint, 2: by an element), its region (the number of the
    outermost article, -1 in a main element outside articles, 0 in neither), the number of tags before it, its characters
    within links and how many links."""

    __slots__ = ("after", "anchors", "linked", "off", "region", "text", "token")

    def __init__(self, text, token, off, region, after, linked, anchors):
        self.text, self.token, self.off, self.region = text, token, off, region
        self.after, self.linked, self.anchors = after, linked, anchors


def parsed(page: str) -> tuple[list[int], list[Block]]:
    """Tag tokens (hashes of container path and name, in page order) and text blocks of a page. Broken nesting is tolerated:
    a closing tag closes the nearest open container of its name, if any; what stays open ends with the page."""
    tags: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []  # name, path, off, region
    parts: list[str] = []
    linked = link = anchors = articles = 0

    def flush():
        nonlocal linked, anchors
        text = BLANK.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            path, off, region = stack[-1][1:] if stack else ("", 0, 0)
            blocks.append(Block(text, _hash(f"{path}\n{text}"), off, region, len(tags), min(linked, len(text)), anchors))
        parts.clear()
        linked = anchors = 0

    for kind, name, value in tokens(page):
        if kind == 0:
            parts.append(value)
            linked += len(value) if link else 0
            continue
        if name == "a":
            link = kind > 0
            anchors += link
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name not in BLOCKS and name not in SKIPPED and name != "title":
            continue
        flush()
        if stack and stack[-1][0] == "p" and (kind > 0 or name != "p"):
            stack.pop()  # a paragraph ends where any block begins or an outer one ends
        path, off, region = stack[-1][1:] if stack else ("", 0, 0)
        if kind < 0:
            tags.append(_hash(f"{path}|/{name}"))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        a = _attributes(value)
        label = f"{name}.{a['class'].strip()}" if a.get("class") else name
        tags.append(_hash(f"{path}|{label}"))
        if name in VOID or name not in CONTAINERS and name != "title":
            continue
        hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden") == "true"
        if name in SKIPPED or name == "title" or name in BOILERPLATE or hidden:
            off = 2
        elif not off and name not in ("body", "html") and hinted(" ".join(a[k] for k in ("class", "id", "role") if k in a)):
            off = 1
        if name == "article" and region <= 0:
            articles += 1
            region = articles
        elif not region and (name == "main" or a.get("role") == "main"):
            region = -1
        stack.append((name, f"{path}/{label}", off, region))
    flush()
    return tags, blocks


_MASK = (1 << 64) - 1


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    """A signed 64-bit hash that is the same in every process."""
    return _as_long(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def _spread(page: int, times: int) -> int:
    x = (page * 0x9E3779B97F4A7C15 + times * 0xD6E8FEB86659FD93) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def host_of(url):
    """A url's host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


_FIELDS = ("text", "token", "off", "region", "after", "linked", "anchors")
_BLOCK = pa.struct([("text", pa.string()), ("token", pa.int64()), *((f, pa.int32()) for f in _FIELDS[2:])])


def _read_blocks(column: pa.Array):
    """The blocks of each page of a batch, field by field."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_pylist()
    fields = [column.values.field(f).to_pylist() for f in _FIELDS]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield [Block(*x) for x in zip(*(f[a:b] for f in fields), strict=True)]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(id, url, host, page, tags, blocks), written: every page of (id, url, host, html) as its tokens; page is a hash of the
    html."""

    def run(batches):
        for batch in batches:
            keys, tags, blocks = [], [], []
            for page in batch.column("html"):
                page = page.as_py() or ""
                t, b = parsed(page)
                keys.append(_hash(page))
                tags.append(t)
                blocks.append(b)
            flat = [x for b in blocks for x in b]
            fields = [pa.array([getattr(x, f.name) for x in flat], f.type) for f in _BLOCK]
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_BLOCK)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host")), pa.array(keys, pa.int64()), pa.array(tags, pa.list_(pa.int64())), listed], names=["id", "url", "host", "page", "tags", "blocks"])

    kind = pages.schema["id"].dataType.simpleString()
    ints = ", ".join(f"{f}: int" for f in _FIELDS[2:])
    return written(pages.select("id", "url", "host", "html").mapInArrow(run, f"id {kind}, url string, host string, page long, tags array<long>, blocks array<struct<text: string, token: long, {ints}>>"))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, vector, support, is_text): the occurrence vector of each token over the host's pages, and in how many
    pages it occurs; token 0 stands for the pages that have tokens."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            texts: set[int] = set()
            for host, key, tags, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tags", "tokens")), strict=True):
                texts.update(blocks)
                counts = Counter(tags)
                counts.update(blocks)
                for token, times in [*([(0, 1)] if counts else []), *counts.items()]:
                    s = sums.setdefault((host, token), [0, 0])
                    s[0] = (s[0] + _spread(key, times)) & _MASK
                    s[1] += 1
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int64()), pa.array([_as_long(v[0]) for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([k[1] in texts for k in sums])],
                    names=["host", "token", "vector", "support", "is_text"],
                )

    parts = pages.select("host", "page", "tags", F.col("blocks.token").alias("tokens")).mapInArrow(run, "host string, token long, vector long, support long, is_text boolean")
    # sums wrap around, as the hashes do: both halves are summed apart
    halves = parts.groupBy("host", "token").agg(F.sum(F.shiftrightunsigned("vector", 32)).alias("hi"), F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum("support").alias("support"), F.max("is_text").alias("is_text"))
    carry = F.pmod(F.col("hi") + F.shiftrightunsigned("lo", 32), F.lit(1 << 32))
    return halves.select("host", "token", F.shiftleft(carry, 32).bitwiseOR(F.col("lo").bitwiseAND(0xFFFFFFFF)).alias("vector"), "support", "is_text")


def _known(pages: DataFrame, found: DataFrame, many_hosts: int) -> DataFrame:
    """pages with their hosts' rows of ``found``, at most one a host."""
    if found.count() <= many_hosts:  # a host's row has at most the tokens of a page or two
        found = F.broadcast(found)
    return pages.join(found, "host", "left")


def placed(tags: list[int], root: frozenset[int], classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Of one page, for each class of ``classes`` (token: class): its order (a hash of its tokens as they come) and the root's
    token before all of them; 0 if they lie in several slots of the root."""
    order: dict[int, list[int]] = {}
    slots: dict[int, set[int]] = {}
    at, number = 0, 0
    before: dict[int, int] = {}
    for t in tags:
        if t in root:
            at, number = t, number + 1
        elif (c := classes.get(t)) is not None:
            order.setdefault(c, []).append(t)
            slots.setdefault(c, set()).add(number)
            before[c] = at
    return {c: (_hash(repr(seen)), before[c] if len(slots[c]) == 1 else 0) for c, seen in order.items()}


def templates(pages: DataFrame, least_pages: int = 4, share: float = 0.5, missing: float = 0.1, many_hosts: int = 20_000) -> DataFrame:
    """(host, root: the tokens of the root class, valid: those of the valid classes nested into it), one row a host that has
    at least ``least_pages`` pages with tokens; pages as ``parsed_pages`` gives them.

    A class is a candidate if it occurs in ``share`` of these pages and has two tokens or more; the root is the class of
    the highest support, of these that of the most tokens. A candidate is valid if all but ``missing`` of the pages that
    have its tags agree in their order and in the slot of the root that holds them all. Text that at most ``missing`` of
    the pages lack belongs to the root, other text to a class only if ``least_pages`` pages have it.
    """
    v = written(vectors(pages).where("support >= 2 or token = 0"))  # what is on one page is in no template
    hosts = v.where("token = 0").select("host", F.col("support").alias("pages")).where(F.col("pages") >= least_pages)
    often = v.where("token <> 0").join(hosts, "host").where((F.col("support") >= share * F.col("pages")) & (F.col("support") >= 2))
    classes = often.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("tokens"), F.max("support").alias("most"))
    roots = classes.groupBy("host").agg(F.max(F.struct("most", "tokens", "vector"))["vector"].alias("root"))
    known = often.join(classes, ["host", "vector"]).join(roots, "host")
    is_root = (F.col("vector") == F.col("root")) | (F.col("is_text") & (F.col("support") >= (1 - missing) * F.col("pages")))
    is_class = ~is_root & (F.col("tokens") > 1) & (~F.col("is_text") | (F.col("support") >= least_pages))
    member = F.struct("token", F.col("vector").alias("class"), "is_text")
    drawn = written(known.groupBy("host").agg(F.collect_list(F.when(is_root, F.col("token"))).alias("root"), F.collect_list(F.when(is_class, member)).alias("members")))

    def places(batches):
        counts: Counter = Counter()
        for batch in batches:
            for host, tags, root, members in zip(*(batch.column(c).to_pylist() for c in ("host", "tags", "root", "members")), strict=True):
                for c, found in placed(tags, frozenset(root), {m["token"]: m["class"] for m in members if not m["is_text"]}).items():
                    counts[(host, c, *found)] += 1
        columns = zip(*((*k, n) for k, n in counts.items()), strict=True) if counts else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["host", "class", "order", "before", "n"])

    some = drawn.where(F.exists("members", lambda m: ~m["is_text"]))
    seen = _known(pages.select("host", "tags"), some, many_hosts).where("members is not null").mapInArrow(places, "host string, class long, order long, before long, n long")
    ways = seen.groupBy("host", "class", "order", "before").agg(F.sum("n").alias("n"))
    each = ways.groupBy("host", "class").agg(F.sum("n").alias("all"), F.max(F.when(F.col("before") != 0, F.col("n"))).alias("best"))
    broken = each.where(F.coalesce(F.col("best"), F.lit(0)) < (1 - missing) * F.col("all")).groupBy("host").agg(F.collect_set("class").alias("broken"))
    good = F.filter("members", lambda m: F.col("broken").isNull() | ~F.array_contains("broken", m["class"]))
    out = written(drawn.join(broken, "host", "left").select("host", "root", F.transform(good, lambda m: m["token"]).alias("valid")))
    forget(v)
    forget(drawn)
    return out


def extracted(tags: list[int], blocks: list[Block], root: frozenset[int] = frozenset(), valid: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of a page's main text, given its host's template: tokens of the root class and of the other valid ones.

    A slot is what lies between two of the template's tags (between any two tags where there is no template). Slots
    within containers of menus, notices and the like are away (those that only a name marks are not if nothing else has
    text); so is text that the root or another valid class holds, and so are slots of several links with hardly
    any other text, unless an article or a main element holds them. The remaining slots are ranked by where they are:
    each article, the main element outside articles, and the rest of the page weigh as much as their text is long, main
    elements and a page's only article ``_EVIDENCE`` times that. The main text is what the heaviest of them holds, or
    all articles if it is an article. If less than half of what articles and main elements hold is left without the
    template's text, they are taken to be near copies, and their text stays.
    """
    some = [b for b in blocks if not b.off] or [b for b in blocks if b.off < 2]
    template = root | valid
    own = [b for b in some if b.token not in template] if template else some
    if 2 * sum(len(b.text) for b in own if b.region) < sum(len(b.text) for b in some if b.region):
        left = set(map(id, own))
        own = [b for b in some if b.region or id(b) in left]
    slot_after = [0]
    for t in tags:
        slot_after.append(slot_after[-1] + (not template or t in template))
    slots: dict[int, list[int]] = {}
    for b in own:
        s = slots.setdefault(slot_after[b.after], [0, 0, 0])
        for k, x in enumerate((len(b.text), b.linked, b.anchors)):
            s[k] += x
    menus = {k for k, (length, linked, anchors) in slots.items() if anchors > 1 and linked > 0.8 * length}
    own = [b for b in own if b.region or slot_after[b.after] not in menus]
    weight: dict[int, int] = {}
    for b in own:
        weight[b.region] = weight.get(b.region, 0) + len(b.text)
    single = sum(r > 0 for r in weight) == 1
    best = max(weight, key=lambda r: (weight[r] * (_EVIDENCE if r < 0 or r and single else 1), r), default=0)
    return [b.text for b in own if b.region == best or b.region > 0 and best > 0]


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many_hosts: int = 20_000, **options) -> DataFrame:
    """(id, url, text, n_chars), one row per row of pages: the blocks of the main text joined by one newline.

    White space in a block is one space, character references are decoded, and nothing is cut. A null, empty or
    text-less page gives an empty text. Pages of hosts with few pages, and without a host, are read without a template.
    Repeated rows and ids give a row each; an empty table gives none; other columns are not read.
    """
    some = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    read = parsed_pages(some)
    both = _known(read, templates(read, many_hosts=many_hosts, **options), many_hosts).select("id", "url", "tags", "blocks", "root", "valid")

    def run(batches):
        for batch in batches:
            text = []
            for tags, blocks, root, valid in zip(batch.column("tags").to_pylist(), _read_blocks(batch.column("blocks")), *(batch.column(c).to_pylist() for c in ("root", "valid")), strict=True):
                text.append("\n".join(extracted(tags, blocks, frozenset(root or ()), frozenset(valid or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], names=["id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"id {both.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
