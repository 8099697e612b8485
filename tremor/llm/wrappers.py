"""HTML extraction by union-free wrappers, one for each host.

A page is a tree of elements and text slots. The pages of a host are aligned one after the other with what is known of the host so far: parts
of the same kind are aligned within, parts that repeat their neighbours become repeated groups, and others that one side
lacks become optional. What is left is a union-free regular expression of the host's pages, the wrapper. Every page is then matched
with its host's wrapper, which gives each text its slot; the sizes of the slots' texts, and whether a slot's text ever changes,
tell which slots hold the article, and these slots' texts are taken from each page.

Tasks fold the pages they read into one wrapper for each host before the shuffle, and wrappers are folded again by
host in two steps, so the pages of a large host never meet in one task.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import blocks, stored, table

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img picture".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open one of these, unless the element named last lies between.
ENDS = {"li": (("li",), "ul ol menu"), "dt": (("dt", "dd"), "dl"), "dd": (("dt", "dd"), "dl"), "tr": (("tr", "td", "th"), "table"), "td": (("td", "th"), "tr table"), "th": (("td", "th"), "tr table"), "option": (("option",), "select")}
NOISE_TAGS = set("head nav footer aside form button select option dialog menu object canvas".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs related recommended recommendations comment comments disqus reply replies respond response responses promo promotion sponsor sponsored "
    "footer masthead topbar toolbar pagination pager widget login search".split()
)
#: Words that say what shape an element has: beside a noise word they leave its meaning as it is (cookie-bar), others don't (menu-recipe).
SHAPES = set(
    "area article articles bar block body bottom box btn button buttons card col column container content form group header holder icons inner item items large layer left link links list main module outer page panel "
    "post posts primary right row section secondary site slot small stories thread title top unit wrap wrapper zone".split()
)
#: A host's slot whose text never changes is frame if so many unlike pages have it, and such a share of the host's unlike pages.
LEAST_PAGES, FRAME_SHARE = 3, 0.5
#: Digests of a slot's unlike pages that are kept, the least ones: up to so many are counted exactly, more are estimated.
PAGE_DIGESTS = 32
#: A class that starts so says what a page has, not what an element is.
STATES = ("has-", "no-", "with-", "without-", "is-", "not-")
ROOT_WORDS = {"main", "articlebody"}
RAW = re.compile(r"<(script|style|noscript|template|textarea|iframe|svg|object)\b(?:[^>]*)>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.I | re.S)
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]++|"[^"<>]*+"|'[^'<>]*+'|"|')*+)(?:>|\Z)""")
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HEADS = set("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dt dd figcaption".split())
#: Levels of a page's tree. What lies deeper is noise or not by all its elements, and stands in the last level's element.
LEVELS = 100


def noise_word(name: str) -> bool:
    """Whether a class or id is one of the noise words, alone or with others of them and words of shape."""
    words = {w for w in re.split("[^a-z]+", name) if len(w) > 1}
    return not name.startswith(STATES) and bool(NOISE_WORDS & words) and words <= NOISE_WORDS | SHAPES


@lru_cache(20_000)
def label(tag: str, attributes: str) -> str:
    """The tag with its classes and roles: those that tell noise or the article, and the first part of the first one (all of it, if that part alone would tell noise). Of ids only the telling ones, since others name single elements."""
    kept, first = [], ""
    for kind, value in NAMED.findall(attributes):
        for name in re.sub(r"[^\w\s-]", "", value.lower()).split():
            if noise_word(name) or name in ROOT_WORDS:
                kept.append(re.sub(r"\d+", "0", name))
            elif not first and kind.lower() != "id":
                part = re.split("[-_]", name)[0]
                first = re.sub(r"\d+", "0", name if noise_word(part) else part)
    return ".".join([tag, *filter(None, [first]), *kept])


def tag_of(name: str) -> str:
    return name.partition(".")[0]


@lru_cache(20_000)
def is_noise(name: str) -> bool:
    """Whether an element is no part of an article. What holds the whole page isn't judged by its classes, an article by whole ones only."""
    tag, *names = name.split(".")
    if tag in ("html", "body", "main"):
        return False
    return tag in NOISE_TAGS or (bool(NOISE_WORDS & set(names)) if tag == "article" else any(map(noise_word, names)))


@lru_cache(20_000)
def is_root(name: str) -> bool:
    tag, *names = name.split(".")
    return tag in ("article", "main") or bool(ROOT_WORDS & set(names))


def parse(page: str) -> tuple[list[str], list]:
    """The text of each block of a page in order, character references decoded and white space folded; and its tree.

    A tree is a list of items: ["#", number of the text] or, in noise below the last level, ["!", number]; [name, mode, items] of an element. Of mode, bit 1: repeated, bit 2: optional.
    """
    page = RAW.sub(" ", page)
    found, text, at = [], [], 0
    names, levels, noisy = [], [[]], [False]

    def close_block() -> None:
        if text:
            if words := html.unescape("".join(text)).split():
                levels[-1].append(["!" if len(names) > LEVELS and noisy[-1] else "#", len(found)])
                found.append(" ".join(words))
            text.clear()

    def pop() -> None:
        name = names.pop()
        noisy.pop()
        if len(names) < LEVELS:
            inner = levels.pop()
            levels[-1].append([name, 0, inner])

    for m in TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        close_block()
        if tag in VOID:
            continue
        if closing:
            if any(tag_of(n) == tag for n in names):
                while tag_of(names[-1]) != tag:
                    pop()
                pop()
            continue
        if names and tag_of(names[-1]) == "p":
            pop()
        if tag in ENDS:
            same, wall = ENDS[tag]
            for k in range(len(names) - 1, -1, -1):
                open_tag = tag_of(names[k])
                if open_tag in wall.split():
                    break
                if open_tag in same:
                    while len(names) > k:
                        pop()
                    break
        name = label(tag, m[3])
        names.append(name)
        noisy.append(noisy[-1] or is_noise(name))
        if len(names) <= LEVELS:
            levels.append([])
    text.append(page[at:])
    close_block()
    while names:
        pop()
    return found, levels[0]


def is_text(item: list) -> bool:
    return item[0] in ("#", "!")


def key_of(item: list) -> str:
    return item[0] if item[0] else "(" + " ".join(map(key_of, item[2])) + ")"


def bare(items: list) -> list:
    """A page's tree without the numbers of its texts: a wrapper of one page."""
    return [[x[0]] if is_text(x) else [x[0], x[1], bare(x[2])] for x in items]


def groups_of(items: list) -> list[list[str]]:
    """The keys of the groups of several items in a wrapper's list."""
    return [[key_of(y) for y in x[2]] for x in items if not x[0]]


def units(items: list, groups: list[list[str]]) -> list[tuple[str, list]]:
    """Items as (key, runs): runs that read as a group's repeats are one unit of that group, other items are units of their own."""
    keys, out, i = [key_of(x) for x in items], [], 0
    while i < len(items):
        group = next((g for g in groups if keys[i : i + len(g)] == g), None)
        if group is None:
            out.append((keys[i], [items[i : i + 1]]))
            i += 1
            continue
        held = []
        while keys[i : i + len(group)] == group:
            held.append(items[i : i + len(group)])
            i += len(group)
        out.append(("(" + " ".join(group) + ")", held))
    return out


def merged(a: list, b: list, mode: int = 0) -> list:
    return a if is_text(a) else [a[0], a[1] | b[1] | mode, aligned(a[2], b[2])]


def with_groups(items: list, groups: list[list[str]]) -> list:
    """A wrapper's items in which runs that read as one of the groups are that group."""
    out = []
    for key, held in units(items, groups) if groups else []:
        if not key.startswith("("):
            out += held[0]
            continue
        for run in held:
            group = run[0] if not run[0][0] else ["", 0, run]
            if out and key_of(out[-1]) == key:
                out[-1] = merged(out[-1], group, 1)
            else:
                out.append(group)
    return out if groups else items


def aligned(a: list, b: list) -> list:
    """The wrapper of two wrappers: common parts aligned within; others join the repeats before them, or are optional."""
    if a == b:
        return a
    a, b = with_groups(a, groups_of(b)), with_groups(b, groups_of(a))
    out, i, j = [], 0, 0
    for m, n, size in SequenceMatcher(None, [key_of(x) for x in a], [key_of(x) for x in b], autojunk=False).get_matching_blocks():
        both = [a[i:m], b[j:n]]
        if out and both[1] and key_of(both[1][0]) == key_of(out[-1]):
            both.reverse()  # repeats of what stands before come first
        for own in both:
            place(out, own)
        out += [merged(p, q) for p, q in zip(a[m : m + size], b[n : n + size])]
        i, j = m + size, n + size
    return out


def place(out: list, own: list) -> None:
    """Adds items that only one side has: to repeats of one to three items before them, or else as optional ones."""
    k = 0
    while k < len(own):
        if width := repeats(out, own[k:]):
            some = own[k : k + width]
            if not out[-1][0] and some[0][0]:
                out[-1] = merged(out[-1], ["", 0, some], 1)
            elif width == 1:
                out[-1] = merged(out[-1], some[0], 1)
            else:
                last = out[-width:]
                if all(x[1] & 2 for x in last):  # all of them may be missing, as a group
                    last, mode = [[x[0], x[1] & 1, x[2]] for x in last], 3
                else:
                    mode = 1
                out[-width:] = [["", mode, aligned(last, some)]]
            k += width
        else:
            x = own[k]
            out.append(x if is_text(x) else [x[0], x[1] | 2, x[2]])
            k += 1


def repeats(out: list, own: list) -> int:
    """How many of the first items of own repeat the last ones of out, or a group there; 0 if they don't."""
    keys, last = [key_of(x) for x in own[:3]], [key_of(x) for x in out[-3:]]
    if out and not out[-1][0]:
        inside = [key_of(x) for x in out[-1][2]]
        if keys[: len(inside)] == inside:
            return len(inside)
    for width in (1, 2, 3):
        some = keys[:width]
        if len(some) == width and some == last[-width:] and len(set(some)) == width and not (width == 1 and is_text(own[0])) and not any(is_text(x) for x in own[:width]):
            return width
    return 0


def as_regex(items: list) -> str:
    """A wrapper in the usual notation: # text slots, (...)+ repeated, (...)? optional, (...)* both."""
    out = []
    for x in items:
        if is_text(x):
            out.append("#")
        else:
            inner = as_regex(x[2])
            own = f"<{x[0]}>{inner}</{tag_of(x[0])}>" if x[0] else inner
            out.append(f"({own}){' +?*'[x[1]]}" if x[1] else own)
    return "".join(out)


def slots(items: list) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
    """The text slots of a wrapper in order: the numbers and the names of the elements around each."""
    found, count = [], [0]

    def walk(items: list, nodes: tuple, names: tuple) -> None:
        for x in items:
            if is_text(x):
                found.append((nodes, (*names, "nav") if x[0] == "!" else names))
            elif x[0]:
                count[0] += 1
                walk(x[2], (*nodes, count[0]), (*names, x[0]))
            else:
                walk(x[2], nodes, names)

    walk(items, (), ())
    return found


def numbered(items: list, count: list[int] | None = None) -> list:
    """The wrapper with the place among slots() at each text slot."""
    count = count or [0]
    out = []
    for x in items:
        if is_text(x):
            out.append([x[0], count[0]])
            count[0] += 1
        else:
            out.append([x[0], x[1], numbered(x[2], count)])
    return out


def match(wrapper: list, items: list, found: dict[int, int]) -> None:
    """Puts the slot of each text of a page's items into found, by aligning them with a numbered wrapper; texts that the wrapper lacks stay out."""
    if not wrapper or not items:
        return
    own, i = units(items, groups_of(wrapper)), 0
    before = None
    for m, n, size in SequenceMatcher(None, [key_of(x) for x in wrapper], [k for k, _ in own], autojunk=False).get_matching_blocks():
        for key, held in own[i:n]:
            if before is not None and key_of(before) == key and not is_text(before):  # one more of a repeated item
                into(before, held, found)
        for w, (_, held) in zip(wrapper[m : m + size], own[n : n + size]):
            into(w, held, found)
            before = w
        i = n + size


def into(w: list, held: list, found: dict[int, int]) -> None:
    for run in held:
        if is_text(w):
            found[run[0][1]] = w[1]
        else:
            match(w[2], run[0][2] if w[0] else run, found)


def clean(names: Iterable[str]) -> bool:
    return not any(map(is_noise, names))


def site_header(place: tuple, mains: set[int]) -> bool:
    """Whether a slot is in a header element of a main part, and no heading."""
    nodes, names = place
    first = next((i for i, n in enumerate(nodes) if n in mains), len(nodes))
    inner = [tag_of(n) for n in names[first + 1 :]]
    return "header" in inner and not any(re.fullmatch("h[1-6]", t) for t in inner)


def decide(places: list, chars: dict[int, int], frame: set[int]) -> list[int]:
    """The slots of the article. places: slots() of the wrapper; chars: the size of the texts in each slot; frame: slots whose text never changes.

    Article or main elements that have text are taken, of nested ones articles; without one, the innermost element that holds most of the text outside the
    frame. Noise inside is left out, and so is frame, but for headings and paragraphs in an article element.
    """
    held = [k for k in chars if clean(places[k][1])] or list(chars)
    marked = defaultdict(int)
    name_of = {n: name for nodes, names in places for n, name in zip(nodes, names)}
    for k in held:
        for n, name in zip(*places[k]):
            if is_root(name):
                marked[n] += chars[k]
    articles = {n for n in marked if tag_of(name_of[n]) == "article"} or set(marked)
    if articles:
        inside = lambda k: any(n in articles for n in places[k][0])
        kept = lambda k: k not in frame or tag_of((places[k][1] or ("",))[-1]) in HEADS
        mains = {n for n in articles if tag_of(name_of[n]) != "article"}
        return sorted(k for k in held if inside(k) and kept(k) and not (mains and site_header(places[k], mains)))
    body = [k for k in held if k not in frame and "header" not in map(tag_of, places[k][1])] or held
    weights = defaultdict(int)
    for k in body:
        nodes, names = places[k]
        # a heading or paragraph of its own is no place for an article
        for depth in range(1, len(nodes) + (not names or tag_of(names[-1]) not in HEADS)):
            weights[nodes[:depth]] += chars[k]
    total, root = sum(chars[k] for k in body), ()
    for nodes in sorted(weights, key=lambda x: (len(x), x)):
        if weights[nodes] >= 0.6 * total and nodes[: len(root)] == root:
            root = nodes
    return sorted(k for k in body if places[k][0][: len(root)] == root)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and host of each row."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of().alias("host"))


@lru_cache(256)
def loaded(wrapper: str) -> list:
    return numbered(json.loads(wrapper))


def slots_of_page(wrapper: str, page: str) -> tuple[list[str], list, dict[int, int]]:
    found, items = parse(page)
    at: dict[int, int] = {}
    match(loaded(wrapper), items, at)
    return found, items, at


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (as JSON; as_regex gives the usual notation) for each host of pages (url, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 64
        held: dict = {}
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                items = bare(parse(page)[1])
                held[host] = aligned(held[host], items) if host in held else items
            if len(held) > 2000:
                yield rows_of(held, part)
                held = {}
        yield rows_of(held, part)

    def rows_of(held: dict, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()), pa.array(list(map(json.dumps, held.values())), pa.string())], ["host", "part", "items"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = sorted(group["items"], key=lambda x: (-len(x), x))
        items = json.loads(first)
        for x in others:
            items = aligned(items, json.loads(x))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "items": [json.dumps(items)]})

    partial = with_host(pages).select("host", "html").mapInArrow(read, "host string, part int, items string")
    parts = partial.groupBy("host", "part").applyInPandas(fold, "host string, items string")
    return parts.groupBy("host").applyInPandas(fold, "host string, items string").withColumnRenamed("items", "wrapper")


def page_digest(texts: list[str]) -> int:
    """A digest of a page's three longest texts: views and copies of one article count as one page, even where a notice is long."""
    return zlib.crc32("\n".join(sorted(texts, key=lambda t: (-len(t), t))[:3]).encode("utf-8", "surrogatepass"))


def unlike_pages(digests: list[int]) -> float:
    """How many pages the least PAGE_DIGESTS of their digests stand for."""
    return len(digests) if len(digests) < PAGE_DIGESTS else (PAGE_DIGESTS - 1) * 2**32 / max(digests[-1], 1)


def article_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, wrapper, kept (the slots of the article) and whole (those it would have without the frame) for each of found (host, wrapper), from the texts of all pages (url, html).

    Frame is a slot whose text never changes, on three unlike pages at least and half of the host's unlike pages: a quotation that two articles share is none, nor is an
    article that has a print view, or copies.
    """
    rows = with_host(pages).select("host", "html").join(found, "host")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
                texts, _, at = slots_of_page(wrapper, page)
                own = page_digest(texts)
                joined = defaultdict(list)
                for k, slot in at.items():
                    joined[slot].append(texts[k])
                joined[-1] = []  # stands for the host
                for slot, some in joined.items():
                    digest = zlib.crc32("\n".join(some).encode("utf-8", "surrogatepass"))
                    chars, low, high, seen = held.get((host, slot), (0, digest, digest, ()))
                    if own not in seen and (len(seen) < PAGE_DIGESTS or own < seen[-1]):
                        seen = tuple(sorted((*seen, own)))[:PAGE_DIGESTS]
                    held[host, slot] = chars + sum(map(len, some)), min(low, digest), max(high, digest), seen
            if len(held) > 100_000:
                yield rows_of(held)
                held = {}
        yield rows_of(held)

    def rows_of(held: dict) -> pa.RecordBatch:
        columns = list(zip(*[(*k, *v) for k, v in held.items()])) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())))], ["host", "slot", "chars", "low", "high", "pages"])

    # as many digests as tasks have kept, at most
    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, PAGE_DIGESTS).alias("pages")
    counted = rows.mapInArrow(read, "host string, slot long, chars long, low long, high long, pages array<long>").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high"), least)
    # as many entries as the wrapper has slots
    by_host = counted.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "low", "high", "pages")).alias("slots"))

    @F.pandas_udf("kept array<long>, whole array<long>")
    def chosen(wrapper: pd.Series, own: pd.Series) -> pd.DataFrame:
        kept, whole = [], []
        for w, s in zip(wrapper, own):
            s = {x["slot"]: x for x in ([] if s is None else s)}
            n = {k: unlike_pages(list(x["pages"])) for k, x in s.items()}
            frame = {k for k, x in s.items() if k >= 0 and x["low"] == x["high"] and n[k] >= max(LEAST_PAGES, FRAME_SHARE * n[-1])}
            places, chars = slots(json.loads(w)), {k: x["chars"] for k, x in s.items() if k >= 0}
            kept.append(decide(places, chars, frame))
            whole.append(decide(places, chars, set()) if frame else kept[-1])
        return pd.DataFrame({"kept": kept, "whole": whole}, dtype=object)

    return found.join(by_host, "host", "left").withColumn("chosen", chosen("wrapper", "slots")).select("host", "wrapper", "chosen.kept", "chosen.whole")


def text_of(wrapper: str | None, kept: Iterable[int], page: str, whole: Iterable[int] = ()) -> str:
    """The article of a page: its texts in the kept slots. If that leaves less than half of what it has in the whole ones, frame was none to this page, and they are taken; if it has
    no text there, what its own tree alone tells."""
    texts, items, at = slots_of_page(wrapper or "[]", page)
    own = set(kept)
    taken = [t for k, t in enumerate(texts) if at.get(k, -1) in own]
    if own != (also := set(whole) or own):
        all_ = [t for k, t in enumerate(texts) if at.get(k, -1) in also]
        taken = all_ if 2 * sum(map(len, taken)) < sum(map(len, all_)) else taken
    if not taken and texts:
        places, alone = slots(items), {}
        match(numbered(items), items, alone)
        chars = defaultdict(int)
        for k, slot in alone.items():
            chars[slot] += len(texts[k])
        own = set(decide(places, chars, set()))
        taken = [t for k, t in enumerate(texts) if alone.get(k, -1) in own]
    return "\n\n".join(taken)


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html): the article's blocks, joined by two line ends.

    Wrappers with their kept slots are inferred from all pages unless given. A page that has no text where its host's wrapper has the article is decided by its own
    tree. Null or empty html gives the empty text; a null or odd url has the host ''. Repeated rows give repeated results; an empty table none.
    """
    if found is None:
        found = stored(article_slots(pages, stored(wrappers(pages), "wrappers")), "article-slots")
    rows = with_host(pages).join(found, "host", "left").drop("host")  # one row a host: Spark broadcasts it if it is small, and splits hot hosts if not

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "html"):
                out = [text_of(w, kept or (), page, whole or ()) for page, w, kept, whole in zip(*(b.column(c).to_pylist() for c in ("html", "wrapper", "kept", "whole")))]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract of all pages."""
    return extract(table(spark, sf_dir, "pages"))
