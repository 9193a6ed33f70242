"""HTML extraction: main text of pages, with host suffix arrays against repeated boilerplate.

A page becomes a stream of blocks in page order. Every host has suffix arrays, over all its pages: the token streams of its
pages are concatenated, their suffixes are brought into order by their first RUN tokens, and neighbours in that order that
agree in all of them but come from distinct pages are long repeated substrings. Tokens that such substrings cover are
boilerplate; the unique runs are kept. One array holds what pages mark as main text, one what stands beside it.

Markup checks what the arrays say. What stands inside <article> or <main> is main text, without scripts, styles, forms,
menus, headers, footers, sidebars and hidden parts (by tag or role) and without notices, adverts and reader comments (by the
words of their class or id; on and inside <article> or <main> by whole names only). Articles share passages: marked main
text that repeats cover is put back. Not put back are notices without a name: blocks that substrings cover which more than
half of the host's distinct pages hold in their main text, and at least NOTICE_PAGES of them, as long as they are the
smaller part of a page's main text. On pages that mark no main text, the unique runs of all that no name makes boilerplate
are the text; the array over what stands beside main text judges them, so copies of an article don't erase each other.

The order is needed only up to RUN tokens: every place inside a longer repeat starts a repeat of RUN tokens of its own, so
the cover is the same. A host of up to ARRAY tokens is sorted as a whole. A larger one has several arrays, to which its
distinct pages are dealt; so neither a host with a third of all pages nor a notice on all of them lands in one task. Its
arrays meet by a 64-bit print of each distinct beginning: beside main text with the smallest and the largest page that has
it; in main text, what more than half of the host's pages hold, more than half of the pages of one of its arrays hold, so
only such beginnings are counted again over all its pages. Two different beginnings share a print with a chance of about
n^2 / 2^65.

Defined results: null or empty html gives an empty text. Broken markup is read like a browser would, as far as that
matters here: paragraphs, list items, table cells and the like end where the next one starts, other unclosed elements end
with the page, stray end tags are skipped. White space inside a block becomes one space; blocks are joined by one space. A
page without a host, or with a url that can't be read, is a host of its own. Pages of a host with the same main text (or,
unmarked, the same open text) are one page to the arrays, so copies and repeated rows never make each other boilerplate; an
unmarked page of which no unique run is left keeps its open text. Null keys stay as they are; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_width

#: Tokens from which on a repeated substring is long.
RUN = 8
#: Tokens up to which a host has one array; the pages of larger hosts are dealt over several of about as many.
ARRAY = 200_000
#: Distinct pages that each of them has on average at least, however long they are.
ARRAY_PAGES = 16
#: Distinct pages that a notice inside main text is on at least, beside being on more than half of those of its host.
NOTICE_PAGES = 8
#: Bytes of prints or hosts up to which they are broadcast to the pages; beyond it, both are dealt by host.
BROADCAST_BYTES = 32_000_000

# What elements and names mean.
SILENT = frozenset("script style template noscript head title iframe svg math object canvas audio video select option datalist".split())
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments reply replies respond disqus discussion related share sharing social widget toolbar".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript", "template")}
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")  # one after the other, so never inside a value
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
# Headings, whose ids are anchors, and names that articles give to sections of their own.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SECTIONS = frozenset(("discussion",))
# Which open elements a start tag ends without an end tag, and what it does not look beyond.
_TABLE = frozenset(("table", "template"))
_LISTS = frozenset("ul ol menu dl table td th caption template section article main aside nav header footer form fieldset figure figcaption blockquote details dialog button object".split())
_PARAGRAPH = frozenset(("p",)), frozenset("table td th caption template button object marquee".split())
_PARTS = frozenset("tbody thead tfoot caption colgroup".split())
_CELLS = frozenset(("td", "th"))
IMPLIED = (
    dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), _LISTS))
    | dict.fromkeys(_CELLS, (_CELLS | {"caption", "colgroup"}, _TABLE))
    | dict.fromkeys(_PARTS, (_CELLS | {"tr"} | _PARTS, _TABLE))
    | {
        "li": (frozenset(("li",)), _LISTS),
        "tr": (_CELLS | {"tr", "caption", "colgroup"}, _TABLE),
        "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup", "template"))),
        "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "template"))),
    }
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary"
    " table ul".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
KEPT, OPEN, GONE = 2, 1, 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _implied(tag: str, stack: list[tuple[str, int]]) -> int | None:
    """The place in the stack from which on elements end where `tag` starts, None if none does."""
    found = next((i for i, (t, _) in enumerate(stack[:2]) if t == "head"), None) if tag not in IN_HEAD else None
    for ended, beyond in (*([IMPLIED[tag]] if tag in IMPLIED else []), *([_PARAGRAPH] if tag in ENDS_PARAGRAPH else [])):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ended:
                found = i if found is None else min(found, i)
            elif stack[i][0] in beyond:
                break
    return found


def _named(tag: str, name: str, value: str, inside_main: bool) -> bool:
    """Whether a class or id means boilerplate: by any word outside main text, by a whole name on or inside it."""
    if not inside_main and tag not in MAIN:
        return not NAMES.isdisjoint(_WORD.findall(value))
    if name == "id" and tag in HEADINGS:
        return False
    return not NAMES.isdisjoint(set(value.split()) - SECTIONS if name == "id" else value.split())


def _zone(tag: str, attributes: str, inside_main: bool) -> int | None:
    """GONE or KEPT for an element that decides, None for one that leaves things as they are."""
    if tag in SILENT or tag in ASIDE and not (tag == "header" and inside_main):
        return GONE
    if tag in ("html", "body"):
        return None
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return GONE
            if name == "role" and value == "main":
                return KEPT
            if name in ("class", "id") and _named(tag, name, value, inside_main):
                return GONE
    return KEPT if tag in MAIN else None


def segments(page: str | None) -> list[tuple[int, str]]:
    """The blocks of a page, in order, with their zones: KEPT inside main text, OPEN elsewhere, GONE in the rest."""
    if not page:
        return []
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element, zone inside it
    zone, parts, at = OPEN, [], 0

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            blocks.append((zone, text))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is None:
                if tag not in INLINE:
                    close()
                continue
            after = stack[place - 1][1] if place else OPEN
            if tag not in INLINE or after != zone:
                close()
            del stack[place:]
            zone = after
            continue
        ended = _implied(tag, stack) if stack else None
        if ended is not None:
            close()
            del stack[ended:]
            zone = stack[-1][1] if stack else OPEN
        if tag in VOID:
            if tag not in INLINE and tag != "img":
                close()
            continue
        found = None if zone == GONE else _zone(tag, m[3], zone == KEPT)
        inside = zone if found is None else found
        if tag not in INLINE or inside != zone:
            close()
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if inside != GONE:
                parts.append(page[at : end.start() if end else len(page)])
                zone, before = inside, zone
                close()
                zone = before
            at = end.end() if end else len(page)
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append((tag, inside))
            zone = inside
    close()
    return blocks


def suffix_array(streams: list[list[str]], owners: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the streams in order, compared by owner, then by their first `run` tokens.

    Returns (order, new, prints): the places of suffixes in the concatenated streams, sorted; whether the longest common
    prefix with the suffix before is shorter than `run` (or the owner another); and a 64-bit print of the first `run`
    tokens at every place. Suffixes of fewer than `run` tokens are left out. Ranks of 1 token are doubled to 2, 4, ...
    tokens, so the comparison is exact; prints serve to compare suffixes of different arrays.
    """
    tokens = pa.array([t for s in streams for t in s], pa.string()).dictionary_encode()
    lengths = np.array([len(s) for s in streams], np.int64)
    rank = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total, width = len(rank), 1
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # tokens up to the end of the stream
    while width < run:
        step = min(width, run - width)
        after = np.append(rank[step:], np.zeros(min(step, total), np.int64))
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        width += step
    at = np.flatnonzero(left >= run)
    owner = np.repeat(np.asarray(owners, np.int64), lengths)[at]
    order = np.lexsort((rank[at], owner))
    at, owner = at[order], owner[order]
    new = np.append(True, (rank[at][1:] != rank[at][:-1]) | (owner[1:] != owner[:-1]))[: len(at)]
    return at, new, _prints(tokens, total, run)


def _prints(tokens: pa.DictionaryArray, total: int, run: int) -> np.ndarray:
    import xxhash

    words = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.dictionary.to_pylist()), np.uint64, len(tokens.dictionary))
    h = np.append(words[tokens.indices.to_numpy(zero_copy_only=False)], np.zeros(run, np.uint64))
    out = np.zeros(total, np.uint64)
    for i in range(run):
        out = (out ^ h[i : i + total]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _repeats(host: str, main: list[bool], pages: list[int], streams: list[list[str]], run: int) -> dict[str, np.ndarray]:
    """Each distinct beginning of a suffix in the arrays of a host, main text and the rest: the runs of equal neighbours.

    main, print, n (distinct pages that have it), a and b (the smallest and the largest of them).
    """
    at, new, prints = suffix_array(streams, [int(m) for m in main], run)
    if not len(at):
        return {"main": np.zeros(0, bool), **dict.fromkeys(("print", "n", "a", "b"), np.zeros(0, np.int64))}
    stream = np.repeat(np.arange(len(streams)), [len(s) for s in streams])[at]
    start, of = np.flatnonzero(new), np.cumsum(new) - 1  # the first of each run; the run of each suffix
    numbers, page = np.unique(np.array(pages, np.int64), return_inverse=True)
    held, page = np.divmod(np.unique(of * len(numbers) + page[stream]), len(numbers))  # (run, page), each once and in order
    first = np.searchsorted(held, np.arange(len(start) + 1))
    return {"main": np.array(main)[stream[start]], "print": _salted(prints[at[start]], host), "n": np.diff(first), "a": numbers[page[first[:-1]]], "b": numbers[page[first[1:] - 1]]}


def _salted(prints: np.ndarray, host: str) -> np.ndarray:
    import xxhash

    return (prints ^ np.uint64(xxhash.xxh3_64_intdigest(host))).view(np.int64)


def _windows(host: str, stream: list[str], run: int) -> np.ndarray:
    """The print of the suffix at each place of one stream that has `run` tokens after it."""
    if len(stream) < run:
        return np.zeros(0, np.int64)
    prints = _prints(pa.array(stream, pa.string()).dictionary_encode(), len(stream), run)
    return _salted(prints[: len(stream) - run + 1], host)


def covered(n: int, places: np.ndarray, run: int) -> np.ndarray:
    """Which of n tokens a repeated substring covers that starts at one of the places."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, np.minimum(places + run, n), -1)
    return np.cumsum(marks)[:n] > 0


def _unique_runs(blocks: list[tuple[bool, str]], gone: np.ndarray) -> str:
    """What no repeat covers of the open blocks, in order; all of them if that is nothing."""
    kept, at = [], 0
    for is_open, text in blocks:
        tokens = text.split(" ")
        if is_open:
            kept += [t for t, c in zip(tokens, gone[at : at + len(tokens)]) if not c]
        at += len(tokens)
    return " ".join(kept) if kept else " ".join(t for is_open, t in blocks if is_open)


def _without_notices(host: str, blocks: list[str], notices: np.ndarray, run: int) -> tuple[str, int]:
    """The blocks but for those that notices cover whole, and how many tokens these have; all blocks if that is half of them."""
    stream = [t for text in blocks for t in text.split(" ")]
    gone = covered(len(stream), np.flatnonzero(np.isin(_windows(host, stream, run), notices)), run)
    ends = np.cumsum([text.count(" ") + 1 for text in blocks])
    whole = [bool(gone[i:j].all()) for i, j in zip([0, *ends], ends)]
    n = sum(text.count(" ") + 1 for text, w in zip(blocks, whole) if w)
    return (" ".join(blocks), 0) if 2 * n >= len(stream) else (" ".join(t for t, w in zip(blocks, whole) if not w), n)


def _for_hosts(table: DataFrame, size) -> DataFrame:
    """A stored table with one row for each host, broadcast if it is small."""
    return F.broadcast(table) if (table.agg(F.sum(F.octet_length("host") + size)).first()[0] or 0) <= BROADCAST_BYTES else table


def _notices(runs: DataFrame, parsed: DataFrame, run: int) -> DataFrame | None:
    """(host, notices): the beginnings that more than half of a host's distinct pages have in main text; None if there are none."""
    inside = runs.where("print IS NOT NULL")
    sure, unsure = inside.where("arrays = 1").select("host", "print"), inside.where("arrays > 1").select("host", "print").distinct()
    asked = materialize(unsure.groupBy("host").agg(F.collect_list("print").alias("prints")), "asked")
    if not asked.isEmpty():  # beginnings that most pages of one of several arrays have: counted on all pages of their hosts

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = {}
                for host, same, text, prints in zip(b["host"].to_pylist(), b["same"].to_pylist(), b["main"].to_pylist(), b["prints"]):
                    if (host, same) not in own:
                        found = np.unique(_windows(host, _stream(text), run))
                        own[host, same] = found[np.isin(found, prints.values.to_numpy())]
                hosts, pages, prints = ([k[0] for k, p in own.items() for _ in p], [k[1] for k, p in own.items() for _ in p], [int(x) for p in own.values() for x in p])
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(prints, pa.int64())], names=["host", "page", "print"])

        told = parsed.where("main IS NOT NULL").select("host", "same", "main").join(_for_hosts(asked, 8 * F.size("prints")), "host")
        counts = told.mapInArrow(count, "host string, page bigint, print bigint").groupBy("host", "print").agg(F.count_distinct("page").alias("n"))
        totals = runs.where("print IS NULL").groupBy("host").agg(F.sum("n").alias("pages"))
        sure = sure.unionByName(counts.join(totals, "host").where(f"2 * n > pages AND n >= {NOTICE_PAGES}").select("host", "print"))
    found = materialize(sure.groupBy("host").agg(F.collect_list("print").alias("notices")), "notices")
    return None if found.isEmpty() else _for_hosts(found, 8 * F.size("notices"))


def _stream(text: str) -> list[str]:
    """The tokens of blocks that line ends part."""
    return text.replace("\n", " ").split(" ")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", run: int = RUN, array: int = ARRAY) -> DataFrame:
    """(key, url, text string, n_chars long, n_repeated long, n_notice long) for each row.

    n_repeated: how many tokens of a page that marks no main text repeated substrings cover; null for other pages.
    n_notice: how many tokens of marked main text were notices by the host's arrays; null for pages that mark none.
    """
    import xxhash

    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.concat(F.lit("\0"), F.col(key).cast("string")), F.lit(""))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            main, beside, same, sizes = [], [], [], []
            for raw in b["page"].to_pylist():
                found = segments(raw)
                kept = [t for zone, t in found if zone == KEPT]
                main.append("\n".join(kept) if kept else None)  # no block holds a line end
                beside.append([{"open": zone == OPEN, "text": t} for zone, t in found if zone != KEPT])
                judged = kept or [t for zone, t in found if zone == OPEN] or [t for _, t in found]
                same.append(xxhash.xxh3_64_intdigest("\0".join(judged)) - (1 << 63))
                sizes.append(sum(t.count(" ") + 1 for _, t in found))
            blocks = pa.array(beside, pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())])))
            made = [b["row"], b["key"], b["url"], b["host"], pa.array(main, pa.string()), blocks, pa.array(same, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "key", "url", "host", "main", "blocks", "same", "size"])

    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(page).alias("page"))
    kind, link = (source.schema[c].dataType.simpleString() for c in ("key", "url"))
    parsed = source.mapInArrow(parse, f"row bigint, key {kind}, url {link}, host string, main string, blocks array<struct<open:boolean,text:string>>, same bigint, size bigint")
    parsed = materialize(parsed, "pages", codec="zstd")

    def streams(b: pa.RecordBatch) -> list[list[str]]:
        return [[t for x in blocks for t in x["text"].split(" ")] for blocks in b["blocks"].to_pylist()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The streams of a batch by array, packed: main text, each distinct page once, or what stands beside it."""
        for b in batches:
            packs: dict[tuple, dict[tuple[int, str], None]] = {}
            for row, host, arrays, same, main, blocks in zip(*(b[c].to_pylist() for c in ("row", "host", "arrays", "same", "main", "blocks"))):
                if main is not None:
                    packs.setdefault((host, arrays, same % arrays, True), {})[same, main.replace("\n", " ")] = None
                elif blocks:
                    packs.setdefault((host, arrays, row % arrays, False), {})[same, " ".join(x["text"] for x in blocks)] = None
            columns = [list(c) for c in zip(*packs)] or [[], [], [], []]
            raw = ["\n".join(text for _, text in p).encode() for p in packs.values()]
            packed = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
            own = [[same for same, _ in p] for p in packs.values()]
            made = [*(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.bool_()))), pa.array(own, pa.list_(pa.int64())), pa.array(map(len, raw), pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["host", "arrays", "part", "main", "pages", "size", "packed"])

    def arrays(group: pa.Table) -> pa.Table:
        """What the arrays of one host, or of one part of its pages, have to say."""
        host, several = group["host"][0].as_py(), group["arrays"][0].as_py() > 1
        own: dict[tuple[bool, int, str], None] = {}
        for main, pages_, size, packed in zip(*(group[c].to_pylist() for c in ("main", "pages", "size", "packed"))):
            texts = pa.decompress(packed, size, "zstd", asbytes=True).decode().split("\n")
            own.update(dict.fromkeys(zip([main] * len(texts), pages_, texts)))
        mains, numbers, texts = zip(*own)
        found = _repeats(host, list(mains), list(numbers), [t.split(" ") for t in texts], run)
        total = len({page for main, page in zip(mains, numbers) if main})
        often = (2 * found["n"] > total) & (several | (found["n"] >= NOTICE_PAGES))
        told = np.flatnonzero(np.where(found["main"], often, several | (found["a"] != found["b"])))
        rows = {c: pa.array(v[told]) for c, v in found.items()}
        out = pa.table({"host": pa.array([host] * len(told), pa.string()), "arrays": pa.array([1 + several] * len(told), pa.int32()), **rows})
        if several:  # how many pages the part has
            none = pa.array([None], pa.int64())
            out = pa.concat_tables([out, pa.table({"host": pa.array([host]), "arrays": pa.array([2], pa.int32()), "main": [True], "print": none, "n": [total], "a": none, "b": none})])
        return out

    marked, unmarked = parsed.where("main IS NOT NULL"), parsed.where("main IS NULL")
    is_open = F.col("main").isNull() & F.exists("blocks", lambda x: x["open"])
    parts = F.least(F.ceil(F.sum("size") / array), F.ceil(F.approx_count_distinct("same") / ARRAY_PAGES)).cast("int")
    hosts = parsed.groupBy("host").agg(parts.alias("arrays"), F.max(is_open).alias("asked"))  # asked: a page needs what stands beside main text
    hosts = materialize(hosts.where("arrays > 1 OR asked"), "hosts")
    placed = parsed.select("row", "host", "same", "main", "blocks").join(_for_hosts(hosts, F.lit(5)), "host", "left")
    placed = placed.withColumns({"arrays": F.greatest(F.coalesce("arrays", F.lit(1)), F.lit(1)), "asked": F.coalesce("asked", F.lit(False))})
    spark = pages.sparkSession
    width = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)  # a number, as packs are few bytes, but long to work on

    def sorted_runs(rows: DataFrame, least: int) -> DataFrame:
        """What the arrays of all hosts say; a host alone with fewer than `least` streams has nothing to say."""
        dealt = rows.mapInArrow(deal, "host string, arrays int, part int, main boolean, pages array<bigint>, size bigint, packed binary").repartition(width, "host", "part")
        dealt = dealt.withColumn("__streams", F.sum(F.size("pages")).over(Window.partitionBy("host", "part"))).where(f"arrays > 1 OR __streams >= {least}").drop("__streams")
        return dealt.groupBy("host", "part").applyInArrow(arrays, "host string, arrays int, main boolean, print bigint, n bigint, a bigint, b bigint")

    runs = materialize(sorted_runs(placed.where("main IS NOT NULL").withColumn("blocks", F.lit(None).cast(placed.schema["blocks"].dataType)), NOTICE_PAGES), "runs")
    beside = sorted_runs(placed.where("asked").withColumn("main", F.lit(None).cast("string")), 2)
    repeated = beside.groupBy("print").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("print")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(_windows(h, s, run)) for h, s in zip(b["host"].to_pylist(), streams(b))]
            rows = np.repeat(b["row"].to_numpy(), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], names=["row", "print"])

    asked = unmarked.select("row", "host", "blocks").mapInArrow(windows, "row bigint, print bigint")
    hits = asked.join(repeated, "print").groupBy("row").agg(F.collect_list("print").alias("hits"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, repeats = [], []
            for h, blocks, stream, prints in zip(b["host"].to_pylist(), b["blocks"].to_pylist(), streams(b), b["hits"].to_pylist()):
                gone = covered(len(stream), np.flatnonzero(np.isin(_windows(h, stream, run), np.array(prints or [], np.int64))), run)
                texts.append(_unique_runs([(x["open"], x["text"]) for x in blocks], gone))
                repeats.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([b["key"], b["url"], pa.array(texts, pa.string()), pa.array(repeats, pa.int64())], names=["key", "url", "text", "n_repeated"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(" ".join(text.split("\n")), 0) if notices is None else _without_notices(h, text.split("\n"), np.array(notices, np.int64), run) for h, text, notices in zip(*(b[c].to_pylist() for c in ("host", "main", "notices")))]
            yield pa.RecordBatch.from_arrays([b["key"], b["url"], pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["key", "url", "text", "n_notice"])

    notices = _notices(runs, parsed, run)
    if notices is None:
        left = marked.select("key", "url", F.translate("main", "\n", " ").alias("text"), F.lit(0).cast("long").alias("n_notice"))
    else:
        left = marked.select("key", "url", "host", "main").join(notices, "host", "left").select("key", "url", "host", "main", "notices").mapInArrow(drop, f"key {kind}, url {link}, text string, n_notice bigint")
    judged = unmarked.select("row", "key", "url", "host", "blocks").join(hits, "row", "left").select("key", "url", "host", "blocks", "hits")
    kept = left.unionByName(judged.mapInArrow(clean, f"key {kind}, url {link}, text string, n_repeated bigint"), allowMissingColumns=True)
    return kept.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "n_notice")
