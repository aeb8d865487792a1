"""Main text of pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page is read as a stream of block tags, closed where HTML leaves that open, and blocks of text. Streams of
a host are aligned one after the other: neighbours with the same tag become a repeated group, a tag that some
pages lack an optional one, and text that differs a slot. What the expression then says of a text place, that
it is the same on many pages or lies in the region where most text varies, decides together with the place's
own tags whether it is part of the article. Within a repeated group texts are not told from each other.

Expressions are made in each task from its own pages and then aligned with each other, some at a time, so no
host is ever gathered in one place, however many pages it has.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Elements of HTML by what they are to a text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math object select datalist audio video canvas".split())
OUTSIDE = set("head nav footer aside form dialog search menu fieldset button label input output".split())
#: Elements that an opening tag closes, up to the elements named after the bar.
CLOSES = {
    "li": "li|ul ol menu dir", "dt": "dt dd|dl", "dd": "dt dd|dl", "tr": "tr td th|table", "td": "td th|tr table",
    "th": "td th|tr table", "tbody": "tbody thead tfoot tr td th|table", "tfoot": "tbody thead tfoot tr td th|table",
    "body": "head|html",
}
CLOSES = {k: tuple(set(x.split()) for x in v.split("|")) for k, v in CLOSES.items()}
#: Words of a class, id or role that say an element is not the article's, whatever it holds ...
APART = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion comment comments respond replies"
    " disqus nav navbar navigation breadcrumb breadcrumbs pagination pager footer contentinfo sidebar complementary cookie cookies consent"
    " gdpr newsletter subscribe signup login share sharing social related recommended recommendations popup modal overlay search".split()
)
#: ... and words that say so outside the article only.
ASIDE = set("header masthead banner menu notice notices alert announcement widget rail toolbar tags disclaimer copyright legal skip".split())
#: Words that an element of the article itself may have beside those.
OWN = set("article post entry story content main".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
#: Elements deeper than this are taken for neighbours of those above.
DEEPEST = 60
#: Different children of an element; beyond that order is given up, so that an expression stays small.
CHILDREN = 48
#: Pages whose text a place must share to be taken for the template's.
SHARED_BY = 5
#: Page digests kept of each place; enough to tell SHARED_BY from fewer.
DIGESTS = 8
#: Expressions that a task holds before it passes them on, and partial ones aligned in one step.
HELD, FAN_IN = 2_000, 64

# A place is a list: LABEL, what it is; LEAST and MOST, how often a parent has it (MOST 2: any number); SEEN,
# digests of pages; CHARS and LINKED, characters of text and of links; CONSTANT, a digest of its one text or
# null; CHILDREN_, places in it; BLOCKS, numbers of a page's own text blocks.
LABEL, LEAST, MOST, SEEN, CHARS, LINKED, CONSTANT, CHILDREN_, BLOCKS = range(9)
TEXT = "#"
#: What a place has none of; never changed, so all share it.
NONE: list = []


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 11


# --- reading a page


def _words(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class, id and role; classes without numbers; whether the element is hidden."""
    words, names, hidden = set(), "", False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "itemprop":
            words.update(["article"] if value.lower() == "articlebody" else [])
        else:
            words.update(w.lower() for w in WORD.findall(value))
            if name == "class":
                names = ".".join(sorted(x for x in value.split() if not any(ch.isdigit() for ch in x))[:3])
    return words, names, hidden


def _nature(tag: str, attributes: str) -> tuple[str, str]:
    """The label of an element and its nature: a the article's, o outside it, h outside unless within the article."""
    words, names, hidden = _words(attributes) if attributes.strip(" /") else (set(), "", False)
    nature = "-"
    if tag in OUTSIDE or hidden or words & APART and tag not in ("html", "body"):
        nature = "o"
        if tag in ("main", "article") and not words & {"comment", "comments", "ad", "ads", "sponsored", "promo", "advert", "related"}:
            nature = "a"
    elif tag in ("article", "main") or "main" in words and "role" in attributes and tag not in ("html", "body") or "article" in words and "itemprop" in attributes:
        nature = "a"
    elif tag == "header" or words & ASIDE and not words & OWN and tag not in ("html", "body"):
        nature = "h"
    return f"{tag}|{nature}|{names}" if names else f"{tag}|{nature}", nature


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page: kind is < for an opening tag, / for a closing one, # for text.

    Every part is looked at once: where something has no end, that is noted and not looked for again.
    """
    at, size = 0, len(page)
    endless: set[str] = set()
    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            yield TEXT, page[at:], ""
            return
        if opening > at:
            yield TEXT, page[at:opening], ""
        tag = OPENING.match(page, opening)
        if not tag:
            if page.startswith("<!--", opening) and "--" not in endless:
                end = page.find("-->", opening + 4)
                if end >= 0:
                    at = end + 3
                    continue
                endless.add("--")
            if page[opening + 1 : opening + 2] in ("!", "?") and ">" not in endless:
                end = page.find(">", opening)
                if end >= 0:
                    at = end + 1
                    continue
                endless.add(">")
            yield TEXT, "<", ""
            at = opening + 1
            continue
        end = page.find(">", tag.end()) if ">" not in endless else -1
        if end < 0:
            endless.add(">")
            yield TEXT, page[opening:], ""
            return
        attributes = page[tag.end() : end]
        if ('"' in attributes or "'" in attributes) and (attributes.count('"') % 2 or attributes.count("'") % 2) and "quote" not in endless:
            whole = QUOTED_END.match(page, tag.end())
            if whole:
                end = whole.end() - 1
                attributes = page[tag.end() : end]
            else:
                endless.add("quote")
        at, name = end + 1, tag[2].lower()
        if tag[1]:
            yield "/", name, ""
            continue
        if name in RAW:
            # what it holds is no text of the page
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name not in endless else None
                if close:
                    at = close.end()
                else:
                    endless.add(name)
                    at = size if name in ("script", "style") else at
            continue
        yield "<", name, attributes


class Page:
    """The places of a page, with its blocks of text."""

    def __init__(self, page: str) -> None:
        self.blocks: list[str] = []
        #: Per block: whether its own tags say a (in the article), o or h (outside), and which element begins it.
        self.natures: list[str] = []
        self.tags: list[str] = []
        self.links: list[int] = []
        root = ["", 1, 1, [], 0, 0, None, [], []]
        # (tag, place or null for an inline one, nature of all that is within)
        stack: list[tuple[str, list | None, str]] = [("", root, "-")]
        places = [root]
        self.has_article = False
        muted = linked = 0
        held: list[str] = []
        in_links = 0
        deep: Counter[str] = Counter()

        def within() -> str:
            """The nature of the innermost element that is no inline one."""
            return stack[-1][2] if stack[-1][1] is not None else next(s[2] for s in reversed(stack) if s[1] is not None)

        def flush() -> None:
            nonlocal in_links
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    inner = within()
                    place = [TEXT, 1, 1, NONE, len(text), min(in_links, len(text)), digest(text), NONE, [len(self.blocks)]]
                    places[-1][CHILDREN_].append(place)
                    self.blocks.append(text)
                    self.natures.append(inner)
                    self.tags.append(places[-1][LABEL].split("|")[0])
            in_links = 0

        def pop() -> None:
            nonlocal muted, linked
            tag, place, _ = stack[-1]
            if place is not None:
                flush()
                places.pop()
            else:
                muted -= tag.startswith("!")
                linked -= tag == "a"
            stack.pop()

        for kind, value, attributes in tokens(page):
            if kind == TEXT:
                if not muted:
                    held.append(value)
                    if linked:
                        in_links += len(value)
            elif kind == "<":
                if value in VOID:
                    if value == "hr":
                        flush()
                    elif value == "br":
                        held.append(" ")
                    continue
                if value in BLOCK:
                    if value != "p" and value in CLOSES:
                        own, stops = CLOSES[value]
                        self._close(stack, own, stops, pop)
                    self._close(stack, {"p"}, {"td", "th", "li", "div", "article", "section", "body", "blockquote"}, pop)
                    flush()
                    label, nature = _nature(value, attributes)
                    above = within()
                    if above == "o" or above == "a" and nature in "-ha":
                        nature = above
                    elif above == "h" and nature == "-":
                        nature = "h"
                    self.has_article |= nature == "a"
                    place = [label, 1, 1, NONE, 0, 0, None, [], []]
                    if len(places) < DEEPEST:
                        places[-1][CHILDREN_].append(place)
                        places.append(place)
                        stack.append((value, place, nature))
                    else:  # too deep: its text belongs to the element above
                        deep[value] += 1
                elif len(stack) < 4 * DEEPEST:
                    hide = bool(attributes) and _nature(value, attributes)[1] == "o" or value in OUTSIDE
                    muted += hide
                    linked += value == "a" and not hide
                    stack.append((f"!{value}" if hide else value, None, "-"))
            else:
                if value in BLOCK:
                    if deep[value]:
                        flush()
                        deep[value] -= 1
                    elif any(s[0] == value for s in stack):
                        while stack[-1][0] != value:
                            pop()
                        pop()
                else:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0].lstrip("!") == value:
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k][1] is not None:
                            break
        while len(stack) > 1:
            pop()
        flush()
        self._free(root[CHILDREN_])
        self.digest = digest("\n".join(self.blocks))
        self._seen(root, [self.digest])
        self.places = folded(root[CHILDREN_])

    @staticmethod
    def _close(stack: list, own: set[str], stops: set[str], pop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in own:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in stops:
                return

    def _free(self, places: list) -> None:
        """Takes elements that hold the article itself, whatever their class says, for parts of the page."""
        for place in places:
            if place[LABEL] == TEXT:
                continue
            tag, nature, *_ = place[LABEL].split("|")
            self._free(place[CHILDREN_])
            if nature == "o" and tag not in OUTSIDE and self._holds_article(place):
                self._renamed(place, "-")

    def _holds_article(self, place: list) -> bool:
        return any(p[LABEL].split("|")[0] in ("article", "main") and "|a" in p[LABEL] or p[LABEL] != TEXT and self._holds_article(p)
                   for p in place[CHILDREN_])

    def _renamed(self, place: list, above: str) -> None:
        """Judges a freed element and what it holds again."""
        tag, _, *names = place[LABEL].split("|")
        place[LABEL] = "|".join([tag, "-", *names])
        self._judge(place, above)

    def _judge(self, place: list, above: str) -> None:
        for p in place[CHILDREN_]:
            if p[LABEL] == TEXT:
                self.natures[p[BLOCKS][0]] = above
                continue
            nature = p[LABEL].split("|")[1]
            if above == "o" or above == "a" and nature in "-ha" or above == "h" and nature == "-":
                nature = above
            self.has_article |= nature == "a"
            self._judge(p, nature)

    def _seen(self, place: list, seen: list[int]) -> None:
        place[SEEN] = seen
        for p in place[CHILDREN_]:
            self._seen(p, seen)


# --- aligning


def aligned(one: list, other: list) -> Iterator[tuple[list | None, list | None]]:
    """Pairs of two rows of places with the same label, most of them possible, in order; null where one lacks it."""
    a, b = 0, 0
    while a < len(one) and a < len(other) and one[a][LABEL] == other[a][LABEL]:
        yield one[a], other[a]
        a += 1
    b = a
    x, y = len(one), len(other)
    tail = []
    while x > a and y > b and one[x - 1][LABEL] == other[y - 1][LABEL]:
        x, y = x - 1, y - 1
        tail.append((one[x], other[y]))
    if a < x and b < y:
        longest = [[0] * (y - b + 1) for _ in range(x - a + 1)]
        for i in range(x - a - 1, -1, -1):
            for j in range(y - b - 1, -1, -1):
                if one[a + i][LABEL] == other[b + j][LABEL]:
                    longest[i][j] = 1 + longest[i + 1][j + 1]
                else:
                    longest[i][j] = max(longest[i + 1][j], longest[i][j + 1])
        i = j = 0
        while a + i < x and b + j < y:
            if one[a + i][LABEL] == other[b + j][LABEL]:
                yield one[a + i], other[b + j]
                i, j = i + 1, j + 1
            elif longest[i + 1][j] >= longest[i][j + 1]:
                yield one[a + i], None
                i += 1
            else:
                yield None, other[b + j]
                j += 1
        a, b = a + i, b + j
    yield from ((p, None) for p in one[a:x])
    yield from ((None, p) for p in other[b:y])
    yield from reversed(tail)


def merged(one: list, other: list) -> list:
    """Two places with the same label as one; the first one's blocks are taken over."""
    one[BLOCKS].extend(other[BLOCKS])
    seen = one[SEEN] if one[SEEN] == other[SEEN] else sorted({*one[SEEN], *other[SEEN]})[:DIGESTS]
    return [
        one[LABEL],
        min(one[LEAST], other[LEAST]),
        max(one[MOST], other[MOST]),
        seen,
        one[CHARS] + other[CHARS],
        one[LINKED] + other[LINKED],
        one[CONSTANT] if one[CONSTANT] == other[CONSTANT] else None,
        together(one[CHILDREN_], other[CHILDREN_]) if one[CHILDREN_] or other[CHILDREN_] else NONE,
        one[BLOCKS],
    ]


def _optional(place: list) -> list:
    return [place[LABEL], 0, *place[MOST:]]


def together(one: list, other: list) -> list:
    """Two rows of places as one: mismatches become optional."""
    if len(one) == len(other) and all(x[LABEL] == y[LABEL] for x, y in zip(one, other)):
        rows = list(map(merged, one, other))  # as usual: nothing to align
    else:
        rows = [merged(x, y) if x and y else _optional(x or y) for x, y in aligned(one, other)]
    if len(rows) > CHILDREN:
        by_label: dict[str, list] = {}
        for place in rows:
            # places without number and order; many different classes count no more
            label = place[LABEL] if place[LABEL] == TEXT else "|".join(place[LABEL].split("|")[:2])
            place = [label, 0, 2, *place[SEEN:]]
            by_label[label] = merged(by_label[label], place) if label in by_label else place
        rows = list(by_label.values())
    return rows


def folded(places: list) -> list:
    """A row of places with neighbours, or pairs and triples of neighbours, that repeat as one repeated group."""
    rows: list[list] = []
    for place in places:
        if place[CHILDREN_]:
            place = [*place[:CHILDREN_], folded(place[CHILDREN_]), place[BLOCKS]]
        rows.append(place)
        for size in (1, 2, 3):
            if len(rows) < 2 * size:
                break
            # most neighbours differ in their last place already
            if rows[-1][LABEL] == rows[-1 - size][LABEL] and all(rows[-k][LABEL] == rows[-k - size][LABEL] for k in range(2, size + 1)):
                group = [merged(a, b) for a, b in zip(rows[-2 * size : -size], rows[-size:])]
                rows[-2 * size :] = [[p[LABEL], p[LEAST], 2, *p[SEEN:]] for p in group]
                break
    return rows


def expression(places: list) -> str:
    """An expression as text: # is a slot, quotes a text that all pages share."""

    def one(place: list) -> str:
        tag = place[LABEL].split("|")[0]
        inner = ("#" if place[CONSTANT] is None else '"') if place[LABEL] == TEXT else f"<{tag}>{expression(place[CHILDREN_])}</{tag}>"
        sign = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[place[LEAST], place[MOST]]
        return f"({inner}){sign}" if sign else inner

    return "".join(map(one, places))


# --- judging


def rules(places: list) -> list:
    """What extraction needs of an expression: per place its label, whether its text is the template's, whether
    it lies in the region where most text varies, and what it holds."""
    best, most = None, 0.0

    def weigh(place: list) -> float:
        nonlocal best, most
        if place[LABEL] == TEXT:
            varies = place[CONSTANT] is None or len(place[SEEN]) < SHARED_BY
            return max(0, place[CHARS] - 3 * place[LINKED]) if varies else 0
        tag, nature, *_ = place[LABEL].split("|")
        if nature in "oh":
            return 0
        inner = sum(map(weigh, place[CHILDREN_]))
        if tag in ("body", "div", "section", "main", "article", "td", "table", "center") and inner > most:
            best, most = place, inner
        return inner * (0.8 if tag in ("div", "section", "td", "table", "center") else 1.0)

    for place in places:
        weigh(place)

    def kept(place: list, within: bool) -> list:
        within = within or place is best
        shared = place[LABEL] == TEXT and place[CONSTANT] is not None and len(place[SEEN]) >= SHARED_BY
        return [place[LABEL], int(shared), int(within), [kept(p, within) for p in place[CHILDREN_]]]

    return [kept(p, False) for p in places]


def main_text(page: str, rule: list) -> str:
    """The article of a page, by the rules of its host's expression: a line for each block."""
    read = Page(page)
    shared, region = set(), set()

    def match(places: list, known: list) -> None:
        for place, rule in aligned(places, known):
            if place and rule:
                if place[LABEL] == TEXT:
                    shared.update(place[BLOCKS] if rule[1] else ())
                    region.update(place[BLOCKS] if rule[2] else ())
                else:
                    match(place[CHILDREN_], rule[3])

    match(read.places, rule)
    numbers = range(len(read.blocks))
    if read.has_article:
        chosen = [i for i in numbers if read.natures[i] == "a"]
    else:
        inside = [i for i in numbers if read.natures[i] == "-"]
        chosen = [i for i in inside if i in region]
        if chosen:
            # a heading before the region is the article's
            heads = [i for i in inside if i < chosen[0] and read.tags[i] == "h1"]
            chosen = heads[-1:] + chosen
        else:
            chosen = inside
    size = sum(len(read.blocks[i]) for i in chosen)
    if 2 * sum(len(read.blocks[i]) for i in chosen if i in shared) < size:
        chosen = [i for i in chosen if i not in shared]
    return "\n".join(read.blocks[i] for i in chosen)


# --- over a table


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", F.coalesce(host, F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, the expression of all its pages as JSON."""

    def passed(held: dict[str, list]) -> pa.RecordBatch:
        made = [json.dumps(w, separators=(",", ":")) for w in held.values()]
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(made, pa.string())], names=["host", "wrapper"])
        held.clear()
        return batch

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                places = _without_blocks(Page(page).places)
                held[host] = together(held[host], places) if host in held else places
                if len(held) > HELD:
                    yield passed(held)
        yield passed(held)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted, so only one host is held
        held: dict[str, list] = {}
        for batch in batches:
            for host, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                if held and host not in held:
                    yield passed(held)
                held[host] = together(held[host], json.loads(wrapper)) if host in held else json.loads(wrapper)
        yield passed(held)

    parts = _hosted(pages).select("host", "html").mapInArrow(read, "host string, wrapper string")
    parts = stored(parts.withColumn("part", F.spark_partition_id()), "wrappers")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # by steps, so that a host with pages everywhere is aligned in many tasks first
        left = -(-left // FAN_IN)
        parts = parts.select("host", "wrapper", F.pmod("part", F.lit(left)).cast("int").alias("step"))
        dealt = parts.repartition("host", "step").sortWithinPartitions("step", "host", F.xxhash64("wrapper"))
        done = dealt.select("host", "wrapper").mapInArrow(align, "host string, wrapper string")
        if left == 1:
            return stored(done, "wrappers")
        parts = stored(done.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(left))), "wrappers")


def _without_blocks(places: list) -> list:
    return [[*p[:CHILDREN_], _without_blocks(p[CHILDREN_]), []] for p in places]


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url and text, the article without what stands around it; empty if there is none.

    A null or empty page has an empty text. Pages without a url are aligned with each other. Each row gives one
    row, repeated ones too; the same text on repeated pages is not taken for the template's. An empty table
    gives none. Only page_id, url and html are read, whatever other columns there are. Pages are read whole, in
    time that grows with their length, also where comments, quotes or tags have no end.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rule = known.get(wrapper)
                if rule is None:
                    if len(known) > HELD:
                        known.clear()
                    rule = known[wrapper] = rules(json.loads(wrapper)) if wrapper else []
                texts.append(main_text(page, rule))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # one row a host; Spark broadcasts them where their size allows, else splits the pages of hot hosts
    rows = _hosted(pages).join(wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(extract, "page_id long, url string, text string")
