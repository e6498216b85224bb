"""Main text of pages by union-free regular expressions inferred for each host.

A page is a stream of tags and texts, nested as far as its tags say (unclosed paragraphs end where the next block
begins).  Within a page, neighbouring equal elements fold into repeated ones and recurring runs into repeated
groups; texts become slots.  The folded streams of a host are then aligned with its wrapper one after another:
what both have is merged, what one lacks becomes optional, what recurs becomes a repeated group.  No unions are
needed, as a level has each label once.  A wrapper looks like

    html(head(title(#)) body(nav(ul(li+(a(#)))) article(h1(#) p+(b?(# br?) #?)) footer(#)))

Each page is matched with its host's wrapper, level by level: an automaton over the level's places, optional and
repeated groups included, gives every element and text its place.  A slot is a text's place with those of its
elements, so equal names inside and outside a group are different slots.  Each slot is judged once for the host: by
the element and class names around it, and, where no article or main element frames the text, by the slot's
share of linked text and whether at least three distinct pages, copies and mirrors counted once, all say the same
there.  A last match gives the texts of the main slots.

Scale: pages fold and slot sums add up on the map side, so a host with a third of all pages arrives at its
inference as its distinct streams and at its judgement as one row per slot.  Hosts of more than `STREAMS` distinct
streams are aligned as a tree: streams are dealt by hash into groups of bounded size, each group becomes one stream,
and so on until one group is left.  Groups and their order follow from the streams alone, so the wrapper doesn't
depend on how pages are dealt to tasks.  Wrappers are broadcast only if their measured size is under
`broadcast_bytes`; else pages join them by host, which Spark may split by skew.

Cases: a null or empty html gives an empty text, a null or odd url the host ''.  Tags that never close, stray ends,
cut-off pages and repeated rows are read as they come; a page of any length is read whole.  Elements nested deeper
than 64 share their ancestor's slot; their texts are kept.  Of several ways to match a page, that through the earliest
places counts.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, sliced

BROADCAST_BYTES = 32 << 20
DEEPEST = 64
#: Distinct pages from which a slot that says the same on all of them is boilerplate.
DISTINCT_PAGES = 3
#: Distinct streams that are aligned in one task.
STREAMS = 512

# Element names by role, and words of class, id and role attributes that tell boilerplate or content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea input dialog menu object svg canvas title option noembed noframes".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN_WORDS = frozenset("main".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
LISTS = frozenset("ul ol dl table menu select".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


def _label(tag: str, attributes: str) -> str:
    """The element's name and the telling words of its class, id and role."""
    if "=" not in attributes:
        return tag
    words = {w.lower() for m in _NAMED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
    return ".".join([tag, *sorted(words & (BOILERPLATE_WORDS | MAIN_WORDS))])


def events(page: str):
    """('open', label, tag), ('close', label, tag), ('text', text, None) and ('break', None, tag) in page order, balanced."""
    stack: list[tuple[str, str]] = []
    blocks: list[int] = []  # depths of the elements that aren't inline
    opened: dict[str, int] = {}  # by name, so that a stray end costs nothing
    at, lower = 0, None

    def pop_to(depth):
        while len(stack) > depth:
            tag, label = stack.pop()
            opened[tag] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            yield "close", label, tag

    while at < len(page):
        m = _TOKEN.match(page, at)
        if not m:  # a tag that never ends is text
            end = page.find("<", at + 1)
            end = len(page) if end < 0 else end
            yield "text", page[at:end], None
            at = end
            continue
        at = m.end()
        if m[4]:
            yield "text", m[4], None
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:  # all of these are closed, so each is passed once
                    depth -= 1
                yield from pop_to(depth)
            continue
        if tag in ENDS_PARAGRAPH or tag in ENDED_BY:
            ends = ENDED_BY.get(tag) or frozenset(["p"])
            below = len(blocks) - 1
            while below >= 0:
                name = stack[blocks[below]][0]
                if name in ends:
                    yield from pop_to(blocks[below])
                    if tag != "tr":
                        break
                elif name != "p":
                    break
                below -= 1
        label = _label(tag, m[3])
        if tag in VOID or m[3].endswith("/"):
            yield "break", label, tag
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            end = lower.find("</" + tag, at)
            yield "open", label, tag
            if end < 0:
                end = len(page)
            if end > at:
                yield "text", page[at:end], None
            yield "close", label, tag
            stop = page.find(">", end)
            at = len(page) if stop < 0 else stop + 1
            continue
        if tag not in INLINE:
            blocks.append(len(stack))
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, label))
        yield "open", label, tag
    yield from pop_to(0)


# --- wrappers: [label, least, most, children]; "#" is a text slot, "()" a group ---------------------------------

Item = list


def _key(item: Item) -> str:
    return _key(item[3][0]) if item[0] == "()" else item[0]


def _labels(item: Item) -> set[str]:
    return {x for i in item[3] for x in _labels(i)} if item[0] == "()" else {item[0]}


def _many(item: Item) -> Item:
    return [item[0], item[1], 2, item[3]]


def _merged_item(a: Item, b: Item) -> Item:
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), aligned(a[3], b[3])]


def folded(items: list[Item]) -> list[Item]:
    """Repeats folded until each label stands once."""
    out: list[Item] = []
    for item in items:
        if out and _key(out[-1]) == _key(item) and (out[-1][0] == "()") == (item[0] == "()"):
            out[-1] = _many(_merged_item(out[-1], item))
        else:
            out.append(item)
    while True:
        places: dict[str, list[int]] = {}
        for k, item in enumerate(out):
            places.setdefault(_key(item), []).append(k)
        again = next((p for p in places.values() if len(p) > 1), None)
        if again is None:
            return out
        parts = [out[a:b] for a, b in zip(again, [*again[1:], len(out)])]
        # what only the last part has, at its end, stands after the group
        others = {x for part in parts[:-1] for i in part for x in _labels(i)}
        tail: list[Item] = []
        while len(parts[-1]) > 1 and not _labels(parts[-1][-1]) & others:
            tail.insert(0, parts[-1].pop())
        group = parts[0]
        for part in parts[1:]:
            group = aligned(group, part)
        if len(group) == 1:
            single = group[0]
            out = out[: again[0]] + [_many(single)] + tail
        else:
            out = out[: again[0]] + [["()", min(1, max(i[1] for i in group)), 2, group]] + tail


def _regrouped(items: list[Item], other: list[Item]) -> list[Item]:
    """Items that the other list has in a group, as a group that stands once."""
    for group in other:
        if group[0] != "()":
            continue
        inside, key = _labels(group), _key(group)
        for k, item in enumerate(items):
            if item[0] != "()" and _key(item) == key:
                stop = k + 1
                while stop < len(items) and _labels(items[stop]) <= inside:
                    stop += 1
                items = items[:k] + [["()", item[1], 1, items[k:stop]]] + items[stop:]
                break
    return items


def aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """One list that both match: common items merged along a longest common subsequence, others optional."""
    if a == b:
        return a
    a, b = _regrouped(a, b), _regrouped(b, a)
    keys_a, keys_b = [(_key(i), i[0] == "()") for i in a], [(_key(i), i[0] == "()") for i in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if keys_a[i] == keys_b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and keys_a[i] == keys_b[j]:
            out.append(_merged_item(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return folded(out)


def expression(items: list[Item]) -> str:
    """The wrapper as a regular expression over tags and slots."""
    out = []
    for label, least, most, children in items:
        mark = ("*" if most > 1 else "?") if not least else "+" if most > 1 else ""
        inner = expression(children)
        out.append(f"({inner}){mark}" if label == "()" else f"{label}{mark}" + (f"({inner})" if inner else ""))
    return " ".join(out)


@dataclass
class Reading:
    """A page's folded stream."""

    items: list[Item]


def read(page: str) -> Reading:
    levels: list[list[Item]] = [[]]
    deep = 0
    for kind, value, _ in events(page):
        if kind == "open":
            if len(levels) > DEEPEST:
                deep += 1
                continue
            levels.append([])
        elif kind == "close":
            if deep:
                deep -= 1
                continue
            children = folded(levels.pop())
            levels[-1].append([value, 1, 1, children])
            if len(levels[-1]) > 1 and levels[-1][-2][0] == value:  # folds on the way, so levels stay short
                last = levels[-1].pop()
                levels[-1][-1] = _many(_merged_item(levels[-1][-1], last))
        elif kind == "break":
            levels[-1].append([value, 1, 1, []])
        elif not value.isspace() and not (levels[-1] and levels[-1][-1][0] == "#"):
            levels[-1].append(["#", 1, 1, []])
    return Reading(folded(levels[0]))


# --- matching: a page's slots are places of its host's wrapper ----------------------------------------------------

#: Stands between a name and its place; white space, so no tag holds it.
_AT = "\x1f"


class Level:
    """One level of a wrapper as an automaton: its places, those that may begin it and those that may follow each."""

    def __init__(self, items: list[Item]):
        self.items: list[Item] = []
        self.places: dict[str, list[int]] = {}
        self.follow: list[set[int]] = []
        self.first, self.last, _ = self._sequence(items)
        self.once = all(len(k) == 1 for k in self.places.values())
        self.below: dict[int, Level] = {}

    def _sequence(self, items: list[Item]) -> tuple[set[int], set[int], bool]:
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for label, least, most, children in items:
            if label == "()":
                begins, ends, skipped = self._sequence(children)
            else:
                k = len(self.items)
                self.items.append([label, least, most, children])
                self.follow.append(set())
                self.places.setdefault(label, []).append(k)
                begins, ends, skipped = {k}, {k}, False
            skipped = skipped or not least
            for k in [*last, *(ends if most > 1 else ())]:
                self.follow[k] |= begins
            first = first | begins if empty else first
            last = last | ends if skipped else ends
            empty = empty and skipped
        return first, last, empty

    def child(self, place: int) -> Level | None:
        if place < 0:
            return None
        if place not in self.below:
            self.below[place] = Level(self.items[place][3])
        return self.below[place]

    def match(self, labels: list[str]) -> list[int]:
        """The place of each label, of several ways the one through the earliest places; -1 if there is none."""
        if self.once:
            return [self.places[x][0] if x in self.places else -1 for x in labels]
        reached: list[list[int]] = []
        now = self.first
        for label in labels:
            all_places = self.places.get(label, [])
            here = [k for k in all_places if k in now] or all_places
            reached.append(here)
            if here:
                now = self.follow[here[0]] if len(here) == 1 else set().union(*(self.follow[k] for k in here))
        out, after = [-1] * len(labels), None
        for at in range(len(labels) - 1, -1, -1):
            if reached[at]:
                fits = [k for k in reached[at] if (k in self.last if after is None else after in self.follow[k])]
                out[at] = after = (fits or reached[at])[0]
        return out


def matched(page: str, wrapper: Level) -> list[tuple[str, str, str, str | None, bool]]:
    """The page's events under its host's wrapper: kind, value, tag, slot (of a text that isn't blank) and whether it
    is linked.  A slot is named by its elements, each with its place in the wrapper."""
    labels: list[list[str]] = [[]]
    children: list[list[int]] = [[]]
    inside, found, deep = [0], [], 0
    for kind, value, tag in events(page):
        here, spot = inside[-1], None
        if kind == "open":
            if len(inside) > DEEPEST:
                deep += 1
            else:
                labels[here].append(value)
                children[here].append(len(labels))
                inside.append(len(labels))
                labels.append([])
                children.append([])
        elif kind == "close":
            if deep:
                deep -= 1
            else:
                inside.pop()
        elif kind == "break" or not value.isspace():
            label = value if kind == "break" else "#"
            if label != "#" or not (labels[here] and labels[here][-1] == "#"):
                labels[here].append(label)
                children[here].append(-1)
            spot = (here, len(labels[here]) - 1) if label == "#" else None
        found.append((kind, value, tag, spot))
    names, linked = [""] * len(labels), [False] * len(labels)
    levels: list[Level | None] = [wrapper] * len(labels)
    places: list[list[int]] = []
    for node, (own, below) in enumerate(zip(labels, children)):  # an element stands after its parent
        level = levels[node]
        places.append(level.match(own) if level else [-1] * len(own))
        for label, k, child in zip(own, places[-1], below):
            if child >= 0:
                names[child] = f"{names[node]}/{label}{_AT}{k}"
                linked[child] = linked[node] or label.split(".")[0] == "a"
                levels[child] = level.child(k) if level else None
    return [(kind, value, tag, None, False) if spot is None else (kind, value, tag, f"{names[spot[0]]}{_AT}#{places[spot[0]][spot[1]]}", linked[spot[0]]) for kind, value, tag, spot in found]


def page_slots(page: str, wrapper: Level) -> dict[str, list[int]]:
    """By slot: characters, linked characters and a hash of the texts."""
    out: dict[str, list[int]] = {}
    for _, value, _, slot, linked in matched(page, wrapper):
        if slot is not None:
            said = value.strip()
            row = out.setdefault(slot, [0, 0, 0])
            row[0] += len(said)
            row[1] += len(said) if linked else 0
            row[2] = hash_text(row[2], said)
    return out


def hash_text(before: int, text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"), before)


def _parts(path: str) -> list[tuple[str, frozenset[str]]]:
    names = [p.partition(_AT)[0].split(".") for p in path.split("/")[1:]]
    return [(name[0], frozenset(name[1:])) for name in names]


def _is_boilerplate(path: str) -> bool:
    """Whether a name on the way to the slot says so; html, body and main parts can't be meant by their words."""
    return any(tag in BOILERPLATE_TAGS or words & BOILERPLATE_WORDS and tag not in ("html", "body", "article", "main") for tag, words in _parts(path))


def _is_framed(path: str) -> bool:
    return any(tag in ("article", "main") or words & MAIN_WORDS and tag not in ("html", "body") for tag, words in _parts(path))


def _block_of(path: str) -> str:
    """The slot's path without the inline elements at its end."""
    parts = path.split("/")
    while len(parts) > 1 and parts[-1].partition(_AT)[0].split(".")[0] in INLINE:
        parts.pop()
    return "/".join(parts).partition(f"{_AT}#")[0]


def said_hash(slots: dict[str, list[int]]) -> int:
    """What a page says outside boilerplate elements, so that copies and mirrors of a page count once."""
    data = json.dumps(sorted((slot, row[0], row[2]) for slot, row in slots.items() if not _is_boilerplate(slot)))
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def main_slots(slots: dict[str, tuple[int, int, int, bool]]) -> tuple[list[str], list[str]]:
    """Of a host's slots (characters, linked characters, distinct pages, always the same): the framed main ones, and
    those that are main in a page without a frame."""
    framed = [p for p in slots if _is_framed(p) and not _is_boilerplate(p)]
    # links inside a block are judged with the block's other text
    blocks: dict[str, list[int]] = {}
    for path, (chars, linked, _, _) in slots.items():
        block = blocks.setdefault(_block_of(path), [0, 0])
        block[0] += chars
        block[1] += linked
    loose = []
    for path, (_, _, pages, same) in slots.items():
        chars, linked = blocks[_block_of(path)]
        if not _is_framed(path) and not _is_boilerplate(path) and 2 * linked <= chars and not (same and pages >= DISTINCT_PAGES):
            loose.append(path)
    return sorted(framed), sorted(loose)


def page_host(url: str | None) -> str:
    _, mark, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].translate(_ASCII_LOWER) if mark else ""


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def infer_wrappers(pages: DataFrame, url="url", html="html", streams=STREAMS) -> DataFrame:
    """One row per host: host, wrapper (expression), items (the wrapper as JSON), n_pages."""
    def fold(batches):
        for batch in batches:
            sums: dict[tuple, int] = {}
            for address, page in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist()):
                stream = (page_host(address), json.dumps(read(page or "").items, separators=(",", ":")))
                sums[stream] = sums.get(stream, 0) + 1
            columns = [[k[0] for k in sums], [k[1] for k in sums], list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["host", "name", "pages"])

    def united(group: pd.DataFrame) -> list[Item]:
        wrapper: list[Item] = []
        for k, stream in enumerate(sorted(set(group["name"]))):
            wrapper = json.loads(stream) if not k else aligned(wrapper, json.loads(stream))
        return wrapper

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], json.dumps(united(group), separators=(",", ":")), int(group["pages"].sum()))], columns=["host", "name", "pages"])

    def infer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        wrapper = united(group)
        return pd.DataFrame([(key[0], expression(wrapper), json.dumps(wrapper, separators=(",", ":")), int(group["pages"].sum()))], columns=["host", "wrapper", "items", "n_pages"])

    found = cut(pages.select(url, html).mapInArrow(fold, "host string, name string, pages long").groupBy("host", "name").agg(F.sum("pages").alias("pages")), "streams")
    while True:
        wide = cut(found.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > streams), "wide")
        if wide.isEmpty():
            break
        dealt = found.join(wide, "host").withColumn("part", F.pmod(F.xxhash64("name"), F.ceil(2 * F.col("n") / streams)))
        merged = dealt.groupBy("host", "part").applyInPandas(merge, "host string, name string, pages long")
        before, found = found, cut(found.join(wide, "host", "left_anti").unionByName(merged).groupBy("host", "name").agg(F.sum("pages").alias("pages")), "streams")
        free(before, wide)
    return found.groupBy("host").applyInPandas(infer, "host string, wrapper string, items string, n_pages long")


def judge_slots(joined: DataFrame, html="html") -> DataFrame:
    """One row per host: host, framed and loose (its main slots), of pages with their page_host and its wrapper's items."""
    schema = "host string, name string, said long, chars long, linked long, low long, high long"

    def add_up(batches):
        for batch in batches:
            wrappers: dict[str, Level] = {}
            sums: dict[tuple, list[int]] = {}
            said: dict[tuple, set[int]] = {}
            for page, host, items in zip(batch.column(html), batch.column("page_host").to_pylist(), batch.column("items")):
                if host not in wrappers:
                    wrappers[host] = Level(json.loads(items.as_py() or "[]"))
                slots = page_slots(page.as_py() or "", wrappers[host])
                whole = said_hash(slots)
                for slot, (chars, linked, tag) in slots.items():
                    row = sums.setdefault((host, slot), [0, 0, tag, tag])
                    row[0] += chars
                    row[1] += linked
                    row[2], row[3] = min(row[2], tag), max(row[3], tag)
                    pages = said.setdefault((host, slot), set())
                    if len(pages) < DISTINCT_PAGES:  # more aren't asked for
                        pages.add(whole)
            # a row for each of a slot's first distinct pages; its sums stand in one of them
            rows = [(*k, whole, *(v if not n else (0, 0, v[2], v[3]))) for k, v in sums.items() for n, whole in enumerate(said[k])]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "name", "said", "chars", "linked", "low", "high"])

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = (group[c].tolist() for c in ("name", "chars", "linked", "pages", "low", "high"))
        framed, loose = main_slots({name: (chars, linked, n, low == high) for name, chars, linked, n, low, high in zip(*columns)})
        return pd.DataFrame([(key[0], framed, loose)], columns=["host", "framed", "loose"])

    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high")]
    found = joined.select(html, "page_host", "items").mapInArrow(add_up, schema).groupBy("host", "name", "said").agg(*sums)
    found = found.groupBy("host", "name").agg(F.count(F.lit(1)).alias("pages"), *sums)
    return found.groupBy("host").applyInPandas(judge, "host string, framed array<string>, loose array<string>")


def main_text(page: str, wrapper: Level, framed: frozenset[str], loose: frozenset[str]) -> str:
    """The blocks of the page's main slots, joined by two line ends."""
    found: dict[bool, list[str]] = {True: [], False: []}
    open_blocks: dict[bool, list[str]] = {True: [], False: []}

    def flush():
        for k, parts in open_blocks.items():
            if parts:
                block = " ".join("".join(parts).split())
                if block:
                    found[k].append(block)
                parts.clear()

    for kind, value, tag, slot, _ in matched(page, wrapper):
        if kind == "text":
            if slot in framed:
                open_blocks[True].append(entities.unescape(value))
            elif slot in loose:
                open_blocks[False].append(entities.unescape(value))
            elif slot is None:  # a blank between inline elements
                for parts in open_blocks.values():
                    if parts:
                        parts.append(" ")
        elif tag not in INLINE:
            flush()
        elif tag == "br":
            for parts in open_blocks.values():
                if parts:
                    parts.append(" ")
    flush()
    return "\n\n".join(found[True] or found[False])


def extract_main_text(pages: DataFrame, page_id="page_id", url="url", html="html", broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points), host."""
    inferred = cut(infer_wrappers(pages, url, html).select(F.col("host").alias("w_host"), "items"), "wrappers")
    host = F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    rows = pages.select(F.col(page_id), F.col(url), F.col(html), host.alias("page_host"))

    def with_host(wrappers: DataFrame, size) -> DataFrame:
        n = wrappers.agg(F.sum(size)).first()[0] or 0
        return rows.join(F.broadcast(wrappers) if n <= broadcast_bytes else wrappers, F.col("page_host") == F.col("w_host"), "left").drop("w_host")

    size = F.octet_length(F.concat_ws("", "w_host", "items"))
    judged = judge_slots(with_host(inferred, size), html)
    wrappers = cut(inferred.join(judged, F.col("w_host") == F.col("host"), "left").select("w_host", "items", "framed", "loose"), "judged")
    joined = with_host(wrappers, size + F.octet_length(F.concat_ws("", F.array_join("framed", ""), F.array_join("loose", ""))))
    schema = T.StructType([pages.schema[page_id], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("host", T.StringType())])

    def run(batches):
        for batch in sliced(batches):
            texts, sets = [], {}
            for page, site, items, framed, loose in zip(batch.column(html), batch.column("page_host").to_pylist(), batch.column("items"), batch.column("framed"), batch.column("loose")):
                if site not in sets:
                    sets[site] = (Level(json.loads(items.as_py() or "[]")), frozenset(framed.as_py() or ()), frozenset(loose.as_py() or ()))
                texts.append(main_text(page.as_py() or "", *sets[site]))
            yield pa.RecordBatch.from_arrays([batch.column(page_id), batch.column(url), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column("page_host")], names=schema.names)

    return joined.mapInArrow(run, schema)
