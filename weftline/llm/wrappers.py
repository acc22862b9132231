"""HTML extraction: union-free wrappers of each host, found by aligning its pages' token streams.

A page is a stream of tags and text slots. A stretch that repeats at once is folded into a
repeated group. The streams of a host are aligned one after the other with the wrapper so
far; what one of them lacks becomes optional, a stretch that repeats in either becomes a
repeated group in both, and text that differs becomes an open slot, text that never does
stays fixed, in a group as well. Wrappers of parts of a host align the same way, so a host's
pages need not meet in one place. The elements around a slot say whether it can hold main
text, and the wrapper decides: fixed text of enough pages is furniture, open slots are text.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import put_back, set_aside
from weftline.llm.urls import host_of
from weftline.session import cut_lineage

# Element names of HTML, and words that name what is not main text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr", "td", "th"}
MAIN = {"article", "main"}
ASIDE = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "object", "audio", "video", "canvas"}
NOT_MAIN = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "complementary", "contentinfo", "header", "gdpr",
    "masthead", "widget", "disclaimer", "copyright", "reactions", "ad-container", "ad-slot", "comment-list", "comments-area", "cookie-banner",
    "cookie-consent", "cookie-notice", "main-nav", "newsletter-signup", "related-articles", "related-posts", "share-buttons", "site-footer",
    "site-header", "social-links", "social-share", "post-comments", "reader-comments", "user-reviews", "top-menu", "main-menu", "side-menu",
    "cookie-bar", "ad-banner", "ad-box", "sidebar-left", "sidebar-right", "left-sidebar", "right-sidebar", "related-links", "see-also",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")

#: Pages with different main text, and the share of all of the host's, whose equal text makes it furniture.
FIXED, SHARE = 3, 0.25


def _names(attributes: str, tag: str) -> tuple[str, bool]:
    """Whole classes, roles and ids (a heading's id is an anchor) that are in NOT_MAIN, and whether the element is hidden."""
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "role") or name == "id" and tag not in HEADINGS:
            words += value.lower().replace("_", "-").split()
    return ".".join(dict.fromkeys(w for w in words if w in NOT_MAIN)), hidden


def stream(page: str) -> list[tuple[str, str | None]]:
    """The page's tokens: (``<tag>`` or ``</tag>`` of block elements, None) and (``#path``, text).

    The path of a text slot names the block elements around it, outermost first, with what
    their names say. Inline tags part no text. Text of scripts, styles and the like, comments
    and hidden elements is left out.
    """
    out: list[tuple[str, str | None]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    path = ""

    def flush() -> None:
        if text:
            words = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if words:
                out.append((f"#{path}", words))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            text.append(page[at:])
            break
        if match.start() > at:
            text.append(page[at:match.start()])
        at = match.end()
        tag = match[2].lower() if match[2] else None
        if tag is None:
            continue
        if tag in RAW and not match[1]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            if tag not in INLINE:
                text.append(" ")
            continue
        if tag in INLINE:
            names, hidden = _names(match[3], tag) if match[3] and not match[1] else ("", False)
            if tag in ("br", "td", "th"):
                text.append(" ")
            if not (names or hidden) and not any(t == tag for t, _ in stack):
                continue
            if tag in VOID:
                continue
        flush()
        if match[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                out.append((f"</{tag}>", None))
        else:
            names, hidden = _names(match[3], tag)
            # A tag that can't stand in an open paragraph, or follows its own kind, ends it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()) or stack[k][0] == "p" and tag not in INLINE:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            label = f"{tag}{'.' + names if names and tag not in MAIN | {'html', 'body'} else ''}{'!' if hidden else ''}"
            out.append((f"<{label}>", None))
            if tag not in VOID and not match[3].rstrip().endswith("/"):
                stack.append((tag, label))
        path = "/".join(label for _, label in stack)
    flush()
    return out


# A wrapper is a list of parts [kind, optional, slots, pages]: kind is a token's key or, for a repeated group,
# the list of its tokens' keys; slots has for each text key in it the hashes of texts that every one of the
# counted pages has there, and the most texts that one may have.
Slots = dict[str, tuple[frozenset[int], int]]


def _key(part: list) -> str:
    return part[0] if isinstance(part[0], str) else "+" + "\0".join(part[0])


def _joined(parts: list[list]) -> tuple[Slots, int]:
    """The slots, and the pages, if these parts become one."""
    pages = max(p[3] for p in parts)
    slots: Slots = {}
    for p in parts:
        for key, (fixed, most) in p[2].items():
            held, n = slots.get(key, (frozenset(), 0))
            held = held | fixed if p[3] == pages else held
            slots[key] = (held, len(held) if pages == 1 else n + most)
    return slots, pages


def _shared(a: Slots, b: Slots) -> Slots:
    return {key: (a[key][0] & b[key][0], max(a[key][1], b[key][1])) for key in a}


def _is_fixed(fixed: frozenset[int], most: int) -> bool:
    """Whether a slot's texts are mostly fixed ones; prose that shares a sentence with other pages stays open."""
    return 2 * len(fixed) > most


def fold(parts: list[list], known: frozenset[str] = frozenset()) -> list[list]:
    """Stretches that follow themselves become repeated groups; so does one copy of a known group."""
    out: list[list] = []
    keys = [_key(p) for p in parts]
    at, n = 0, len(parts)
    places: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    groups: dict[str, list[list[str]]] = {}
    for body in sorted((k[1:].split("\0") for k in known), key=len):
        groups.setdefault(body[0], []).append(body)
    joint = next((i for i in range(n) if keys[i][0] == "+"), n)
    while at < n:
        key, best = keys[at], 0
        if joint < at:
            joint = next((i for i in range(at, n) if keys[i][0] == "+"), n)
        if at < joint and key[:2] != "</":
            best = next((len(body) for body in groups.get(key, ()) if keys[at:at + len(body)] == body), 0)
            same = places[key]
            for k in range(bisect_right(same, at), len(same)):
                size = same[k] - at
                if best and size >= best or at + size > joint or at + 2 * size > n:
                    break
                if keys[at + size - 1] == keys[at + 2 * size - 1] and keys[at:at + size] == keys[at + size:at + 2 * size] and _balanced(keys[at:at + size]):
                    best = size
                    break
        if not best:
            if out and key[0] == "+" and _key(out[-1]) == key:
                out[-1] = [out[-1][0], out[-1][1] and parts[at][1], *_joined([out[-1], parts[at]])]
            else:
                out.append(parts[at])
            at += 1
            continue
        body, start = keys[at:at + best], at
        while keys[at:at + best] == body:
            at += best
        out.append([body, parts[start][1], *_joined(parts[start:at])])
    return out


def _balanced(body: list[str]) -> bool:
    depth = 0
    for key in body:
        if key[0] == "<":
            depth += -1 if key[1] == "/" else 1
            if depth < 0:
                return False
    return any(k[0] == "#" for k in body) or depth == 0


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what either of two match."""
    groups = frozenset(_key(p) for p in (*a, *b) if not isinstance(p[0], str))
    a, b = fold(a, groups), fold(b, groups)
    left, right = [_key(p) for p in a], [_key(p) for p in b]
    out: list[list] = []
    for what, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                out.append([x[0], x[1] or y[1], _shared(x[2], y[2]), x[3] + y[3]])
        else:
            out += [[p[0], True, p[2], p[3]] for p in (*a[i:j], *b[k:m])]
    return out


def page_slots(page: str) -> tuple[list[str], list[int]]:
    """The keys of a page's tokens, and a hash of the text of each that can hold main text, 0 for others."""
    tokens = stream(page)
    has_main = with_main(tokens)
    return [k for k, _ in tokens], [text_hash(t) if t is not None and in_main(k[1:], has_main) else 0 for k, t in tokens]


def page_parts(keys: list[str], texts: list[int]) -> list[list]:
    return fold([[k, False, {k: (frozenset([t]), 1)} if k[0] == "#" else {}, 1] for k, t in zip(keys, texts, strict=True)])


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1


def with_main(tokens: list[tuple[str, str | None]]) -> bool:
    return any(k.startswith(("<article", "<main")) for k, _ in tokens)


class Wrappers(dict):
    """Wrappers by host, each with the forms it has already taken in."""

    def add(self, host: str, parts: list[list]) -> None:
        if host not in self:
            self[host] = (parts, {})
            return
        wrapper, forms = self[host]
        form = tuple(map(_key, parts))
        places = forms.get(form)
        if places is None or any(p >= len(wrapper) for p in places):
            wrapper = align(wrapper, parts)
            self[host] = (wrapper, forms if len(wrapper) == len(self[host][0]) else {})
            # Where the same form will fit from now on.
            groups = frozenset(_key(p) for p in wrapper if not isinstance(p[0], str))
            folded = [_key(p) for p in fold([list(p) for p in parts], groups)]
            blocks = SequenceMatcher(None, [_key(p) for p in wrapper], folded, autojunk=False).get_matching_blocks()
            places = [b.a + i for b in blocks for i in range(b.size)]
            if len(places) == len(folded) == len(parts):
                self[host][1][form] = places
            return
        for place, part in zip(places, parts, strict=True):
            held = wrapper[place]
            held[3] += part[3]
            held[2] = _shared(held[2], part[2])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, pages) for all rows of (host, html); pages with the same main text count once.

    Each task aligns the pages it gets, one wrapper a host; wrappers of a host then meet in 32
    groups and at last as one, so that no step gets more than it can hold.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                keys, texts = page_slots(page)
                main = [(k, t) for k, t in zip(keys, texts, strict=True) if t]
                rows.append((host, xxhash.xxh3_128_hexdigest(json.dumps(main)), json.dumps([keys, texts])))
            yield pd.DataFrame(rows, columns=["host", "main", "slots"])

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Wrappers()
        counts: dict[str, int] = {}
        for batch in batches:
            for host, slots in zip(batch["host"], batch["slots"], strict=True):
                found.add(host, page_parts(*json.loads(slots)))
                counts[host] = counts.get(host, 0) + 1
            if len(found) > 2000:
                yield _frame(found, counts)
                found, counts = Wrappers(), {}
        if found:
            yield _frame(found, counts)

    def of_wrappers(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("wrapper")
        whole = None
        for text in group["wrapper"]:
            parts = _parts(text)
            whole = parts if whole is None else align(whole, parts)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_json(whole)], "pages": [int(group["pages"].sum())]})

    schema = "host string, wrapper string, pages long"
    slots = pages.mapInPandas(read, "host string, main string, slots string").groupBy("host", "main").agg(F.min("slots").alias("slots"))
    parts = slots.sortWithinPartitions("host", "main").select("host", "slots").mapInPandas(of_pages, schema)
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(32)).alias("_part")).applyInPandas(of_wrappers, schema)
    return some.groupBy("host").applyInPandas(of_wrappers, schema)


def _json(wrapper: list[list]) -> str:
    return json.dumps([[kind, optional, {k: (sorted(fixed), most) for k, (fixed, most) in slots.items()}, n] for kind, optional, slots, n in wrapper])


def _parts(text: str) -> list[list]:
    return [[kind, optional, {k: (frozenset(fixed), most) for k, (fixed, most) in slots.items()}, n] for kind, optional, slots, n in json.loads(text)]


def _frame(found: Wrappers, counts: dict[str, int]) -> pd.DataFrame:
    return pd.DataFrame([(h, _json(w), counts[h]) for h, (w, _) in found.items()], columns=["host", "wrapper", "pages"])


def in_main(path: str, has_main: bool) -> bool:
    """Whether a slot with this path can hold main text; names around an article or main element don't count."""
    inside = not has_main
    for label in path.split("/"):
        if not label:
            continue
        tag, *names = label.rstrip("!").split(".")
        if label.endswith("!") or tag in ASIDE and (inside or tag != "form"):
            return False
        if tag in MAIN:
            inside = True
        elif not inside:
            continue
        elif tag == "header" or names and set(names) <= {"header", "masthead", "site-header"}:
            if not has_main:
                return False
        elif names:
            return False
    return inside


def _is_section(key: str) -> bool:
    labels = key[1:].split("/")
    return labels[-1] in HEADINGS and any(label in MAIN for label in labels)


def furniture(wrapper: list[list], pages: int) -> list[tuple[str, int]]:
    """The slots and hashes of the text that a wrapper has as fixed over enough of its pages, if other text of theirs differs."""
    enough = max(FIXED, SHARE * pages)
    slots = [(key, fixed, n) for _, _, held, n in wrapper for key, (fixed, most) in held.items() if _is_fixed(fixed, most)]
    varies = len(slots) < sum(len(p[2]) for p in wrapper)
    # The headings of an article's sections are its own, however many pages have them.
    return sorted({(k, t) for k, fixed, n in slots if n >= enough and varies and not _is_section(k) for t in fixed if t})


class Reader:
    """Reads pages of one host by what its wrapper has as furniture."""

    def __init__(self, fixed: list[tuple[str, int]]):
        self.fixed = {(k, t) for k, t in fixed}

    def text(self, page: str) -> str:
        tokens = stream(page)
        has_main = with_main(tokens)
        return "\n".join(text for key, text in tokens if text is not None and in_main(key[1:], has_main)
                         and (key, text_hash(text)) not in self.fixed)


def extract(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """The rows with ``text``, the page's main text, and ``n_chars``.

    Wrappers are inferred for each host from all its pages; every page is read by its host's.
    Main text is what stands in an article or main element, or anywhere on a page with
    neither, without parts that their elements or names mark as navigation, advert, notice,
    form, comment and the like, and without what the wrapper has as fixed: text that is in
    its slot or repeated group on every page that has that, if it is most of what the slot
    holds and these are FIXED pages with different main text and a SHARE of the host's. Headings inside an article or
    main element stay, fixed or not. Blocks keep their order, one to a line.

    A null or empty page, and one without main text, has the empty text. Pages without a
    host share a wrapper. Repeated rows are read alike; columns called text or n_chars are
    replaced.
    """
    pages, names = set_aside(pages)
    url, page = names.get(url, url), names.get(page, page)
    rows = pages.drop("text", "n_chars").withColumn("_host", host_of(F.col(f"`{url}`"))).withColumn("_page", F.coalesce(F.col(f"`{page}`"), F.lit("")))
    wrappers = cut_lineage(infer_wrappers(rows.where("_page <> ''").select(F.col("_host").alias("host"), F.col("_page").alias("html"))))
    @F.pandas_udf("string")
    def fixed_text(wrapped: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(furniture(_parts(w), n)) for w, n in zip(wrapped, counts, strict=True)], dtype=object)

    # Pages get only what decides about them: a wrapper is many times larger, and goes with every row of its host.
    decides = cut_lineage(wrappers.select(F.col("host").alias("_host"), fixed_text("wrapper", "pages").alias("_wrapper")))
    joined = rows.join(decides, "_host", "left")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers: dict[str, Reader] = {}
        for hosts, texts, wrapped in batches:
            out = []
            for host, text, wrapper in zip(hosts, texts, wrapped, strict=True):
                if not text:
                    out.append("")
                    continue
                if host not in readers:
                    if len(readers) >= 256:
                        readers.clear()
                    readers[host] = Reader(json.loads(wrapper))
                out.append(readers[host].text(text))
            yield pd.Series(out)

    found = joined.withColumn("text", read("_host", "_page", "_wrapper"))
    return put_back(found.withColumn("n_chars", F.length("text").cast("long")).drop("_host", "_page", "_wrapper"), names)
