"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens: opening and closing tags (with class, id and role) and text nodes.  Over the pages of a
host, a token's occurrence vector lists how often it stands on each page; tokens with the same vector form an
equivalence class.  A vector is kept as two sums of hashes of (page, count), so it is aggregated like any sum and no
task sees a host's pages together.  Classes that stand on enough of the host's pages and keep one order are valid.  The
class of tokens that stand once on every page is the template's root; classes of repeated tokens nest in the gap of the
root in which all their occurrences lie.  Blocks of equal tags (CONTAINERS) are tokens of their roles as well: of their path
of elements and their place among the equal children of each element on it.  What lies between template tokens are slots.  The template element whose slots
hold the article is chosen once for a host, and its slots, less those of menus, notices and the like nested in it, are a
page's main text.

Hosts with few pages use the template of all pages together.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import hinted, written
from tarnwright.llm.url_filter import host_of

#: Share of a host's pages on which a valid class stands.
SUPPORT = 0.6
#: Pages from which a host has a template of its own.
MIN_PAGES = 4
#: Contents that stand more than once, of two longs each, up to which they are broadcast; counted before.
COPIES = 2_000_000
#: The name of all hosts together, which no host can have.
ALL = "/"

# The element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title"}
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "template", "svg", "math"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
APART = {"nav", "aside", "footer", "header", "form", "menu", "button", "select", "dialog"} | HIDDEN
APART_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
APART_WORD = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
#: Words that say where or how an element stands; with one of APART_WORD they name an element apart, any other word doesn't.
PLACE_WORD = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "center", "column", "container", "content", "desktop", "fixed", "form", "global", "group", "header", "holder", "icons", "inner", "info", "item", "items", "law", "left", "links", "list", "main", "mobile", "outer", "overlay", "page", "panel", "posts", "primary", "region", "right", "row", "secondary", "section", "signup", "site", "slot", "sticky", "strip", "thread", "top", "unit", "user", "widget", "wrap", "wrapper"}
#: Words of the main text itself place an element too: the footer of an entry is no part of it.
MAIN_WORD = {"article", "articlebody", "content", "entry", "main", "post", "story"}

#: Blocks that hold parts of a page and say by no name which; pages of one template differ in what these hold.
CONTAINERS = {"center", "div", "section", "td"}

_PLACED = APART_WORD | PLACE_WORD | MAIN_WORD

#: A tag, comment or declaration.  A quote matters only round a whole value, so a stray one hides nothing; what never ends goes.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A slash that belongs to an unquoted value, and closes nothing.
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'][^\s\"']*$")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_ROLE = re.compile(r">@[0-9a-f]+$")
_WITHOUT = re.compile(r"(?:no|has|with|without)[-_]")


class Element:
    """An open element: its name, its token, and whether it stands apart from the main text."""

    __slots__ = ("apart", "chars", "children", "links", "name", "nth", "parent", "rank", "role", "token", "unseen")

    def __init__(self, name: str, attributes: str, parent: Element | None = None):
        self.parent, self.children, self.role = parent, {}, 0
        every = {k.lower(): (a or b or c).strip().lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        found = sorted((k, _DIGITS.sub("0", v)) for k, v in every.items() if k in ("class", "id", "role", "itemprop") and v)
        self.name, self.chars, self.links = name, 0, 0
        self.token = f"<{name}{''.join(f' {k}={v}' for k, v in found)}>"
        parts = [_WORD.findall(part) for k, v in found if k != "role" for part in v.split() if not _WITHOUT.match(part)]
        words = {w for part in parts for w in part}
        named = any(APART_WORD.intersection(part) and _PLACED.issuperset(part) for part in parts)
        self.unseen = every.get("hidden", "false" if "hidden" not in every else "") != "false" or "display:none" in every.get("style", "").replace(" ", "")
        roles = {w for k, v in found if k == "role" for w in v.split()}
        self.apart = name in APART or self.unseen or named and name not in ("html", "body", "article", "main") or bool(roles & APART_ROLE)
        if parent:
            self.nth = parent.children[self.token] = parent.children.get(self.token, 0) + 1
        else:
            self.nth = 1
        self.rank = 3 if name == "article" or "articlebody" in words else 2 if name == "main" or "main" in roles or words & MAIN_WORD else 1 if name not in INLINE else 0


def _with_roles(found: list) -> None:
    """Sets each element's role: its path of tokens, with its place among the equal children of each and how many these are."""
    for kind, x in found:
        if kind == "open":
            above, of = (x.parent.role, x.parent.children[x.token]) if x.parent else (0, 1)
            x.role = _mix(above + zlib.crc32(x.token.encode("utf-8", "surrogatepass")) + (x.nth << 32) + (of << 48) & 0xFFFFFFFFFFFFFFFF)


def _role_token(x: Element) -> str | None:
    """The token of an element's role, for blocks that no name tells apart."""
    return f"{x.token}@{x.role:x}" if x.name in CONTAINERS and x.rank == 1 and not x.apart else None


def events(page: str) -> Iterator[tuple[str, Element | str]]:
    """('open' | 'close', element), ('text', decoded text) and ('break', name), in page order; every element is closed."""
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    at = 0

    def close(names: set[str], stop: set[str]) -> list[Element]:
        if not any(opened[n] for n in names):  # else a page of stray ends would search all that is open for each
            return []
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                done = stack[i:][::-1]
                del stack[i:]
                opened.subtract(e.name for e in done)
                return done
            if stack[i].name in stop:
                return []
        return []

    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", entities.unescape(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                yield "break", name
            yield from (("close", e) for e in close({name}, {"article"} if name in INLINE or name in ("p", "li") else set()))
            continue
        if name in VOID:
            yield "break", name
            continue
        ended = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS_END_P else set())
        if ended:
            yield from (("close", e) for e in close(ended, {"article", "aside", "body", "div", "dl", "main", "ol", "section", "table", "ul"} - ended))
        if name in ("svg", "math") and m[3].endswith("/") and not _UNQUOTED_END.search(m[3]):
            continue  # self-closed: nothing stands in it
        element = Element(name, m[3], stack[-1] if stack else None)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(element)
        opened[name] += 1
        yield "open", element
    yield from (("close", e) for e in stack[::-1])


def _text_token(text: str) -> str:
    return "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def tokens(page: str) -> dict[str, list[int]]:
    """Each token's [occurrences, first position, characters of text in it, those of links, whether it encloses the page].

    Elements apart count no text.  Where nine tenths of a page's text outside links lie in an element that would stand
    apart by its name, as in a form round the whole page, that element encloses the page and counts.
    """
    found = [*events(page)]
    whole: dict[int, int] = {}
    hidden = links = every = 0
    for kind, x in found:
        if kind in ("open", "close"):
            step = 1 if kind == "open" else -1
            hidden += step * (x.name in HIDDEN or x.unseen)
            links += step * (x.name == "a")
            if x.apart and x.name not in HIDDEN and not x.unseen:
                whole[id(x)] = every - whole.get(id(x), 0)
        elif kind == "text" and not hidden and not links:
            every += len(" ".join(x.split()))
    enclosing = {k for k, n in whole.items() if n >= 0.9 * every > 0}
    _with_roles(found)

    out: dict[str, list[int]] = {}
    open_now: list[Element] = []  # elements close in the reverse order
    apart = links = 0

    def seen(token: str, chars: int = 0, linked: int = 0, encloses: bool = False) -> None:
        x = out.setdefault(token, [0, len(out), 0, 0, 0])
        x[0] += 1
        x[2] += chars
        x[3] += linked
        x[4] |= encloses

    for kind, x in found:
        if kind == "open":
            open_now.append(x)
            apart += x.apart and id(x) not in enclosing
            links += x.name == "a"
            seen(x.token, encloses=id(x) in enclosing)
            if role := _role_token(x):
                seen(role)
        elif kind == "close":
            open_now.pop()
            apart -= x.apart and id(x) not in enclosing
            links -= x.name == "a"
            if role := _role_token(x):
                seen("/" + role, x.chars, x.links)
            seen("/" + x.token, x.chars, x.links)
            if open_now:
                open_now[-1].chars += x.chars
                open_now[-1].links += x.links
        elif kind == "text" and open_now and (text := " ".join(x.split())):
            n = 0 if apart else len(text)
            open_now[-1].chars += n
            open_now[-1].links += n * bool(links)
            seen(_text_token(text), n, n * bool(links))
    return out


def _mix(x: int) -> int:
    """A 64-bit mix of an integer."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


TALLY = "host string, token string, pages double, total double, first double, chars double, links double, encloses double, v1 long, v2 long"


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of each host's tokens; the empty token counts its pages.  v1 and v2 sum 31 bits each of a hash of (page, count).

    The copies of a page share a weight of 1 in all but v1 and v2, which don't depend on how often a page stands.
    """
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = {}
        for host, key, copies, page in zip(batch["host"], batch["key"], batch["copies"], batch["html"], strict=True):
            for token, (n, first, chars, links, encloses) in (tokens(page) | {"": [1, 0, 0, 0, 0]}).items():
                h = _mix((int(key) & 0xFFFFFFFFFFFFFFFF) + n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                new = (*(x / copies for x in (1, n, first, chars, links, encloses)), h >> 33, h & 0x7FFFFFFF)
                old = sums.get((host, token))
                sums[host, token] = [*map(sum, zip(old, new, strict=True))] if old else list(new)
            if len(sums) > 200_000:
                yield _frame(sums)
                sums = {}
        yield _frame(sums)


def _frame(sums: dict[tuple[str, str], list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=[x.split()[0] for x in TALLY.split(", ")])


def _enclosed(names: list[str]) -> dict[str, list[str]]:
    """The texts of a class, in page order, that stand between an opening tag and its closing tag of the class: these tags.

    These come wherever their tags come, so no other text takes their slot; a text without tags of its own class may
    be one of several that fill a slot.
    """
    ends = {t[1:]: i for i, t in enumerate(names) if t.startswith("/<")}
    out: dict[str, list[str]] = {}
    open_now: dict[str, None] = {}
    for i, t in enumerate(names):
        if ends.get(t, -1) > i:
            open_now[t] = None
        elif t[0] == "/":
            open_now.pop(t[1:], None)
        elif t[0] == "#" and open_now:
            out[t] = [*open_now]
    return out


def deduce(table: pd.DataFrame, pages: int, texts: bool = True) -> dict:
    """A host's template from its tokens' sums: root tokens in order, nested classes by gap, main element and enclosing ones.

    Tokens of the main element are an opening tag and its closing tag of one valid class; a named one may be repeated.
    It is chosen by the text of its slots: template texts don't count.  Where the slots of several hold at least half of
    the most text, a name breaks the tie (article; main or content; any block); of equal names the innermost with nine
    tenths of the most text is taken.  Texts are template tokens only where tags of their class stand round them.
    """
    table = table[(table["pages"] >= SUPPORT * pages) & (table["token"] != "")]
    rows = [*table.sort_values(["first", "token"]).itertuples()]
    texts = texts and pages >= MIN_PAGES
    classes: dict[tuple, list] = {}
    for r in rows:
        classes.setdefault((r.pages, r.total, r.v1, r.v2), []).append(r)
    once = [rs for k, rs in classes.items() if k[0] == k[1]]
    root = max(once, key=lambda rs: (rs[0].pages, len(rs)), default=[])
    starts = [r.first / r.pages for r in root]
    nested: dict[int, list[dict]] = {}
    fixed: list = []
    own: list[str] = []
    for rs in classes.values():
        names = [r.token for r in rs]
        within = _enclosed(names) if texts else {}
        if rs is root:
            own = [t for t in names if t[0] != "#" or t in within]
        else:
            gaps = [sum(s <= r.first / r.pages for s in starts) for r in rs]
            # within one slot of the root: by its places, or as one element holds the class
            if len(rs) < 2 or len({*gaps}) > 1 and names[-1] != "/" + names[0]:
                continue
            nested.setdefault(gaps[0], []).append({"tokens": [t for t in names if t[0] != "#"], "texts": within})
        fixed += [r for r in rs if r.token in within]
    encloses = [r.token for r in rows if r.encloses >= SUPPORT * pages]
    candidates = []
    fixed.sort(key=lambda f: f.first / f.pages)
    places = [f.first / f.pages for f in fixed]
    chars = [0, *accumulate(f.chars - f.links for f in fixed)]
    for rs in classes.values():
        opened = {r.token: r for r in rs}
        for r in rs:
            if r.token.startswith("/<") and r.token[1:] in opened:
                name, _, attributes = _ROLE.sub(">", r.token)[2:-1].partition(" ")
                e = Element(name, "".join(f' {k}="{v}"' for k, v in re.findall(r"(class|id|role|itemprop)=(.*?)(?= (?:class|id|role|itemprop)=|$)", attributes)))
                if not e.apart and e.rank and r.chars and (e.rank > 1 or r.pages == r.total):
                    first, last = opened[r.token[1:]].first / r.pages, r.first / r.pages
                    template = chars[bisect_left(places, last)] - chars[bisect_right(places, first)] if first < last else 0
                    candidates.append((e.rank, r.chars - r.links - template, last, r.token[1:]))
    best: tuple = (0, 0, 0.0, "")
    if candidates:
        most = max(c[1] for c in candidates)
        rank = max(c[0] for c in candidates if c[1] >= 0.5 * most)
        most = max(c[1] for c in candidates if c[0] == rank)
        # closing tags come the earlier the deeper an element lies
        best = min((c for c in candidates if c[0] == rank and c[1] >= 0.9 * most), key=lambda c: (c[2], c[3]), default=best)
    return {"root": own, "nested": {str(k): v for k, v in sorted(nested.items())}, "main": best[3], "rank": best[0], "encloses": encloses}


def _aligned(found: list, template: dict) -> set[int]:
    """The places among a page's events of template texts: of the longest run of root tokens in the root's order, and of
    nested classes within their own tags."""
    index = {t: i for i, t in enumerate(template["root"])}
    nested = {t: tags for classes in template["nested"].values() for c in classes for t, tags in c["texts"].items()}
    if not nested and not any(t[0] == "#" for t in index):
        return set()
    out: set[int] = set()
    open_now: Counter[str] = Counter()
    tails: list[tuple[int, int]] = []  # root index and place of the last token of the best run of each length
    before: dict[int, int] = {}
    texts: set[int] = set()
    for place, (kind, x) in enumerate(found):
        if kind == "text":
            text = " ".join(x.split())
            if not text:
                continue
            token = _text_token(text)
            if any(open_now[t] for t in nested.get(token, ())):
                out.add(place)
        elif kind == "break":
            continue
        else:
            token = x.token if kind == "open" else "/" + x.token
            step = 1 if kind == "open" else -1
            open_now[x.token] += step
            if role := _role_token(x):
                open_now[role] += step
        i = index.get(token)
        if i is not None:
            if kind == "text":
                texts.add(place)
            at = bisect_left(tails, (i, -1))
            before[place] = tails[at - 1][1] if at else -1
            tails[at : at + 1] = [(i, place)]
    place = tails[-1][1] if tails else -1
    while place >= 0:
        if place in texts:
            out.add(place)
        place = before[place]
    return out


def _is_main(x: Element, template: dict) -> bool:
    main = template["main"]
    return main in (x.token, _role_token(x)) if main else False


def main_text(page: str | None, template: dict) -> str:
    """The text in the slots of the template's main element; without it, of the best elements by name, or of the body.

    Parts that lie beside each other are joined in page order: all main elements, and others of their rank, but for those
    that hold links only.  Elements apart are left out unless they enclose the host's pages, as are the template's texts.
    """
    if not page:
        return ""
    pieces: list[tuple[str, bool, bool] | None] = []  # text, of the template, in a link; None ends a block
    parts: list[list] = []  # element, first and last piece
    running: list[list] = []
    apart_at: list[Element] = []
    found = [*events(page)]
    _with_roles(found)
    fixed = _aligned(found, template)
    links = 0
    for place, (kind, x) in enumerate(found):
        if kind == "open":
            if x.name not in INLINE:
                pieces.append(None)
            links += x.name == "a"
            own_title = x.name == "header" and any(e.rank >= 2 for e, *_ in running)
            if x.apart and not own_title and x.token not in template.get("encloses", ()):
                apart_at.append(x)
            if not apart_at and (_is_main(x, template) or x.rank >= 2):
                parts.append([x, len(pieces), 0])
                running.append(parts[-1])
        elif kind == "close":
            links -= x.name == "a"
            if apart_at and apart_at[-1] is x:
                apart_at.pop()
            if running and running[-1][0] is x:
                running.pop()[2] = len(pieces)
            if x.name not in INLINE:
                pieces.append(None)
        elif kind == "break":
            if x not in INLINE:
                pieces.append(None)
        elif not apart_at:
            pieces.append((x, place in fixed, links > 0))
    chosen = _side_by_side([x for x in parts if any(p and p[0].strip() for p in pieces[x[1] : x[2]])], pieces, template)
    spans = [(first, last) for _, first, last in chosen] or [(0, len(pieces))]
    # template texts never leave the main slot empty
    return _joined(pieces, spans, False) or _joined(pieces, spans, True)


def _side_by_side(parts: list[list], pieces: list, template: dict) -> list[list]:
    """Of a page's parts those that make up its main text, none within another, in page order."""

    def outer(some: list[list]) -> list[list]:
        out: list[list] = []
        for x in some:
            if not out or x[1] >= out[-1][2]:
                out.append(x)
        return out

    def links_only(x: list) -> bool:
        return all(p[2] or not p[0].strip() for p in pieces[x[1] : x[2]] if p)

    # a <main> with text of its own beside its articles is one part
    for x in parts:
        if (x[0].name == "main" or "role=main" in x[0].token) and not _is_main(x[0], template):
            within = outer([y for y in parts if y is not x and x[1] <= y[1] and y[2] <= x[2] and y[0].rank == 3])
            own = [p for a, b in zip([x[1], *[y[2] for y in within]], [*[y[1] for y in within], x[2]]) for p in pieces[a:b] if p and p[0].strip()]
            if within and any(not p[1] and not p[2] for p in own):
                return [x]
    main = outer([x for x in parts if _is_main(x[0], template)])
    main = [x for x in main if not links_only(x)] or main
    rank = template["rank"] if main else max((x[0].rank for x in parts), default=0)
    if rank < 2:
        return main
    starts = [m[1] for m in main]  # in page order, none within another

    def apart_from_main(x: list) -> bool:
        i = bisect_right(starts, x[1])
        return (i == 0 or main[i - 1][2] <= x[1]) and (i == len(main) or main[i][1] >= x[2])

    beside = [x for x in parts if x[0].rank == rank and apart_from_main(x)]
    beside = [x for x in outer(beside) if not links_only(x)] or ([] if main else outer(beside))
    return sorted(main + beside, key=lambda x: x[1])


def _joined(pieces: list, spans: list[tuple[int, int]], fixed: bool) -> str:
    """The text of some spans of pieces, with or without the fixed ones, block by block."""
    blocks: list[list[str]] = []
    for first, last in spans:
        blocks.append([])
        for p in pieces[first:last]:
            if p is None:
                blocks.append([])
            elif fixed or not p[1]:
                blocks[-1].append(p[0])
    return " ".join(t for b in blocks if (t := " ".join("".join(b).split())))


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON) of each host with enough pages, and of all pages together as host ALL."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    # copies of a page say nothing of its template: each content of a host counts once
    keyed = keyed.filter("html != ''").withColumn("key", F.xxhash64("host", F.md5("html")))
    copies = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    copies = F.broadcast(copies) if copies.count() <= COPIES else copies
    keyed = keyed.join(copies, "key", "left").select("host", "key", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    names = ("pages", "total", "first", "chars", "links", "encloses", "v1", "v2")
    summed = [F.round(F.sum(c)).cast("long").alias(c) for c in names[:-2]] + [F.sum(c).alias(c) for c in names[-2:]]
    sums = written(keyed.mapInPandas(_tally, TALLY).groupBy("host", "token").agg(*summed), "tokens")
    sizes = sums.filter("token = ''").select("host", F.col("pages").alias("size"))
    n = sizes.count()
    every = sums.groupBy("token").agg(*[F.sum(c).alias(c) for c in names]).select(F.lit(ALL).alias("host"), "token", *names)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()[0]
    own = sums.join(hinted(sizes.filter(F.col("size") >= MIN_PAGES), n), "host")
    frequent = own.unionByName(every.withColumn("size", F.lit(total))).filter(F.col("pages") >= SUPPORT * F.col("size"))

    # a page's tokens bound how many can stand on most pages, so a host's frequent tokens are few however many its pages
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": rows["host"].iloc[:1], "template": [json.dumps(deduce(rows, int(rows["size"].iloc[0]), rows["host"].iloc[0] != ALL))]})

    return frequent.groupBy("host").applyInPandas(fit, "host string, template string")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A null or empty html, and one with no text, gives the empty text; a null url has the empty host.  Repeated rows
    repeat, and copies of a page on a host count once for its template; other columns are ignored; an empty table gives an empty result.
    """
    known = written(templates(pages), "templates")
    default = known.filter(F.col("host") == ALL).select("template").first()
    default = default[0] if default else json.dumps({"root": [], "nested": {}, "main": "", "rank": 0, "encloses": []})
    own = known.filter(F.col("host") != ALL)
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    size = own.agg(F.coalesce(F.sum(F.length("template") + F.length("host")), F.lit(0))).first()[0]
    with_template = keyed.join(hinted(own, size // 64), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, template in zip(batch["html"], batch["template"], strict=True):
                template = default if template is None else template
                if template not in read:
                    read[template] = json.loads(template)
                texts.append(main_text(page, read[template]))
            if len(read) > 10_000:
                read = {}
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    types = dict(pages.dtypes)
    return with_template.mapInPandas(run, f"page_id {types['page_id']}, url string, text string, n_chars long")
