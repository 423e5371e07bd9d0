"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its elements' start and end tags, told apart by the path of tags, classes, ids and
roles that leads to them, and its words, told apart by the element's path that they stand in and by
their number among equal words of that element.  Over the pages of one host each token has an
occurrence vector: how often it occurs on each page.

1. Tokens on at least `SUPPORT` of the pages with equal vectors form an equivalence class.
2. A class is valid if it is ordered: its tokens follow one another in the same order in each of their
   occurrences.  Tokens that break the order leave the class.
3. Valid classes nest: all occurrences of the one lie in the same gap between two tokens of the
   other.  A class of words that lies across gaps is no template and goes.
4. Words of the remaining classes with at least `LEAST` tokens are the template's; a block (run of text
   between block-level tags) made of such words alone is constant.  What is left are the slots' contents.
5. Slots that are mostly links, and elements that call themselves menus, headers, footers, side bars,
   notices, adverts, forms or comments (see below), are boilerplate.  The innermost template element
   that occurs once a page and holds all other contents is the main slot.
6. A page's text is what its main slot holds, less boilerplate and constant blocks.

Where nearly all of a host's text is constant its pages are copies of one another, and constant text
counts as content; so it does within the main slot where it is more than `COPIES` of it.

A name in a class, id or role is a hint: it counts neither for what holds the page's article nor where its
elements hold most of the text, and within the main slot only if it can mean nothing else.  Hosts of
fewer than three pages, and pages without their host's main slot, are read by these names and by
`article` and `main` alone.

Pages are dealt to parts of a host, of about `PART_PAGES` pages and `PART_BYTES` bytes, by a hash of
their content, and each part is its own set of same-host pages: a host with a third of all pages is
many parts like the others, each with pages enough to show the template.  Pages are shuffled once and
read once; a task holds one part at a time.

Blocks are joined by one space; character references are decoded, white space within a block becomes
one space.

Null or empty html has no text.  Pages without a host (null url) are one host.  Null ids and
repeated rows are kept.  Broken markup is read as far as it goes, in time linear in the page: an end tag closes
its element and all in it, an unknown one is ignored, of a script or style without end tag all that follows is
ignored, of another element without text (svg, select, title and so on) its tag alone, a block ends an open
paragraph, a "<" that begins no tag is text, a tag that the page's end cuts off is dropped.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import saved
from leafmill.llm.memory import lean

#: Share of a part's pages on which a template token occurs; share of links in a slot's text beyond which it is boilerplate.
SUPPORT, LINKS = 0.6, 0.6
#: Of the pages with a main slot, the share on which it occurs once; share of the text that boilerplate names may not exceed.
ONCE, MOST = 0.9, 0.5
#: Tokens of a class whose words are the template's; pages below which equal text may as well be copies of a page.
LEAST, FEW_PAGES = 3, 5
#: Share of constant text of a host beyond which its pages are copies, and of its main slot beyond which such text stays.
ALL, COPIES = 0.9, 1 / 3
#: Pages and bytes of html in a part of a host, bytes of html in a task.
PART_PAGES, PART_BYTES, TASK_BYTES = 400, 8 << 20, 16 << 20
#: Hosts of several parts whose numbers are broadcast; more are joined by shuffle, salted `SALT` ways.
FEW_HOSTS, SALT = 1_000_000, 64

_ATTRIBUTES = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})>|<[!?/][^<>]*+>", re.S)
#: A tag that the page's end cuts off.
_CUT = re.compile(rf"<(?:[/!?]?+[a-zA-Z][^\s/<>=]*+(?:\s*+\Z|(?=[^<>]*=){_ATTRIBUTES}\Z)|[!?][^<>]*\Z)")
#: Elements whose content is not the page's text: the start and end tags of each.
_SKIPPED = {t: re.compile(rf"<(/?){t}(?=[\s/>])({_ATTRIBUTES})>", re.I) for t in "script style noscript template iframe textarea title svg select object".split()}
#: Of these, those whose content is no markup: up to the first end tag, or else to the end of the page; "/>" does not close them.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style")}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Boilerplate by their tags.  A form or header may also hold the page.
_BOILERPLATE = frozenset("nav footer aside menu dialog button".split())
_NAMED = re.compile(
    r"(?:^|[_-])(ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:igation|bar)?|breadcrumbs?|side-?bar|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|comments?|disqus|replies|related|recommended|share|sharing|social|subscribe|newsletter|signup|login|search|"
    r"pagination|pager|toolbar|widget|copyright|contentinfo|complementary)(?=$|[_-])",
    re.I,
)
#: Names that tell what an element has, not what it is.
_STATE = re.compile(r"(?:has|no|not|with|without|is|fixed|sticky)[_-]", re.I)
#: Names that mean boilerplate within the main slot too: as the last word of any of its names, or as all its names.
_CLEAR = re.compile(r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|sponsored|breadcrumbs?|side-?bar|cookies?|gdpr|comments?|disqus|subscribe|newsletter|pagination|pager)$", re.I)
_WHOLE = frozenset("related recommended share sharing social promo promotion popup modal signup login nav navigation".split())
#: What holds an article's own text, whatever its name.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figure figcaption".split())
_NONE: frozenset[str] = frozenset()
_MAIN = re.compile(r"^(?:article|main)(?:$|[.#@])|@main\b")
#: An element that these tags close when it is still open.
_ENDS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDED = frozenset(t for ends in _ENDS.values() for t in ends)
_SCOPE = frozenset("ul ol table div article section body td th blockquote nav aside main footer header dl form".split())

OPEN, CLOSE, TEXT, BREAK = range(4)


class Paths:
    """The paths of elements by number: each is its parent's number and its last element's name.  Parents have smaller numbers."""

    def __init__(self):
        self.parent, self.name = [-1], [""]
        self.number: dict[tuple[int, str], int] = {}

    def get(self, parent: int, name: str) -> int:
        found = self.number.get((parent, name))
        if found is None:
            found = self.number[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
        return found

    def text(self, path: int) -> str:
        out = []
        while path:
            out.append(self.name[path])
            path = self.parent[path]
        return "".join(f"/{name}" for name in reversed(out))

    def summed(self, own: np.ndarray) -> np.ndarray:
        """For each path, its own figure and those of all paths below it."""
        out = own.tolist()
        for path in range(len(out) - 1, 0, -1):
            out[self.parent[path]] += out[path]
        return np.array(out)

    def below(self, some: np.ndarray) -> np.ndarray:
        """Whether a path or one above it is among some."""
        out = some.tolist()
        for path in range(1, len(out)):
            out[path] = out[path] or out[self.parent[path]]
        return np.array(out, bool)


class Element:
    """An element of a page.  chars: of its text that is not hidden or a link; words: what it calls itself, within: within an article."""

    __slots__ = ("above", "boiler", "chars", "ended", "hidden", "link", "main", "own", "path", "seen", "tag", "title", "within", "words")

    def __init__(self, tag: str, path: int, above: Element | None, hidden: bool, link: bool, own: bool, words: frozenset[str], within: frozenset[str]):
        self.tag, self.path, self.above, self.hidden, self.link, self.own, self.words, self.within = tag, path, above, hidden, link, own, words, within
        self.main, self.boiler, self.title, self.chars, self.seen = False, hidden, tag == "h1", 0, None


_known: dict[tuple[str, str], tuple[str, bool, bool, frozenset[str], frozenset[str]]] = {}


def _described(tag: str, attributes: str) -> tuple[str, bool, bool, frozenset[str], frozenset[str]]:
    """What an element is called in paths, whether it is hidden, whether it is main content, its boilerplate words and those that hold within the main slot."""
    key = (tag, attributes)
    if key in _known:
        return _known[key]
    names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
    name = tag + "".join(sign + re.sub(r"[\s>]+", ".", re.sub(r"\d{2,}", "0", names[k])) for k, sign in (("class", "."), ("id", "#"), ("role", "@")) if names.get(k))
    hidden = tag == "head" or (tag not in ("body", "html") and bool(attributes and _HIDDEN.search(attributes)))
    called = [w.lower() for v in names.values() for w in v.split() if not _STATE.match(w)]
    inside = frozenset(w for w in called if _CLEAR.search(w))
    if called and all(w in _WHOLE or w in inside for w in called):
        inside = frozenset(called)
    main = bool(_MAIN.search(name)) and not inside
    words = within = _NONE
    if not main and tag not in ("body", "html"):
        words = frozenset(x for w in called for x in _NAMED.findall(w)) | ({f"<{tag}>"} if tag in ("form", "header") else _NONE)
        within = _NONE if tag in _PROSE else inside | ({"<form>"} if tag == "form" else _NONE)
    found = (name, hidden, main, words, within)
    if len(attributes) < 200 and "href" not in attributes:
        if len(_known) > 50_000:
            _known.clear()
        _known[key] = found
    return found


def _ends(tag: str, text: str, at: int) -> dict[int, int]:
    """Where the elements of a tag end that have an end tag, by where their start tags end."""
    found, starts = {}, []
    for m in _SKIPPED[tag].finditer(text, at):
        if not m[1]:
            if not m[2].endswith("/"):
                starts.append(m.end())
        elif starts:
            found[starts.pop()] = m.end()
    return found


class Page:
    """A page as its elements (the first is the root) and its items (kind, element, text) in page order."""

    def __init__(self, text: str, paths: Paths):
        self.paths = paths
        root = Element("", 0, None, False, False, False, _NONE, _NONE)
        root.ended = {}
        self.elements, self.items = [root], []
        self._stack, self._open = [root], {}
        self._read(text)

    def _close(self, depth: int) -> None:
        """Closes the open elements down to this depth."""
        while len(self._stack) > depth:
            e = self._stack.pop()
            self._open[e.tag] -= 1
            e.above.chars += e.chars
            e.above.title |= e.title
            self.items.append((CLOSE, e, ""))

    def _text(self, run: str) -> None:
        e = self._stack[-1]
        if not e.hidden and not e.link:
            e.chars += len(run.strip())
        self.items.append((TEXT, e, run))

    def _read(self, text: str) -> None:
        stack, at, ends = self._stack, 0, {}
        shown = 0  # up to here the text is already among the items, or dropped
        while m := _TOKEN.search(text, at):
            if m.start() > shown:
                self._text(text[shown : m.start()])
            at = shown = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _SKIPPED and not m[1]:
                if tag in _RAW:
                    at = _RAW[tag].search(text, at).end()
                elif not m[3].endswith("/"):
                    if tag not in ends:
                        ends[tag] = _ends(tag, text, m.start())
                    at = ends[tag].get(at, at)
                shown = at
                continue
            if m[1]:
                if self._open.get(tag):
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    self._close(depth)
                elif tag in _BLOCK or tag == "br":
                    self.items.append((BREAK, stack[-1], ""))
                continue
            if tag in _BLOCK:
                for ending in (*_ENDS.get(tag, ()), *(("p",) if tag != "p" else ())):
                    if depth := stack[-1].ended.get(ending):
                        self._close(depth)
            name, hidden, main, words, within = _described(tag, m[3].strip())
            above = stack[-1]
            element = Element(tag, self.paths.get(above.path, name), above, above.hidden or hidden, above.link or tag == "a", main, words, within)
            self.elements.append(element)
            self.items.append((OPEN, element, ""))
            if tag in _VOID or m[3].endswith("/"):
                self.items.append((CLOSE, element, ""))
                if tag in ("br", "hr"):
                    self.items.append((BREAK, element, ""))
            else:
                # Where the elements stand that other tags may end: within the innermost scope.
                element.ended = above.ended if tag not in _SCOPE else {}
                if tag in _ENDED:
                    element.ended = {**element.ended, tag: len(stack)}
                stack.append(element)
                self._open[tag] = self._open.get(tag, 0) + 1
        if shown < len(text):
            cut = _CUT.search(text, shown)
            rest = text[shown : cut.start()] if cut else text[shown:]
            if rest:
                self._text(rest)
        self._close(1)

    def judge(self, slot: int | None = None) -> None:
        """Sets which elements are boilerplate.  A name is a hint: it does not count for what holds the page's article (the
        elements at the main slot, or, without one, those that call themselves so), nor where the elements of that name
        hold most of the text of the page or of the article that they are in."""
        root = self.elements[0]
        holders, e = set(), None
        own: dict[int, bool] = {}
        for x in self.elements[1:]:
            is_own = x.own if slot is None else x.path == slot
            own[id(x)] = is_own
            x.main = is_own or x.above.main
            if is_own and not x.hidden and (e is None or x.chars > e.chars):
                e = x
        most = e is not None and e.chars > MOST * root.chars
        while e is not None:
            holders.add(id(e))
            e = e.above
        hints: dict[int, tuple[frozenset[str], Element]] = {}
        sums: dict[tuple[int, str], int] = {}
        outer: dict[int, frozenset[str]] = {}
        scopes = {id(root): root}
        for e in self.elements[1:]:
            up = id(e.above)
            scope = scopes[id(e)] = e if own[id(e)] else scopes[up]
            seen = outer[id(e)] = _NONE if own[id(e)] else outer.get(up, _NONE)
            words = e.within if e.above.main else e.words
            if words and id(e) not in holders:
                if e.title:
                    words = words - {"<header>", "header"}
                for w in words - seen:
                    sums[id(scope), w] = sums.get((id(scope), w), 0) + e.chars
                outer[id(e)] = seen | words
                hints[id(e)] = (words, scope)
        for e in self.elements[1:]:
            words, scope = hints.get(id(e), (_NONE, root))
            named = any(sums.get((id(scope), w), 0) <= MOST * scope.chars for w in words)
            e.boiler = e.hidden or e.above.boiler or named or (e.tag in _BOILERPLATE and not (most and id(e) in holders))

    def blocks(self) -> Iterator[list[tuple[int, Element, str]]]:
        """The texts outside boilerplate of each block: (number of the item, element, text)."""
        run: list[tuple[int, Element, str]] = []
        for k, (kind, element, text) in enumerate(self.items):
            if kind == TEXT:
                if not element.boiler:
                    run.append((k, element, text))
            elif run and (kind == BREAK or element.tag in _BLOCK):
                yield run
                run = []
        if run:
            yield run


def _plain(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _split(block: list[tuple[int, Element, str]], place) -> Iterator[tuple[object, list[tuple[int, Element, str]]]]:
    """A block cut where the place of its texts changes."""
    last, run = None, []
    for piece in block:
        here = place(piece[1])
        if run and here != last:
            yield last, run
            run = []
        last = here
        run.append(piece)
    if run:
        yield last, run


def alone(page: Page, constant: set[int] = frozenset()) -> str:
    """A page's text without a main slot: of what calls itself main, if that is most of it, or else of all but boilerplate.  `judge` comes first."""
    parts, chars, chars_main = [], 0, 0
    for block in page.blocks():
        if all(k in constant for k, _, _ in block):
            continue
        for main, run in _split(block, lambda e: e.main):
            size = sum(len(t.strip()) for _, _, t in run)
            chars += size
            chars_main += size * main
            parts.append((main, _plain([t for _, _, t in run])))
    by_main = chars_main > 0 and chars_main >= MOST * chars
    return " ".join(t for main, t in parts if t and (main or not by_main))


def main_text(text: str, slot: str | None = None) -> str:
    """The text of a page by itself, or of what it holds at a slot (a path)."""
    paths = Paths()
    page = Page(text, paths)
    if slot is None:
        page.judge()
        return alone(page)
    at = next((path for path in range(len(paths.parent)) if paths.text(path) == slot), -1)
    page.judge(at)
    inside = paths.below(np.arange(len(paths.parent)) == at)
    return " ".join(t for t in (_plain([t for _, e, t in block if inside[e.path]]) for block in page.blocks()) if t)


class Tokens:
    """The token sequences of a part's pages: for each occurrence its token's number, page and position; for each text its words' tokens."""

    def __init__(self, pages: list[Page], words: bool = True):
        number: dict[tuple, int] = {}
        token, page, place = [], [], []
        self.of_text: list[dict[int, list[int]]] = []
        for p, one in enumerate(pages):
            own: list[int] = []
            texts: dict[int, list[int]] = {}
            for k, (kind, e, text) in enumerate(one.items):
                if kind == OPEN or kind == CLOSE:
                    own.append(number.setdefault((e.path, kind), len(number)))
                elif kind == TEXT and words and not e.hidden:
                    if e.seen is None:
                        e.seen = {}
                    found = []
                    for w in (html.unescape(text) if "&" in text else text).split():
                        n = e.seen[w] = e.seen.get(w, 0) + 1
                        found.append(number.setdefault((e.path, w, n), len(number)))
                    if found:
                        texts[k] = found
                        own += found
            token.append(np.array(own, np.int64))
            page.append(np.full(len(own), p, np.int64))
            place.append(np.arange(len(own), dtype=np.int64))
            self.of_text.append(texts)
        self.names = list(number)
        self.token, self.page, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (token, page, place))
        self.pages = len(pages)


def vectors(tokens: Tokens, least: float) -> tuple[dict[bytes, list[int]], dict[int, np.ndarray]]:
    """Tokens on at least so many pages by their occurrence vectors; where each occurs, as increasing numbers over all pages."""
    n = max(tokens.pages, 1)
    key, count = np.unique(tokens.token * n + tokens.page, return_counts=True)
    token = key // n
    support = np.bincount(token, minlength=len(tokens.names))
    frequent = np.flatnonzero(support >= max(least, 2))
    begin = np.searchsorted(token, np.arange(len(tokens.names) + 1))
    vector = np.stack([key % n, count], 1)
    classes: dict[bytes, list[int]] = {}
    for t in frequent.tolist():
        classes.setdefault(vector[begin[t] : begin[t + 1]].tobytes(), []).append(t)
    keep = np.zeros(len(tokens.names), bool)
    keep[frequent] = True
    at = np.flatnonzero(keep[tokens.token])
    at = at[np.argsort(tokens.token[at], kind="stable")]
    where = (tokens.page[at] << 32) | tokens.place[at]
    cut = np.searchsorted(tokens.token[at], np.arange(len(tokens.names) + 1))
    return classes, {t: where[cut[t] : cut[t + 1]] for t in frequent.tolist()}


def ordered(tokens: list[int], where: dict[int, np.ndarray]) -> list[int]:
    """The tokens of a class in their order, without those that break it.

    Equal vectors mean that the k-th occurrences of all tokens belong together: each must come after
    the one before it in the order, and before the first token's next occurrence on the page.
    """
    kept: list[int] = []
    for t in sorted(tokens, key=lambda t: int(where[t][0])):
        if kept:
            first, last, own = where[kept[0]], where[kept[-1]], where[t]
            same = own[:-1] >> 32 == first[1:] >> 32
            if not (last < own).all() or (same & (own[:-1] >= first[1:])).any():
                continue
        kept.append(t)
    return kept


def nested(inner: list[int], outer: list[int], where: dict[int, np.ndarray]) -> bool:
    """Whether all occurrences of a class lie in one gap of another: before, between or after the same tokens of it."""
    marks = np.sort(np.concatenate([where[t] for t in outer]))
    at = np.searchsorted(marks, np.concatenate([where[t] for t in inner])) % len(outer)
    return bool((at == at[0]).all())


def valid_classes(tokens: Tokens, least: float) -> tuple[list[list[int]], dict[int, np.ndarray]]:
    """The ordered, nested equivalence classes, largest first, and where their tokens occur."""
    classes, where = vectors(tokens, least)
    is_word = [len(name) == 3 for name in tokens.names]
    found = [o for o in (ordered(c, where) for c in classes.values()) if len(o) > 1]
    found.sort(key=lambda c: (-len(where[c[0]]) * len(c), c[0]))
    accepted: list[list[int]] = []
    worded: list[list[int]] = []
    for c in found:
        # Elements nest by themselves, so only classes with words can lie across one another's gaps.
        if any(is_word[t] for t in c):
            if not all(nested(c, o, where) or nested(o, c, where) for o in worded):
                c = [t for t in c if not is_word[t]]
            else:
                worded.append(c)
        if len(c) > 1:
            accepted.append(c)
    return accepted, where


class Template:
    """What the pages of one part have in common.

    slot: the main slot's path; boiler: paths that are boilerplate by their links; constant: for each page, the
    numbers of its constant texts; keep: whether constant texts of the main slot stay; classes: the valid classes as token names.
    """

    def __init__(self, pages: list[Page], paths: Paths):
        n, size = len(pages), len(paths.parent)
        self.slot, self.keep, self.classes = None, False, []
        self.constant: list[set[int]] = [set() for _ in pages]
        self.boiler = np.zeros(size, bool)
        for page in pages:
            page.judge()
        if n < 3:
            return
        tokens = Tokens(pages, n >= FEW_PAGES)
        classes, where = valid_classes(tokens, SUPPORT * n)
        self.classes = [[tokens.names[t] for t in c] for c in classes]
        template = {t for c in classes if len(c) >= LEAST for t in c}
        slots: dict[int, np.ndarray] = {}  # how often the element occurs on each page
        for c in classes:
            for t in c:
                name = tokens.names[t]
                if len(name) == 2 and name[1] == OPEN:
                    slots[name[0]] = np.bincount(where[t] >> 32, minlength=n)
        chars, links, fixed = (np.zeros(size, np.int64) for _ in range(3))
        for p, page in enumerate(pages):
            for block in page.blocks():
                found = [t for k, _, _ in block for t in tokens.of_text[p].get(k, ())]
                constant = bool(found) and all(t in template for t in found)
                for k, e, text in block:
                    if constant:
                        self.constant[p].add(k)
                    long = len(text.strip())
                    chars[e.path] += long
                    links[e.path] += long * e.link
                    fixed[e.path] += long * constant
        chars, links = paths.summed(chars), paths.summed(links)
        heavy = np.zeros(size, bool)
        for path in slots:
            heavy[path] = 0 < chars[path] <= MOST * chars[0] and links[path] > LINKS * chars[path]
        self.boiler = paths.below(heavy)
        every, same, of_page = np.zeros(size, np.int64), paths.summed(fixed), np.zeros(n, np.int64)
        if same[0] > ALL * chars[0]:
            self.constant = [set() for _ in pages]
        for p, page in enumerate(pages):
            for block in page.blocks():
                for k, e, text in block:
                    if not self.boiler[e.path] and k not in self.constant[p]:
                        long = len(text.strip())
                        every[e.path] += long
                        of_page[p] += long
        left = paths.summed(every)
        # All that is left on the pages that have the element lies in it; of several on one line the innermost has the largest number.
        once = [path for path, count in slots.items() if (count == 1).sum() >= ONCE * (count > 0).sum()]
        self.slot = max((path for path in once if left[path] and left[path] == of_page[slots[path] > 0].sum()), default=None)
        within = self.slot or 0
        self.keep = same[within] > COPIES * chars[within]

    def texts(self, pages: list[Page], paths: Paths) -> list[str]:
        """The main text of each page."""
        constants = [set() for _ in pages] if self.keep else self.constant
        if self.slot is None:
            return [alone(page, constant) or alone(page) for page, constant in zip(pages, constants, strict=True)]
        inside = np.zeros(len(paths.parent), bool)
        inside[self.slot] = True
        inside = paths.below(inside) & ~self.boiler
        out = []
        for page, constant in zip(pages, constants, strict=True):
            if not any(e.path == self.slot for e in page.elements):
                out.append(alone(page, constant) or alone(page))
                continue
            page.judge(self.slot)
            parts = []
            for block in page.blocks():
                if not all(k in constant for k, _, _ in block):
                    parts += [_plain([t for _, _, t in run]) for within, run in _split(block, lambda e: inside[e.path]) if within]
            text = " ".join(t for t in parts if t)
            if not text:
                page.judge()
                text = alone(page)
            out.append(text)
        return out


def host_of(url_col: str):
    """The lower-case host of a URL, without user or port; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(authority)


def dealt(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, host, part), the rows of a part next to one another in one partition."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host")
    )
    sizes = saved(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("html")).alias("bytes")), "hosts")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = F.ceil(F.greatest(F.col("pages") / PART_PAGES, F.coalesce("bytes", F.lit(0)) / PART_BYTES)).cast("int")
    large = sizes.select(F.col("host").alias("_host"), parts.alias("_parts")).where("_parts > 1")
    spot = F.xxhash64("url", "html")
    if large.count() <= FEW_HOSTS:
        rows = rows.join(F.broadcast(large), F.col("host") == F.col("_host"), "left")
    else:
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.join(salted, (F.col("host") == F.col("_host")) & (F.pmod(spot, F.lit(SALT)) == F.col("_salt")), "left")
    rows = rows.select("page_id", "url", "html", "host", F.coalesce(F.pmod(F.xxhash64("url", "html", F.lit("part")), F.col("_parts")), F.lit(0)).cast("int").alias("part"))
    return rows.repartition(max(8, -(-total // TASK_BYTES)), "host", "part").sortWithinPartitions("host", "part")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """The rows (page_id, url, html) of each part in turn."""
    key, rows = None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("host", "part", "page_id", "url", "html")]
        for host, part, *row in zip(*columns, strict=True):
            if (host, part) != key:
                if rows:
                    yield key, rows
                key, rows = (host, part), []
            rows.append(tuple(row))
    if rows:
        yield key, rows


def deduce(htmls: list[str | None]) -> tuple[Template, list[Page], Paths]:
    """The template of some pages of one host."""
    paths = Paths()
    pages = [Page(text or "", paths) for text in htmls]
    return Template(pages, paths), pages, paths


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each part of a host: slot (the main slot's path), pages, classes (valid equivalence classes), tokens (in them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, part), rows in _by_part(batches):
            found, _, paths = deduce([r[2] for r in rows])
            yield pa.RecordBatch.from_pylist(
                [{"host": host, "part": part, "slot": paths.text(found.slot) if found.slot is not None else None, "pages": len(rows), "classes": len(found.classes), "tokens": sum(map(len, found.classes))}],
                pa.schema([("host", pa.string()), ("part", pa.int32()), ("slot", pa.string()), ("pages", pa.int64()), ("classes", pa.int64()), ("tokens", pa.int64())]),
            )

    return dealt(pages, id_col, url_col, html_col).mapInArrow(lean(run), "host string, part int, slot string, pages long, classes long, tokens long")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            template, own, paths = deduce([r[2] for r in rows])
            texts = template.texts(own, paths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return dealt(pages, id_col, url_col, html_col).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
