"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block; a line weighs as many characters as its text has outside links. The weights
are summed over sliding windows of ``WINDOW`` lines: a run of text begins where a window's sum surges to ``SURGE`` and ends
where it dives below ``DIVE``. What lies between a surge and its dive is the text, and a page may have several such runs.

Three things help the distribution:

* Names lower weights. Lines within navigation, footers, asides, forms, or elements whose class, id or role names them a menu,
  an advert, a notice, a sidebar, reader comments and the like weigh nothing. Only where all other text is less than a surge does
  such an element keep its weight, if it holds most of the text.
* Boxes smooth the edges. A thin line next to a run stays if it stands in the same box (``div``, ``section``, ...) as the run's
  heavy lines, and a run's first or last lines go if they are mostly links or stand in boxes without heavy lines.
* Marks (``article``, or else ``main``) are one box each. Where marks hold at least half as much as all runs outside them, lines
  outside weigh nothing; else marks are ignored. Marks of less than a third of the heaviest one's weight do not
  count, but articles that are siblings of the heaviest one do. An article within an article is a comment, unless it has half the weight of the outer one.

Defined results: null or empty html gives an empty text; a page without any surge gives all lines that weigh something
(of its marks, if it has any); unclosed comments, scripts and tags reach to the end; unclosed elements end with their
parent; end tags that close nothing are passed over. The time is linear in the page's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, the sum that a surge must reach, and the one below which the text ends.
WINDOW, SURGE, DIVE = 3, 80, 24

# Elements of HTML, and words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title xmp iframe noembed noframes"
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody template tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br button option optgroup noscript template".split())
DROPPED = frozenset("nav footer aside form head noscript template select button svg object canvas audio video map dialog menu datalist".split())
HEADERS = frozenset("header hgroup".split())
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion "
    "menu submenu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer copyright legal disclaimer cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending popular comment comments commentlist disqus respond replies reply discussion search toolbar pagination pager "
    "contentinfo complementary form".split()
)
HEADER_WORDS = frozenset("header masthead topbar banner".split())
#: Words that say nothing beside those above (``site-footer``, ``comment-body``); any other word in a name makes it a subject (``social-science``).
PLAIN_WORDS = frozenset(
    "a area aside articles bar block body bottom box btn button buttons card center col column container content div global grid group holder icon icons "
    "id img inner item items js large left link links list lists main media medium module more nav outer page panel post posts primary reader right row "
    "secondary section site slot small sticky story text top ul unit user users view wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOXES = frozenset("article aside body center dialog div fieldset footer form header html main nav section".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b(?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+')?)*?>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
#: Words that make a name say something of a page's layout (``has-sidebar``), not of the element.
_LAYOUT = frozenset("no has with without hide show".split())


class _Element:
    """An open element: what it is, and where its lines begin and end (places)."""

    __slots__ = ("begin", "box", "closed", "drop", "end", "holds", "inside", "mark", "name", "nr", "parent")

    def __init__(self, name: str, nr: int, begin: int, drop: str, mark: str):
        self.name, self.nr, self.begin, self.end, self.drop, self.mark = name, nr, begin, -1, drop, mark
        self.closed, self.holds, self.inside, self.box, self.parent = False, 0, 0, nr, 0


class _Line:
    """A block's text: its weight, its place in the page, the box it stands in (-1: paragraphs of the page itself, 0: what else has no box)."""

    __slots__ = ("box", "heading", "place", "text", "weight")

    def __init__(self, text: str, linked: int, place: int, box: int, heading: bool):
        self.text, self.place, self.box, self.heading = text, place, box, heading
        self.weight = max(0, len(text) - linked)

    def links(self) -> bool:
        """Whether most of it is links."""
        return 2 * self.weight < len(self.text)


def _names(own: list[str], wanted: frozenset[str]) -> bool:
    """Whether a class, id or role, as words, is a name for what is ``wanted``, and not for a subject that only has the word."""
    return any(w in wanted for w in own) and all(w in wanted or w in PLAIN_WORDS or w in NOT_TEXT or w in HEADER_WORDS or w[0].isdigit() for w in own)


def _kind(name: str, attrs: str) -> tuple[str, str]:
    """Why an element's text isn't the article's ("always", "header", "words" or ""), and what it marks ("article", "main" or "")."""
    words = header = main = False
    if attrs:
        for kind, *values in _NAMED.findall(attrs):
            for given in "".join(values).split():
                own = [w.lower() for w in _WORDS.findall(given)]
                if not _LAYOUT.intersection(own):
                    # an article is often classed by its subjects, too; only the beginning of such a name counts
                    own = own[:1] if name in ("article", "main") else own
                    words, header = words or _names(own, NOT_TEXT), header or _names(own, HEADER_WORDS)
                    main = main or kind.lower() == "role" and own == ["main"]
        if _HIDDEN.search(attrs):
            return "always", ""
    mark = "article" if name == "article" or "articleBody" in attrs else "main" if main or name == "main" else ""
    if name in DROPPED:
        return ("words" if name == "form" else "always"), ""
    if name in HEADERS or header:
        return "header", ""
    if words and name not in ("html", "body", "main"):
        return "words", ""
    return "", mark


def _blocks(html: str) -> tuple[list[_Line], list[_Element]]:
    """The page's lines, and the elements that lower weights or mark the article, with the places they cover."""
    lines: list[_Line] = []
    elements: list[_Element] = []
    stack: list[_Element] = []
    open_: dict[str, list[int]] = {}  # where on the stack elements of a name are
    pieces: list[str] = []
    linked, in_link, place, marks, opened, nr = 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, place
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                box, name = (stack[-1].box, stack[-1].name) if stack else (0, "")
                lines.append(_Line(text, linked, place, box or -(name == "p"), name in HEADINGS))
            pieces.clear()
        linked = 0
        place += 1

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw.strip())

    def pop(to: int, closed: bool) -> None:
        nonlocal opened
        while len(stack) > to:
            e = stack.pop()
            open_[e.name].pop()
            e.end, e.closed = place, closed and len(stack) == to
            e.holds = marks - e.holds
            opened -= bool(e.mark)

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in BLOCKS:
            flush()
        elif name in ("td", "th"):
            pieces.append(" ")
        if name == "a":
            in_link = 0 if end else 1
        if name in VOID:
            continue
        if end:
            if where := open_.get(name):
                pop(where[-1], True)
            continue
        if name in CLOSES_P and (where := open_.get("p")) and where[-1] >= len(stack) - 4:
            pop(where[-1], True)
        if (over := IMPLIED.get(name)) and stack and stack[-1].name in over:
            pop(len(stack) - 1, True)
        if attrs.endswith("/") and name not in BLOCKS:
            continue
        drop, mark = _kind(name, attrs)
        nr += 1
        e = _Element(name, nr, place, drop, mark)
        marks += bool(mark)
        e.holds, e.inside, e.parent = marks, opened, stack[-1].nr if stack else 0
        opened += bool(mark)
        if name not in BOXES:
            e.box = stack[-1].box if stack else 0
        elif name in ("body", "html"):
            e.box = 0
        stack.append(e)
        open_.setdefault(name, []).append(len(stack) - 1)
        if drop or mark:
            elements.append(e)
    text(html[at:])
    flush()
    pop(0, False)
    return lines, elements


class _Sums:
    """Sums of the lines' values over places."""

    def __init__(self, lines: list[_Line], values: list[int]):
        self.sums = [0] * (lines[-1].place + 3)
        for line, v in zip(lines, values, strict=True):
            self.sums[line.place + 1] = v
        for k in range(1, len(self.sums)):
            self.sums[k] += self.sums[k - 1]

    def __call__(self, e: _Element) -> int:
        last = len(self.sums) - 1
        return self.sums[min(e.end, last)] - self.sums[min(e.begin, last)]


def _covered(lines: list[_Line], spans: Iterable[tuple[int, int]]) -> list[bool]:
    """Whether each line is within one of the spans of places."""
    places = lines[-1].place + 2
    steps = [0] * (places + 1)
    for begin, end in spans:
        if begin < end:
            steps[min(begin, places)] += 1
            steps[min(end, places)] -= 1
    depth = list(accumulate(steps))
    return [depth[line.place] > 0 for line in lines]


def _lowered(lines: list[_Line], elements: list[_Element], surge: int) -> list[bool]:
    """Lines that names say are not the article's.

    Where no more than these is left, less than a surge, an element of most of the text that is one has no such name: it is all that
    the page has to say. As long as there is other text, comments and notices stay what they are, however long.
    """
    marked = _covered(lines, ((e.begin, e.end) for e in elements if e.mark))
    some = any(marked)
    base = [line.weight if on or not some else 0 for line, on in zip(lines, marked, strict=True)]
    held, spans = _Sums(lines, base), []
    for e in elements:
        if e.drop and not (e.drop == "header" and e.inside):
            # an element that nothing closes ends with its first block, if it would swallow an article
            spans.append((e, e.begin, e.begin + 1 if e.holds and not e.closed else e.end))
    lowered = _covered(lines, (span[1:] for span in spans))
    if sum(w for w, off in zip(base, lowered, strict=True) if not off) >= surge:
        return lowered
    bulk = lambda e: e.drop in ("header", "words") and surge <= held(e) > held.sums[-1] / 2
    return _covered(lines, (span[1:] for span in spans if not bulk(span[0])))


def _runs(weights: list[int], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """From each surge of the sums over ``window`` lines to the dive that follows."""
    sums, total = [], sum(weights[:window])
    for k in range(len(weights)):
        sums.append(total)
        total += (weights[k + window] if k + window < len(weights) else 0) - weights[k]
    runs, k = [], 0
    while k < len(weights):
        if sums[k] < surge:
            k += 1
            continue
        begin = k
        while not weights[begin]:
            begin += 1
        while k < len(weights) and sums[k] >= dive:
            k += 1
        runs.append((begin, k))
    return runs


def _region(lines: list[_Line], elements: list[_Element], weights: list[int], runs: list[tuple[int, int]]) -> list[int] | None:
    """The number of the mark that each line stands in (0: none), if the page's marks count."""
    in_run = [0] * len(lines)
    for a, b in runs:
        in_run[a:b] = weights[a:b]
    held, ran, sizes = _Sums(lines, weights), _Sums(lines, in_run), _Sums(lines, [len(line.text) for line in lines])
    for kind in ("article", "main"):
        outer: list[_Element] = []
        for e in elements:
            if e.mark == kind and not (outer and e.begin < outer[-1].end):
                outer.append(e)
        if not outer or not any(map(sizes, outer)):
            continue
        inside, outside = sum(map(held, outer)), sum(in_run) - sum(map(ran, outer))
        if 2 * inside < outside:
            continue
        heaviest = max(outer, key=held)
        marks = [e for e in outer if 3 * held(e) >= held(heaviest) or kind == "article" and e.parent == heaviest.parent]
        region, k = [0] * len(lines), 0
        for n, line in enumerate(lines):
            while k < len(marks) and marks[k].end <= line.place:
                k += 1
            if k < len(marks) and marks[k].begin <= line.place:
                region[n] = marks[k].nr
        return region
    return None


def _comments(elements: list[_Element], lines: list[_Line], weights: list[int]) -> list[bool]:
    """Lines of articles within articles, if these are lighter than half of the outer one."""
    held, spans, outer = _Sums(lines, weights), [], None
    for e in elements:
        if e.name == "article" and e.mark:
            if outer and e.begin < outer.end:
                if 2 * held(e) < held(outer):
                    spans.append((e.begin, e.end))
            else:
                outer = e
    return _covered(lines, spans)


def _smoothed(lines: list[_Line], boxes: list[int], weights: list[int], free: list[bool], runs: list[tuple[int, int]], surge: int, marked: set[int]) -> list[bool]:
    """Lines of the runs, with edges moved to those of their boxes; lines that are not ``free`` are dives of their own. ``marked`` boxes need no heavy lines."""
    on = [False] * len(lines)
    heavy = set(marked)
    for a, b in runs:
        top = max(weights[a:b])
        own = {boxes[k] for k in range(a, b) if 2 * weights[k] >= min(surge, top)} | marked
        heavy |= own
        while a < b and (not free[a] or lines[a].links() or boxes[a] not in own and not lines[a].heading):
            a += 1
        while a < b and (not free[b - 1] or lines[b - 1].links() or boxes[b - 1] not in own):
            b -= 1
        on[a:b] = free[a:b]
    # thin lines next to a run, in a box of its own; outside all boxes only between two runs
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = order.step
        for k in order:
            if not on[k] and on[k - step] and free[k] and boxes[k] and boxes[k] in heavy and not lines[k].links():
                on[k] = True
    last = None
    for k in range(len(lines)):
        if on[k]:
            if last is not None and last < k - 1 and boxes[last] == boxes[k] and all(free[x] and boxes[x] == boxes[k] and not lines[x].links() for x in range(last + 1, k)):
                on[last + 1 : k] = [True] * (k - last - 1)
            last = k
    return on


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """The article's blocks, joined by line feeds."""
    if not html:
        return ""
    lines, elements = _blocks(html)
    if not lines:
        return ""
    lowered = _lowered(lines, elements, surge)
    weights = [0 if off else line.weight for line, off in zip(lines, lowered, strict=True)]
    lowered = [x or y for x, y in zip(lowered, _comments(elements, lines, weights), strict=True)]
    weights = [0 if off else w for w, off in zip(weights, lowered, strict=True)]
    runs = _runs(weights, window, surge, dive)
    region = _region(lines, elements, weights, runs)
    free = [not off for off in lowered]
    boxes = [line.box for line in lines]
    if region:
        free = [x and r != 0 for x, r in zip(free, region, strict=True)]
        weights = [w if r else 0 for w, r in zip(weights, region, strict=True)]
        boxes, runs = region, _runs(weights, window, surge, dive)
    if runs:
        on = _smoothed(lines, boxes, weights, free, runs, surge, set(region or ()) - {0})
    else:
        on = [x and (w > 0 or region is not None) for x, w in zip(free, weights, strict=True)]
    return "\n".join(line.text for line, taken in zip(lines, on, strict=True) if taken)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 512):
                own = part.slice(k, 512)
                texts = [main_text(h, window, surge, dive) for h in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages.page_id.cast("long"), pages.url.cast("string"), pages.html.cast("string")).mapInArrow(batches, "page_id long, url string, text string, n_chars long")
