"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, declarations and tags; a tag or comment that the page's end cuts off counts to the end.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
#: Elements whose text is never shown as text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a line of text: no part of a path, and no end of a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements that are never part of an article, and the two that may hold an article's own heading or note.
OFF = {"nav", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video", "math", "map", "fieldset", "datalist", "input", "footer"} | RAW
#: Words in class, id or role that mark what surrounds an article, where they make up a whole name, alone or with one another or NEUTRAL ones.
NOTED = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|notification|alerts?|popup|modal|overlay|sidebar\w*|side|aside|widget\w*|menus?|nav\w*|breadcrumbs?|"
    r"footer\w*|foot|header|masthead|topbar|toolbar|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|"
    r"pagination|pager|tags?|copyright|legal|disclaimer|skip|hidden|screen-reader-text|sr-only|complementary|navigation|contentinfo|banner|dialog|form)",
    re.I,
)
NEUTRAL = {"site", "page", "top", "bottom", "left", "right", "global"}
#: Of these, the words that an article's own heading bears too, and those that mark an article element as another's.
HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|tags?)(?=$|[\s_-])", re.I)
OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related\w*|recommend\w*|sponsor\w*|ads?|advert\w*|promo\w*|teasers?|widget\w*)(?=$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article\w*|articlebody|main|content|post|entry|story)(?=$|[\s_-])", re.I)
#: What an opening tag ends when it is still open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
KEEPS_P = INLINE | VOID
SCOPE = frozenset(("table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "blockquote"))
BARRIER = SCOPE - {"div"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、'\"()«»„“”¿¡-]")
SPACE = re.compile(r"\s+")
#: Elements that hold text rather than a page's parts, and the share of text that makes a container the article's.
TEXTUAL, MOST = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"}, 0.6
#: Share of the standard deviation of smoothed ratios that a path must reach, and the width of smoothing.
SHARE, WIDTH = 0.8, 1
#: Characters a node from which links in an article are a list of sources.
LONG = 40
#: What is left of the ratio of a path that NOTED marks.
PENALTY = 0.1


class Path:
    """A tag path from the root: its last step, and the path above. A page has one of each, numbered in order of appearance."""

    __slots__ = ("number", "step", "tag", "above")

    def __init__(self, number: int, step: str, tag: str, above: Path | None):
        self.number, self.step, self.tag, self.above = number, step, tag, above


class Block:
    """The text between two block boundaries, with the tag path from the root to it."""

    __slots__ = ("path", "parts", "linked", "off", "main", "note")

    def __init__(self, path: Path, off: bool, main: int, note: int):
        self.path, self.parts, self.linked, self.off, self.main, self.note = path, [], 0, off, main, note


class Open:
    """The elements that are open, outermost first, and where each tag is among them."""

    def __init__(self, root: Path):
        self.rows: list[tuple[str, Path, bool, int, int]] = [("", root, False, 0, -1)]  # tag, path, off, main, innermost note
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, path: Path, off: bool, main: int, note: int) -> None:
        self.at[tag].append(len(self.rows))
        self.rows.append((tag, path, off, main, note))

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> bool:
        """Closes the innermost ``tag`` and all in it, unless an element of ``within`` lies in between or it isn't open."""
        places = self.at[tag]
        if not places or any(own[-1] > places[-1] for s in within if (own := self.at[s])):
            return False
        to = places[-1]
        while len(self.rows) > to:
            self.at[self.rows.pop()[0]].pop()
        return True


def blocks(page: str) -> list[tuple[Path, str, int, float, int]]:
    """(path, text, characters in links, weight, main) of each block with text, in page order.

    Lenient as browsers are: an open p ends at the next block, unknown end tags are ignored, whatever is
    still open ends with the page. Weight: 0 below an element that is never part of an article, PENALTY below one that names
    itself as what surrounds articles, unless that holds an article or most of the page's text, else 1.
    ``main``: 2 below an article element, 1 below main or a class named so, else 0. An element knows the path and the note
    above it by number, so depth costs nothing and each tag a look at some lists.
    """
    out: list[Block] = []
    paths: dict[tuple[int, str], Path] = {}
    root = Path(0, "", "", None)
    stack = Open(root)
    holds: list[bool] = []  # by note: whether the element holds an article; and the note above it
    outer: list[int] = []
    now: Block | None = None
    links, named_one = 0, False
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            _, path, off, main, note = stack.rows[-1]
            now = Block(path, off, main, note)
            out.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            if stack.close(name, BARRIER if name in ("p", "li", "td", "th", "tr") else frozenset()):
                now, links = None, 0
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if not m[3].endswith("/") else None
            at = close.end() if close else (at if m[3].endswith("/") else end)
            continue
        if name == "br":
            text("\n")
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            continue
        now, links = None, 0
        for open_tag in ENDS.get(name, {"p"}):
            stack.close(open_tag, SCOPE)
        if name in VOID:
            continue
        _, path, off, main, note = stack.rows[-1]
        named = ""
        if m[3] and "=" in m[3] or "hidden" in m[3].lower():
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role", "itemprop"):
                    named += " " + value
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    off = True
        inside = main > 0
        main = max(main, 2 if name == "article" else int(name == "main" or bool(named and MAIN.search(named))))
        if name in OFF:
            off = True
        if name in ("article", "main") and not inside and not OTHERS.search(named):
            named_one = True
            if note >= 0:
                holds[note] = True
        if name == "header" and not inside or named and _noted(name, named, inside):
            outer.append(note)
            note = len(holds)
            holds.append(False)
        step = name + ("." + ".".join(sorted(set(named.split()))) if named else "")
        own = paths.get((path.number, step))
        if own is None:
            own = paths[path.number, step] = Path(len(paths) + 1, step, name, path)
        stack.push(name, own, off, main, note)
    found: list[tuple[Path, str, int, float, int]] = []
    size, whole = [0] * len(holds), 0
    for b in out:
        if not b.off:
            n = sum(map(len, b.parts))
            whole += n
            if b.note >= 0:
                size[b.note] += n
    for k in range(len(holds) - 1, -1, -1):  # a note comes after the one above it
        if outer[k] >= 0:
            size[outer[k]] += size[k]
            holds[outer[k]] |= holds[k]
    # Beside a named article, however short, an advert may have more than half of the text.
    most = 0.8 if named_one else 0.5
    noted: list[bool] = []
    for k, n in enumerate(size):
        noted.append(not holds[k] and n <= most * whole or outer[k] >= 0 and noted[outer[k]])
    for b in out:
        said = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        if said:
            found.append((b.path, said, b.linked, 0 if b.off else PENALTY if b.note >= 0 and noted[b.note] else 1, b.main))
    return found


def _noted(name: str, named: str, inside: bool) -> bool:
    """Whether the classes of an element say that it surrounds an article."""
    if name in ("main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    if name == "article":
        return bool(OTHERS.search(named))
    for token in named.lower().split():
        if inside and HEADING.search(token):
            continue
        if NOTED.fullmatch(token):
            return True
        parts = [x for x in re.split(r"[_-]+", token) if x not in NEUTRAL]
        if parts and all(map(NOTED.fullmatch, parts)):
            return True
    return False


def _smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing over the paths in page order."""
    kernel = [math.exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(-WIDTH, WIDTH + 1)]
    out = []
    for k in range(len(values)):
        near = [(kernel[d + WIDTH], values[k + d]) for d in range(-WIDTH, WIDTH + 1) if 0 <= k + d < len(values)]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def ratios(found: list[tuple[Path, str, int, float, int]]) -> tuple[dict[Path, list[float]], dict[Path, float], float]:
    """Of each path with weight, in order of appearance: (nodes, characters, signs, characters in links, weight, main); its fused ratio; the threshold.

    Per path: text length a node, and punctuation a node, over all its nodes (Wu et al., 2013), both
    smoothed over neighbouring paths, fused by their product, lowered by the share of text in links and by
    PENALTY. The threshold is a share of the fused ratios' standard deviation.
    """
    totals: dict[Path, list[float]] = {}
    for path, said, linked, weight, main in found:
        if not weight:
            continue
        t = totals.setdefault(path, [0, 0, 0, 0, 1, main])
        t[0] += 1
        t[1] += len(said)
        t[2] += len(PUNCTUATION.findall(said))
        t[3] += min(linked, len(said))
        t[4] = min(t[4], weight)
    length = _smooth([t[1] / t[0] for t in totals.values()])
    signs = _smooth([(t[2] + 1) / t[0] for t in totals.values()])
    fused = {p: math.sqrt(a * b) * (1 - t[3] / t[1]) * t[4] for a, b, (p, t) in zip(length, signs, totals.items())}
    mean = sum(fused.values()) / max(1, len(fused))
    return totals, fused, SHARE * math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / max(1, len(fused)))


def content_paths(found: list[tuple[Path, str, int, float, int]]) -> set[Path]:
    """The paths whose nodes are content: those whose fused ratio reaches the threshold, and what belongs to them.

    The container of most of the chosen text
    gives its headings, lists and quotes too. Where most of the chosen text lies in what the page names its
    article, the container is the whole of that, and paths outside are content only by a ratio of their own
    that reaches the chosen ones' mean.
    """
    totals, fused, limit = ratios(found)
    if not totals:
        return set()
    paths = list(totals)
    chosen = {p for p, x in fused.items() if x >= limit and totals[p][3] < 0.5 * totals[p][1]}
    size = [sum(totals[p][1] for p in chosen if totals[p][5] >= level) for level in (0, 1, 2)]
    level = max(k for k in (0, 1, 2) if size[k] >= MOST * size[0])
    home = _home({p: totals[p][1] for p in chosen if totals[p][5] >= level})
    if level:
        home = _article(home)
    under = _under(paths, home)
    inside = {p for p in paths if p in under and totals[p][5] >= level}
    # Headings, lists and quotes in the container of the chosen text belong to it, other boxes beside it don't.
    out = {p for p in inside if (totals[p][4] == 1 or p in chosen and not level) and totals[p][3] < (0.8 if level else 0.5) * totals[p][1]}
    if level:
        # Sources and references are links, but long ones.
        out |= {p for p in inside if totals[p][4] == 1 and totals[p][1] >= LONG * totals[p][0]}
        if own := [p for p in chosen if p in inside]:
            reach = sum(fused[p] * totals[p][1] for p in own) / sum(totals[p][1] for p in own)
            out |= {p for p in chosen if p not in inside and totals[p][4] == 1 and fused[p] >= reach}
    return out


def _tree(paths: Iterable[Path]) -> list[Path]:
    """The given paths and all above them, each once, in order of their numbers."""
    seen: dict[int, Path] = {}
    for p in paths:
        while p is not None and p.number not in seen:
            seen[p.number] = p
            p = p.above
    return [seen[k] for k in sorted(seen)]


def _under(paths: Iterable[Path], home: Path | None) -> set[Path]:
    """Those of the given paths, and of all above them, that are ``home`` or below it; all, if there is no home."""
    out: set[Path] = set()
    for p in _tree(paths):  # a path comes after the one above it
        if home is None or p is home or p.above in out:
            out.add(p)
    return out


def _article(home: Path | None) -> Path | None:
    """The innermost element on the path ``home`` that is or names itself the article, else ``home``."""
    for names in (lambda x: x.tag in ("article", "main"), lambda x: MAIN.search(" ".join(x.step.split(".")[1:]))):
        p = home
        while p is not None and p.above is not None:
            if names(p):
                return p
            p = p.above
    return home


def _home(sizes: dict[Path, int]) -> Path | None:
    """The innermost container, from the root down, that holds most of the text of the given paths; of equals the first on the page."""
    tree = _tree(sizes)
    if not tree:
        return None
    whole = {p.number: sizes.get(p, 0) for p in tree}
    below: defaultdict[int, list[Path]] = defaultdict(list)
    for p in reversed(tree):
        if p.above is not None:
            whole[p.above.number] += whole[p.number]
            below[p.above.number].append(p)
    home = tree[0]
    while True:
        best = max((p for p in reversed(below[home.number]) if p.tag not in TEXTUAL), key=lambda p: whole[p.number], default=None)
        if best is None or whole[best.number] < MOST * whole[home.number]:
            return home
        home = best


def main_text(page: str) -> str:
    """The main text of one page: its content blocks in page order, joined by a line feed."""
    found = blocks(page)
    paths = content_paths(found)
    return "\n".join([said for path, said, _, weight, _ in found if weight and path in paths])


def extract(page: Column) -> Column:
    """The main text of each whole page (null: empty), never null; rows stay where they are.

    It depends on the page alone, so equal pages have equal texts, whatever else the row holds. Of containers
    with equally much of the chosen text the first on the page counts. Work follows the page's length.
    """

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in series:
            yield pd.Series([main_text(p or "") for p in pages], dtype=object)

    return run(F.coalesce(page, F.lit("")))
