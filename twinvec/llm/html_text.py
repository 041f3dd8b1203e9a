"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. A line's weight is its text
length, less twice the text of links; where the page marks its article (<article>, <main>), lines
outside it weigh nothing and a line inside it its length and SURGE, so that a short one surges, too. Lines inside menus,
headers, footers, sidebars, adverts, forms and reader comments, known by their element, role, class or id,
are none of the text, nor are such stretches and hidden ones within a line. A name counts if all its parts do or say nothing, and an element
with most of the text is not judged by its names. Sums over WINDOW neighbouring lines form the
distribution. A region begins where the sum surges over SURGE at a line
with weight and ends where it dives back, less lines without weight at its ends;
the lines of all regions are the text.

Null html gives an empty text, as does a page without content. Pages are judged
one by one, whole: repeated rows, ties, extra columns and empty tables need no
care. A comment, script or tag that never ends runs to the page's end.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 60
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select xmp noframes title".split())
SKIP = frozenset("nav footer aside form button dialog menu fieldset label input datalist audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
MAIN = frozenset(("article", "main"))
#: Elements that stay inside a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that mark boilerplate.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser
    comment comments reply replies respond disqus discussion pagination pager widget form search skip""".split()
)
HEAD_NAMES = frozenset(("header", "head"))
COMMENTS = frozenset("comment comments reply replies respond disqus discussion teaser related".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Names that leave no doubt, and words that make no subject of what they stand beside.
SURE = NAMES - frozenset(
    """promotion navigation menu consent notice notices alert subscribe subscription signup login share sharing social related recommended
    recommendations teaser reply replies respond discussion widget form search skip banner sponsored overlay""".split()
)
TOPICS = frozenset("adverts advertisement advertising sponsor advert comment cookie cookies newsletter pagination breadcrumb aside".split())
PLAIN = frozenset("box wrap wrapper container inner outer bar block area panel list item items unit slot content body top bottom left right main primary secondary site page global".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Attributes one by one, values consumed.
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")


def _named(token: str, is_id: bool) -> bool:
    """Whether a class or id name says boilerplate: all its parts do or say nothing, and one does for sure."""
    parts = [x for x in _PARTS.split(token) if x]
    if not all(x in NAMES or x in PLAIN for x in parts):
        return False
    return any(x in SURE for x in parts) and not (is_id and len(parts) == 1 and parts[0] in TOPICS)


def _boilerplate(name: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate by what it is, by its names, and of these by
    names of reader comments."""
    if name in ("html", "body"):
        return False, False, False
    if name in SKIP or (name == "header" and not in_main):
        return True, False, False
    if not attrs:
        return False, False, False
    by_name = comments = False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            if value.strip() in ROLES:
                return True, False, False
        elif key == "style":
            if _HIDDEN.search(value):
                return True, False, False
        elif key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            return True, False, False
        elif key in ("class", "id") and name not in HEADINGS:
            for token in value.split():
                parts = set(_PARTS.split(token))
                if name in MAIN:
                    says = bool(parts & COMMENTS) and parts - {""} <= COMMENTS | PLAIN
                else:
                    says = _named(token, key == "id") or (not in_main and token in HEAD_NAMES)
                by_name |= says
                comments |= says and bool(parts & COMMENTS)
    return False, by_name, comments


def lines(page: str) -> tuple[list[tuple[str, int, bool, bool]], bool]:
    """((text, length of links, boilerplate, in the main part) of each line;
    whether the page marks its main part)."""
    out: list[tuple[str, int, bool, bool]] = []
    buf: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, boilerplate, main, place in named
    named: list[list] = []  # first line, end, of comments: elements that are boilerplate by their names
    mains: list[list] = []  # first line, end, boilerplate of each main part
    open_mains: list[int] = []
    bad = inside = links = anchors = 0
    pos, n = 0, len(page)
    opened: dict[str, int] = {}  # of each name, elements on the stack
    mute, mute_name, mute_at = 0, "", 0  # depth inside a stretch to leave out, its element, the stack's height

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            if text:
                out.append((text, links, bad > 0, inside > 0))
            buf.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal bad, inside, mute
        while len(stack) > k:
            x, b, m, w = stack.pop()
            opened[x] -= 1
            bad, inside = bad - b, inside - m
            if m:
                mains[open_mains.pop()][1] = len(out)
            if w >= 0:
                named[w][1] = len(out)
        if len(stack) < mute_at:
            mute = 0  # an inline element ends with the block that it is in

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            piece = page[pos:at] if not mute else ""
            buf.append(piece)
            if anchors:
                links += len(piece.strip())
        if at >= n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            if not mute:
                buf.append(page[at + 9 : n if end < 0 else end].replace("&", "&amp;"))
            pos = n if end < 0 else end + 3
            continue
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?"):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        if not (follows == "/" or (follows.isascii() and follows.isalpha())):
            buf.append("<")
            pos = at + 1
            continue
        m = _TAG.match(page, at)
        if m:
            shut, name, attrs, pos = m[1], m[2].lower(), m[3], m.end()
        else:  # a quote that never ends, or no end of the tag
            end = page.find(">", at)
            if end < 0:
                break
            head = re.match(r"</?([a-zA-Z][^\s/>]*)", page[at : at + 64])
            pos = end + 1
            if not head:
                continue
            shut, name, attrs = page[at + 1] == "/", head[1].lower(), ""
        if name not in INLINE and name not in RAW:
            flush()
        elif name == "br":
            buf.append(" ")
        if name == "a":
            anchors = 0 if shut else 1
        if shut:
            if name in INLINE:
                mute -= mute > 0 and name == mute_name
            elif opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW:
            if attrs.endswith("/"):
                continue
            end = re.compile(f"</{re.escape(name)}(?![a-zA-Z0-9])", re.I).search(page, pos)
            if not end:
                break
            end_tag = page.find(">", end.end())
            pos = n if end_tag < 0 else end_tag + 1
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name in INLINE:
            if mute:
                mute += name == mute_name
            elif attrs and any(_boilerplate(name, attrs, inside > 0)[:2]):
                mute, mute_name, mute_at = 1, name, len(stack)
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)  # its end tag may be left out
        bp, by_name, comments = _boilerplate(name, attrs, inside > 0)
        is_main = name in MAIN and not (bp or by_name)
        if is_main:
            open_mains.append(len(mains))
            mains.append([len(out), 0, bad > 0])
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, bp, is_main, len(named) if by_name else -1))
        if by_name:
            named.append([len(out), 0, comments])
        bad, inside = bad + bp, inside + is_main
    flush()
    close(0)
    return _judged(out, named, mains)


def _judged(out: list, named: list, mains: list) -> tuple[list[tuple[str, int, bool, bool]], bool]:
    """Lines of elements named as boilerplate become it, but for those of an element
    with most of the text (one named for comments: and with a main part)."""
    size = [0]
    for t, _, bp, _ in out:
        size.append(size[-1] + (0 if bp else len(t)))
    waiting = list(named)
    while True:
        cover = [0] * (len(out) + 1)
        for a, b, _ in waiting:
            cover[a] += 1
            cover[b] -= 1
        depth, free, hidden = 0, 0, []
        for i, (t, _, bp, _) in enumerate(out):
            depth += cover[i]
            hidden.append(bp or depth > 0)
            free += 0 if hidden[-1] else len(t)
        shown = any(a < b and not bad and not hidden[a] for a, b, bad in mains)
        for w in waiting:
            a, b, comments = w
            has_main = not shown and any(a <= x and y <= b and x < y and not bad for x, y, bad in mains)
            if size[b] - size[a] > free and (has_main or (not comments and size[b] - size[a] > SURGE)):
                waiting.remove(w)  # and once more, with its lines
                break
        else:
            return [(t, n, h, m) for (t, n, _, m), h in zip(out, hidden, strict=True)], shown


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not page:
        return ""
    found, marked = lines(page)
    if not found:
        return ""
    # Tags weigh the lines; the distribution of the weights picks them.
    weight = [None if bad else (len(t) + surge if main else 0) if marked else max(0, len(t) - 2 * a) for t, a, bad, main in found]
    return "\n\n".join(found[i][0] for i in picked(weight, window, surge))


def picked(weight: list[int | None], window: int = WINDOW, surge: int = SURGE) -> list[int]:
    """The lines between each surge and dive of the sums over a window, less lines
    without weight at either end. Lines of weight null, boilerplate, are in no sum and not picked."""
    at = [i for i, w in enumerate(weight) if w is not None]
    n, half = len(at), window // 2
    prefix = [0]
    for i in at:
        prefix.append(prefix[-1] + weight[i])
    sums = [prefix[min(n, i + half + 1)] - prefix[max(0, i - half)] for i in range(n)]
    regions: list[tuple[int, int]] = []
    start = None
    for i in range(n + 1):
        if start is None:
            if i < n and weight[at[i]] and sums[i] > surge:
                start = i  # surge
        elif i == n or sums[i] <= surge:
            regions.append((start, i))  # dive
            start = None
    if not regions and prefix[-1]:  # too short a page to surge: the whole is the region
        regions = [(0, n)]
    out: list[int] = []
    for a, b in regions:
        while not weight[at[a]]:
            a += 1
        while not weight[at[b - 1]]:
            b -= 1
        out += at[a:b]
    return out


def extract(pages: DataFrame, html: Column | str = "html", text: str = "text") -> DataFrame:
    """Adds (or replaces) the column `text`."""

    @F.pandas_udf("string")
    def of(col: pd.Series) -> pd.Series:
        return col.map(main_text)

    return pages.withColumn(text, of(F.col(html) if isinstance(html, str) else html))
