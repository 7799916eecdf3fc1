"""Pages as lines: visible text, link text and enclosing containers of every line.

One pass over the lines of a page with a stack of open block elements. Broken
markup is taken as it comes: a closing tag closes the nearest open element of
its name, or nothing.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field

#: Elements that form containers (fixed values).
CONTAINERS = frozenset(["div", "nav", "article", "aside", "footer", "header", "section", "main", "table", "tr", "td", "ul", "ol", "form"])
#: Elements whose content is no visible text (fixed values).
UNSEEN = frozenset(["script", "style", "head", "title", "noscript", "template"])
#: Elements that break text (fixed values); others are inline.
_TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|width)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# an address is one word, wherever it stands
_DOTTED = re.compile(r"\.[a-z](?<=[a-z0-9]..)")
_WORD_OR_ADDRESS = re.compile(r"(?:https?://)?(?<![\w.@-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![\w.])(?:[:/]\S*)?|\w+|\x01")
_HTML = re.compile(r"<(html|body|div|p|table|!doctype)\b", re.I)
_OBJECT = re.compile(r"\s*(?:\[\s*)?\{\s*\"(?:[^\"\\\n]|\\.)*\"\s*:")
_BREAK, _MARK = "\x02", "\x01"
# ends of segments: a sentence, an element, an entry of a row of entries
_SENTENCE = re.compile(r"[.!?…:][\"”»’)]* ")
_ENTRY = re.compile(r" [·|•>/-] ")
_ENTRIES = (" | ", " · ", " - ", " > ", " / ", " • ")
# signs beyond ASCII that stand in running text (fixed values); words with others are found by the pattern below
_SIGNS = re.compile("[«»“”„‘’‚‹›–—…·•©£€¿¡°№®™§´\xa0]")
_WORD_OR_MARK = re.compile(r"\w+|\x01")
# ASCII text is cut into words by a table
_ASCII = bytes(c if chr(c) == _MARK or chr(c) == "_" or (c < 128 and chr(c).isalnum()) else 32 for c in range(256))
_WIDE = _ASCII[:128] + bytes(range(128, 256))
# a line that is one element of text and no container
_SIMPLE = re.compile(r"<(p|li|h[1-6]|span|td|dd|dt)(?: [^<>]*)?>([^<>]*)</\1>\s*$", re.I)
_QUOTES = "\"'"
#: Elements of tables (fixed values); their cells are no units of a line.
TABLE = frozenset(["table", "tr", "td", "th", "tbody", "thead"])
INLINE = frozenset(["a", "b", "i", "em", "strong", "span", "font", "small", "u", "sup", "sub", "mark", "abbr"])

# kinds of elements: links, inline, containers, those whose content is not seen, and others
_LINK, _FLOWS, _HOLDS, _HIDES, _BLOCK = range(5)
_KIND = {x: _FLOWS for x in INLINE} | {"a": _LINK} | {x: _HOLDS for x in CONTAINERS} | {x: _HIDES for x in UNSEEN}


def squeeze(text: str) -> str:
    """``text`` with character references resolved and blanks squeezed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


@dataclass(slots=True)
class Line:
    """A line with visible text; texts are words in lower case with a blank between."""

    no: int
    text: str = ""
    #: the text outside links
    own: str = ""
    links: int = 0
    #: containers open where the line's text begins
    path: tuple[str, ...] = ()
    #: name of the first element of the line
    element: str = ""
    #: numbers of words of its segments (elements, sentences, entries), if there are several
    cuts: tuple[int, ...] = ()
    #: the same of the text outside links
    own_cuts: tuple[int, ...] = ()
    #: what its punctuation tells, see :data:`ENDS` and those below
    flags: int = 0
    #: the words before a colon
    label: str = ""
    #: the text as a unit, filled in where it is needed
    unit: str = ""


#: Ends like a sentence; ends with any mark; names what the page is filed under; is about the page;
#: has signs of no script of the corpus.
ENDS, CLOSED, FILED, ABOUT, GARBLED = (1 << k for k in range(5))
#: Share of signs of no script that shows a line to be garbled.
GARBLED_SHARE = 0.08

_CLOSERS = "\"”»’)]"
_FILED = re.compile(r"(#\s*|\w+:\s*)[^\s,#]+(,\s*[^\s,]*)*$")
_LABEL = re.compile(r"^\s*([^:]{2,60}):\s")
# all but letters and marks of the corpus' scripts (fixed values)
_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿŒœŠšŽžŸА-яЁё«»¿¡‘’“”„–—…•·€£©№°\xa0]")


def words_of(text: str) -> str:
    """Words of ``text`` in lower case, with one blank between; an address is one word."""
    return cut(text)[0]


def cut(text: str) -> tuple[str, tuple[int, ...]]:
    """Words of ``text`` (blanks squeezed) in lower case with one blank between, and the numbers of words of its segments, if there are several.

    An address is one word.
    """
    marked = _SENTENCE.sub(" \x01 ", text)
    if _BREAK in marked:
        marked = marked.replace(_BREAK, " \x01 ")
    for x in _ENTRIES:
        if x in marked:
            marked = _ENTRY.sub(" \x01 ", marked)
            break
    if "." in marked and _DOTTED.search(marked):
        words = [x.lower() for x in _WORD_OR_ADDRESS.findall(marked)]
    elif marked.isascii():
        words = marked.lower().encode().translate(_ASCII).decode().split()
    else:
        low = marked.lower()
        words = _SIGNS.sub(" ", low).encode("utf-8", "surrogatepass").translate(_WIDE).decode("utf-8", "surrogatepass").split()
        if not "".join(words).replace(_MARK, "").isalnum():
            words = _WORD_OR_MARK.findall(low)
    if _MARK not in marked:
        return " ".join(words), ()
    cuts, at = [], 0
    for i, w in enumerate(words):
        if w == _MARK:
            if i > at:
                cuts.append(i - at)
            at = i + 1
    if len(words) > at:
        cuts.append(len(words) - at)
    return " ".join([w for w in words if w != _MARK]), tuple(cuts) if len(cuts) > 1 else ()


def flags_of(text: str) -> int:
    """Flags of a line's visible text."""
    out = 0
    last = text.rstrip(_CLOSERS)[-1:] or " "
    if last in ".!?…":
        out |= CLOSED | ENDS
    elif last in ":;," or text[-1:] in ("\"", "”", "»"):
        out |= CLOSED
    if len(text) < 200 and (text[:1] == "#" or ":" in text) and _FILED.match(text):
        out |= FILED
    if text[:1] == "©" or (text[:1] == "#" and len(text) > 1):
        out |= ABOUT
    if not text.isascii() and len(_ODD.findall(text)) > GARBLED_SHARE * len(text):
        out |= GARBLED
    return out


@dataclass(slots=True)
class Page:
    """Lines with visible text."""

    lines: list[Line] = field(default_factory=list)
    html: bool = False
    #: index of the headline's line, -1 if none is known
    head: int = -1


def is_page(mime: str | None, content: str) -> bool:
    """HTML, XHTML and plain text are pages; a null type is judged by its content.

    Of that, documents, images and JSON are no pages.
    """
    if mime is None or not mime.strip():
        head = content.lstrip()[:5].lower()
        return not (head.startswith(("%pdf", "\x89png")) or (head[:1] in ("{", "[") and _is_json(content)))
    m = mime.strip().lower()
    return "html" in m or m.startswith("text/plain")


def _is_json(content: str) -> bool:
    """Whether ``content`` is JSON, or begins as an object with a named value does."""
    if _OBJECT.match(content):
        return True
    try:
        json.loads(content)
    except (ValueError, RecursionError):
        return False
    return True


def is_html(mime: str | None, content: str) -> bool:
    """Whether to read tags."""
    m = (mime or "").lower()
    if "html" in m:
        return True
    return not m.strip() and _HTML.search(content) is not None


def parse(content: str, mime: str | None) -> Page:
    """Lines of a page (``content`` cut at line feeds, numbered from 1)."""
    page = Page(html=is_html(mime, content))
    if not page.html:
        for no, raw in enumerate(content.split("\n"), 1):
            text = squeeze(raw)
            low, cuts = cut(text)
            if low:
                page.lines.append(line := Line(no, low, low, cuts=cuts, flags=flags_of(text)))
                line.label = _label(text)
        return page
    stack: list[tuple[str, str]] = []
    unseen: list[str] = []
    comment = False
    title: list[str] = []
    shown: list[str] = []  # the text of each line as it stands
    in_link = False
    for no, raw in enumerate(content.split("\n"), 1):
        if comment or "<!--" in raw:
            raw, comment = _uncommented(raw, comment)
        if not raw or (unseen and "<" not in raw and unseen[-1] != "title"):
            continue
        element, links = "", 0
        text_parts: list[str] = []
        own_parts: list[str] = []
        path: tuple[str, ...] | None = None
        if not unseen and (simple := _SIMPLE.match(raw)):
            element = simple.group(1).lower()
            in_link = in_link and element == "span"
            tokens = [simple.group(2)]
        else:
            # text, slash, name, attributes, text, ...; behind the last > there is no tag
            end = raw.rfind(">") + 1
            tokens = _TOKEN.split(raw[:end]) if end else [""]
            tokens[-1] += raw[end:]
        for k in range(0, len(tokens), 4):
            if k and (name := tokens[k - 2]) is not None:
                kind = _KIND.get(name)
                if kind is None:
                    name = name.lower()
                    kind = _KIND.get(name, _BLOCK)
                closing = tokens[k - 3] == "/"
                if kind == _HIDES:
                    if closing:
                        if name in unseen:
                            del unseen[unseen.index(name) :]
                    elif not tokens[k - 1].endswith("/") and (name != "head" or not unseen):
                        unseen.append(name)
                elif unseen and name != "body" and unseen[-1] in ("script", "style"):
                    pass
                else:
                    if unseen and name == "body":
                        unseen.clear()
                    if not closing and not element:
                        element = name
                    if kind == _LINK:
                        in_link = not closing
                    elif kind != _FLOWS:
                        in_link = False
                        if text_parts:
                            text_parts.append(_BREAK)
                            own_parts.append(" ")
                        if kind == _HOLDS and not unseen:
                            if closing:
                                for at in range(len(stack) - 1, -1, -1):
                                    if stack[at][0] == name:
                                        del stack[at:]
                                        break
                            elif not tokens[k - 1].endswith("/"):
                                attrs = tokens[k - 1] and " ".join(f"{a.lower()}={v.strip(_QUOTES)}" for a, v in _ATTR.findall(tokens[k - 1]))
                                stack.append((name, f"{name} {attrs}"))
            piece = tokens[k]
            if piece:
                if unseen:
                    if unseen[-1] == "title":
                        title.append(piece)
                elif not piece.isspace():
                    if path is None:
                        path = tuple([x for _, x in stack])
                    text_parts.append(piece)
                    if in_link:
                        links += 1
                    else:
                        own_parts.append(piece)
                elif text_parts:
                    text_parts.append(" ")
                    own_parts.append(" ")
        in_link = in_link and not text_parts  # an unclosed link ends with its line
        if not text_parts:
            continue
        text = squeeze("".join(text_parts))
        low, cuts = cut(text)
        if low:
            line = Line(no, low, low, links, path or (), element)
            if links:
                own = squeeze("".join(own_parts))
                line.own, line.own_cuts = cut(own) if own else ("", ())
            if element not in TABLE:
                line.cuts = cuts
            page.lines.append(line)
            shown.append(text)
    page.head = headline(page, words_of(squeeze("".join(title))))
    # what the punctuation tells is asked of lines in the headline's container only
    main = page.lines[page.head].path if page.head >= 0 else ()
    depth = len(main)
    for line, text in zip(page.lines, shown, strict=True):
        if line.path[:depth] == main:
            if _BREAK in text:
                text = squeeze(text.replace(_BREAK, " "))
            line.flags = flags_of(text)
            if ":" in text:
                line.label = _label(text)
    return page


def _uncommented(raw: str, comment: bool) -> tuple[str, bool]:
    """A line without its comments, and whether one is still open."""
    out, at = [], 0
    while True:
        if comment:
            end = raw.find("-->", at)
            if end < 0:
                return "".join(out), True
            at, comment = end + 3, False
        start = raw.find("<!--", at)
        if start < 0:
            out.append(raw[at:])
            return "".join(out), False
        out.append(raw[at:start])
        at, comment = start + 4, True


def _label(text: str) -> str:
    m = _LABEL.match(text) if ":" in text else None
    return words_of(m.group(1)) if m else ""


def headline(page: Page, title: str) -> int:
    """Index of the line that is the page's headline, -1 if none is known.

    The title begins with it; a heading of the first level comes next.
    """
    for i, line in enumerate(page.lines):
        if title and not line.links and title.startswith(line.text) and line.text.count(" ") > 1:
            return i
    return next((i for i, line in enumerate(page.lines) if line.element == "h1"), -1)
