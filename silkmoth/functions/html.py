"""Text and links of HTML as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silkmoth.functions.binding import let

#: Character references that occur in running text (fixed values).
REFERENCES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·",
    "&laquo;": "«", "&raquo;": "»", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&hellip;": "…", "&euro;": "€", "&pound;": "£",
    "&agrave;": "à", "&aacute;": "á", "&acirc;": "â", "&atilde;": "ã", "&auml;": "ä", "&aring;": "å", "&ccedil;": "ç", "&egrave;": "è",
    "&eacute;": "é", "&ecirc;": "ê", "&euml;": "ë", "&igrave;": "ì", "&iacute;": "í", "&icirc;": "î", "&iuml;": "ï", "&ntilde;": "ñ",
    "&ograve;": "ò", "&oacute;": "ó", "&ocirc;": "ô", "&otilde;": "õ", "&ouml;": "ö", "&oslash;": "ø", "&ugrave;": "ù", "&uacute;": "ú",
    "&ucirc;": "û", "&uuml;": "ü", "&szlig;": "ß", "&Eacute;": "É", "&Agrave;": "À", "&Ccedil;": "Ç", "&Ouml;": "Ö", "&Uuml;": "Ü", "&Auml;": "Ä",
    "&amp;": "&",
}
#: Elements that do not break text (fixed values).
INLINE = "a|abbr|b|em|font|i|mark|small|span|strong|sub|sup|u"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(text: Column, pattern: str, closing: str, by: str = "") -> Column:
    """``text`` with matches of ``pattern`` replaced, each of which ends with ``closing`` (lower case).

    Behind the last closing mark there is no match; looking no further keeps the time linear where marks are left open.
    """

    def cut(t: Column) -> Column:
        rest = F.length(F.substring_index(F.translate(t, _UPPER, _LOWER), closing, -1))
        return let(rest, lambda n: F.concat(F.regexp_replace(F.left(t, F.length(t) - n), pattern, by), F.right(t, n)))

    return let(text, cut)


def _element(text: Column, name: str) -> Column:
    """``text`` without the elements ``name``.

    Closing tags are written alike first, so that the last of them is found.
    """
    alike = F.regexp_replace(text, rf"(?i)</{name}\s*>", f"</{name}>")
    return _without(alike, rf"(?is)<{name}\b.*?</{name}>", f"</{name}>")


def resolved(text: Column) -> Column:
    """``text`` with the references of :data:`REFERENCES` resolved, each once, in one pass."""
    known = F.create_map(*[F.lit(x) for name, char in REFERENCES.items() for x in (name[1:-1], char)])
    pieces = F.split(text, "&", -1)

    def one(x: Column, i: Column) -> Column:
        name = F.substring_index(x, ";", 1)
        char = F.when(F.contains(x, F.lit(";")), F.element_at(known, name))
        return F.when(i == 0, x).otherwise(let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(c, F.substr(x, F.length(name) + 2)))))

    return F.array_join(F.transform(pieces, one), "")


def body_text(content: Column) -> Column:
    """Visible text of a page's body: blanks squeezed, block elements break words.

    Null stays null; text without tags only has its blanks squeezed. An element
    that is not closed is no element.
    """
    out = _without(content, r"(?s)<!--.*?-->", "-->")
    for name in ("head", "script", "style"):
        out = _element(out, name)
    out = _without(out, rf"(?is)</?(?:{INLINE})(?:\s[^>]*)?>", ">")
    out = _without(out, r"(?s)<[^>]*>", ">", " ")
    return F.trim(F.regexp_replace(resolved(out), r"[ \t\r\n\f]+", " "))


def title_text(content: Column) -> Column:
    """Text of the title element, empty without one."""
    return F.trim(F.regexp_extract(content, r"(?is)<title[^>]*>(.*?)</title", 1))


def hrefs(content: Column) -> Column:
    """Values of ``href`` of all anchors in page order, references to ``&`` resolved."""
    visible = _element(_without(content, r"(?s)<!--.*?-->", "-->"), "script")
    raw = F.regexp_extract_all(visible, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))
    return F.transform(raw, lambda x: F.replace(F.regexp_replace(x, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def without_controls(text: Column) -> Column:
    """``text`` without control, format, private and unassigned characters; line breaks go too."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}]", "")


def snippet(body: Column, most: int = 70) -> Column:
    """The first ``most`` characters with three dots, which shorter bodies have too."""
    return F.concat(F.substring(body, 1, most), F.lit("..."))
