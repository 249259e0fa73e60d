"""HTML as an array of tokens: one expression cuts a page, the others look at tokens of a kind.

Tokens follow the rules of a tolerant parser: comments, declarations and processing instructions hold no elements; a script's or
style's content ends at its end tag only; attribute values may be quoted and hold a '>'; a '<' that begins nothing is text; references to characters are
resolved in text and values, and not in scripts and styles. What never ends - a comment, a tag, a script - is left out to the page's end, or, where another '>' follows a comment's beginning, to that.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*"
_VALUE = r"""(?>'[^']*'|"[^"]*"|[^\s>'"][^\s>]*|)"""
_ATTR = rf"(?>[^\s/>=][^\s/>=]*+(?:\s*+=++\s*+{_VALUE})?)"
_TAG = rf"<{_NAME}(?>[\s/]*+{_ATTR})*+[\s/]*+>"
_RAW = "script|style"
_TOKEN = "|".join(
    [
        r"<!--(?>.*?--\s*>|[^>]*+>|.*+)",
        rf"(?>(?i:<(?={_RAW})(?:{_RAW})(?=[\s/>]))(?>[\s/]*+{_ATTR})*+[\s/]*+(?<!/)>)(?>.*?(?=</(?i:{_RAW})\s*>)|.*+)",
        _TAG,
        r"</[a-zA-Z](?>[^>]*+>|.*+)",
        r"<[/!?](?>[^>]*+>|.*+)",
        rf"<{_NAME}.*+",
        r"(?>[^<]++|<(?![a-zA-Z/!?]))++",
    ]
)
_OPEN = rf"(?s)^{_TAG}"


def tokens(page: Column) -> Column:
    """All tokens of a page, in order: text, tags (a script or style with its content), comments and the like."""
    return F.regexp_extract_all(page, F.lit(f"(?s){_TOKEN}"), 0)


def start_tags(toks: Column) -> Column:
    """The start tags among tokens, without the content of scripts and styles."""
    return F.transform(F.filter(toks, lambda t: t.rlike(_OPEN)), lambda t: F.regexp_extract(t, _OPEN, 0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, rf"^<({_NAME})", 1))


def attribute(tag: Column, name: str) -> Column:
    """The value of a start tag's first attribute of that name, references resolved; '' for one without a value, null if there is none."""
    own = rf"(?s)^<{_NAME}(?>[\s/]*+(?!(?i:{name})(?=[\s/>=])){_ATTR})*+[\s/]*+(?i:{name})(?=[\s/>=])"
    value = rf"{own}(?>\s*+=++\s*+(?>'([^']*)'|\"([^\"]*)\"|([^\s>'\"][^\s>]*)|))?"
    found = F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(own), unescape(found))


def texts(toks: Column, raw: bool = True) -> Column:
    """The text nodes among tokens, references resolved; raw: with the content of scripts and styles, as it stands."""
    kind = rf"(?is)^<(?:{_RAW})(?=[\s/>])"
    nodes = F.filter(toks, lambda t: ~t.rlike("^<[a-zA-Z/!?]") | (t.rlike(kind) & F.lit(raw)))
    content = F.transform(nodes, lambda t: F.when(t.rlike(kind), F.regexp_replace(t, _OPEN, "")).otherwise(unescape(t)))
    return F.filter(content, lambda t: t != "")


# ---- references to characters --------------------------------------------------------------------------------

#: Names, by a digest of one length, with what they stand for; those met most often first: a map is looked through from its beginning.
_FIRST = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")
_NAMED = {hashlib.md5(f"&{n}".encode()).hexdigest(): html.entities.html5[n] for n in (*_FIRST, *html.entities.html5)}
#: Names that need no semicolon, longest first.
_LOOSE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers of control characters and the like stand for: the standard library's own rule, asked number by number.
_NUMBERS = {str(i): html.unescape(f"&#{i};") for i in (*range(0xA0), 0xB, *range(0xFDD0, 0xFDF0), *[p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF)]) if html.unescape(f"&#{i};") != chr(i)}
_PIECE = r"&#[0-9]{1,7}(?![0-9]);?|&#[xX][0-9a-fA-F]{1,6}(?![0-9a-fA-F]);?|&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def unescape(c: Column) -> Column:
    """Text with its references to characters resolved."""
    named, numbers = _table(_NAMED), _table(_NUMBERS)
    loose = rf"^&({'|'.join(_LOOSE)})"

    def number(p: Column) -> Column:
        hexadecimal = p.rlike("^&#[xX]")
        digits = F.when(hexadecimal, F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+)", 1)).otherwise(F.regexp_extract(p, "^&#([0-9]+)", 1))
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        bad = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(~bad, F.try_element_at(numbers, code.cast("string"))), char)

    def name(p: Column) -> Column:
        begin = F.regexp_extract(p, loose, 0)
        known = lambda x: F.try_element_at(named, F.md5(F.encode(x, "UTF-8")))
        return F.coalesce(known(p), F.when(begin != "", F.concat(known(begin), F.substr(p, F.length(begin) + 1))), p)

    one = lambda p: F.when(~p.startswith("&"), p).when(p.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), number(p)).otherwise(name(p))
    pieces = F.regexp_extract_all(c, F.lit(_PIECE), 0)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)
