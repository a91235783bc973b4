"""Text cleaning and string scalars as built-in column expressions.

Whitespace and word classes are spelled out with Unicode categories, so that
the JVM and SQL engines with other regex dialects agree on them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import constants as K

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"\p{L}\p{N}_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for an expression that reads it several times."""
    return F.get(F.transform(F.array(value), body), 0)


def hashed_lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    """Lookup function over a literal table.

    Map lookups scan their keys, so larger tables are split into small maps
    addressed by a checksum of the key.
    """
    slots = max(1, len(table) // 8)
    parts: list[list[Column]] = [[] for _ in range(slots)]
    for key, value in table.items():
        parts[zlib.crc32(key.encode()) % slots] += [F.lit(key), F.lit(value)]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    maps = F.array(*[F.create_map(*p) if p else empty for p in parts])
    return lambda w: F.try_element_at(F.element_at(maps, (F.crc32(w) % slots + 1).cast("int")), w)


def longest_of(words: list[str], between: str = "") -> str:
    """A pattern of the longest of the given strings at a place.

    It is the tree of their characters, so a place is given up at the first
    character that begins no string, however many strings there are.
    ``between`` may follow any character.
    """
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(ch) + between + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return ""
        ends = "" in node
        return "(?:" + "|".join(branches) + (")?" if ends else ")") if ends or len(branches) > 1 else branches[0]

    return pattern(tree)


def replace_each(text: Column, pattern: str, label: Callable[[Column], Column]) -> Column:
    """Each match replaced by what ``label`` makes of it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), label)
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    # single blanks, the common case, are no match
    return F.trim(F.regexp_replace(_col(c), f"{WS}{{2,}}|[{WS[1:-1]}&&[^ ]]", " "))


def strip_ws(c: Column | str) -> Column:
    """Trim any Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def clean_text(c: Column | str) -> Column:
    """Lower case; tags, links and punctuation become blanks; NULL gives ''."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = F.regexp_replace(t, r"<[^\n]*?>", " ")
    t = F.regexp_replace(t, f"http{NOT_WS}+|www{NOT_WS}+", " ")
    t = F.regexp_replace(t, rf"[^{WORD}\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]", " ")
    return squeeze(t)


def light_clean(c: Column | str) -> Column:
    """Drop tags and links, squeeze blanks, keep case and punctuation."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", " ")
    t = F.regexp_replace(t, rf"https?://{NOT_WS}+|www\.{NOT_WS}+", " ")
    return squeeze(t)


def full_text(title: Column | str, content: Column | str) -> Column:
    """Title and content joined by '. ', without dots and blanks at the ends."""
    joined = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(". "), F.coalesce(_col(content), F.lit("")))
    return F.btrim(joined, F.lit(". "))


def is_noise(c: Column | str) -> Column:
    """Too short, only marks, one character repeated, or only digits."""
    t = strip_ws(c)
    return (
        (F.length(t) < 4)
        | t.rlike(r"^[.\s!?*\-_👍❤\x{FE0F}✅⭐🌟💯]{0,5}$")
        | t.rlike(r"^(.)\1{5,}$")
        | t.rlike(r"^\p{Nd}+$")
    )


@functools.cache
def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letter, from Unicode itself."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source) + "đ", "".join(target) + "d"


def fold_accents(c: Column | str) -> Column:
    """Lower, strip accents, keep only ``[a-z0-9#]`` and single blanks."""
    source, target = _accent_pairs()
    t = F.translate(F.lower(_col(c)), source, target)
    t = F.regexp_replace(t, r"\p{Mn}+", "")
    t = F.regexp_replace(t, r"[^a-z0-9#\s\x0B\x1C-\x1F\x{85}\p{Z}]+", " ")
    return squeeze(t)


def sentences(c: Column | str) -> Column:
    """Array of trimmed, non-empty sentences."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"[\n.!?;]+"), strip_ws)
    return F.filter(parts, lambda s: F.length(s) > 0)


def tokens(c: Column | str) -> Column:
    """Lower-case tokens with punctuation split off; nothing left gives <unk>."""
    t = F.regexp_replace(F.lower(_col(c)), r"([,.!?;:()\[\]{}\"'])", " $1 ")
    return let(F.array_remove(F.split(t, WS + "+"), ""), lambda words: F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("<unk>"))))


def words(c: Column | str) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(_col(c), WS + "+"), "")


# --- web pages ---------------------------------------------------------------

# fixed values: the usual named references; all others come from the standard library's table
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "bull": "•",
    "euro": "€", "pound": "£", "deg": "°", "times": "×", "amp": "&",
}


REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape_html(c: Column | str) -> Column:
    """Named, decimal and hexadecimal character references as their characters; unknown ones stay."""
    t = _col(c)
    named = {k.removesuffix(";"): v for k, v in html5.items() if k.endswith(";")} | ENTITIES
    find = hashed_lookup(named)

    def character(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(ref: Column) -> Column:
        name = F.regexp_extract(ref, REFERENCE, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("bigint")
        return F.coalesce(F.when(F.startswith(name, F.lit("#")), character(number)).otherwise(find(name)), ref)

    return F.when(F.contains(t, F.lit("&")), replace_each(t, REFERENCE, decoded)).otherwise(t)


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page: text nodes trimmed and joined by one blank."""
    t = F.coalesce(_col(c), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style|template)\b.*?</\1\s*>", "\u0001")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "\u0001")
    # quoted attribute values may hold '>'; a tag with a stray quote ends at the first one
    t = F.regexp_replace(t, r"""<[/!?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "\u0001")
    t = F.regexp_replace(t, r"(?s)<[/!?a-zA-Z][^>]*>", "\u0001")
    t = unescape_html(t)
    nodes = F.filter(F.transform(F.split(t, "\u0001"), strip_ws), lambda n: F.length(n) > 0)
    return F.array_join(nodes, " ")


def product_id_from_url(c: Column | str) -> Column:
    """``-p<digits>.html``, else a query key, else the first digits of the path."""
    url = _col(c)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def key(name: str) -> Column:
        raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
        return F.nullif(F.try_url_decode(raw), F.lit(""))

    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"-p(\d+)\.html", 1), F.lit("")),
        key("spid"),
        key("product_id"),
        key("id"),
        F.nullif(F.regexp_extract(path, r"(\d+)", 1), F.lit("")),
    )


def product_name_from_url(c: Column | str, host: str = K.SHOP_HOST_PATTERN, end: str = r"-p\d+") -> Column:
    """Words of the URL slug, each with an upper-case first letter."""
    slug = F.regexp_extract(F.coalesce(_col(c), F.lit("")), rf"{host}/(.+?){end}", 1)
    named = F.transform(
        F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return squeeze(F.array_join(named, " "))


# --- normalisation -----------------------------------------------------------


def normalize_units(c: Column | str, legacy: bool = False) -> Column:
    """Write '3tháng', '2t', '5kg', '10ml', '5 star' the long way.

    The year rule needs a word end after 't', or '3 tháng' is damaged;
    ``legacy=True`` leaves it out to reproduce that.
    """
    end = "" if legacy else rf"(?![{WORD}])"
    t = F.regexp_replace(_col(c), rf"(\p{{Nd}}+){WS}*tháng", "$1 tháng")
    t = F.regexp_replace(t, rf"(\p{{Nd}}+){WS}*(?:tuổi|t{end})", "$1 tuổi")
    t = F.regexp_replace(t, rf"(\p{{Nd}}+){WS}*(kg|gram|g)(?![{WORD}])", "$1 $2")
    t = F.regexp_replace(t, rf"(\p{{Nd}}+){WS}*(ml|l)(?![{WORD}])", "$1 $2")
    return F.regexp_replace(t, rf"(\p{{Nd}}+){WS}*(?:sao|star|⭐)", "$1 sao")


def squash_repeats(c: Column | str) -> Column:
    """Three or more of the same letter become two."""
    return F.regexp_replace(_col(c), r"([\p{L}\p{M}\p{N}_])\1{2,}", "$1$1")


def drop_phrases(c: Column | str, phrases: list[str]) -> Column:
    """Remove boilerplate phrases that stand on word bounds."""
    body = "|".join(phrases)
    return F.regexp_replace(_col(c), rf"(?<![{WORD}\p{{M}}])(?:{body})(?![{WORD}\p{{M}}])", " ")


def keep_letters(c: Column | str) -> Column:
    """Only letters, digits and single blanks."""
    return squeeze(F.regexp_replace(_col(c), r"[^\p{L}\p{N}\s\x0B\x1C-\x1F\x{85}\p{Z}]", " "))


# --- evidence text -----------------------------------------------------------


def _cut_at_blank(t: Column, limit: int) -> Column:
    head = F.substring(t, 1, limit)
    return F.trim(F.regexp_replace(head, r"(?s) [^ ]*$", ""))


def compress(c: Column | str, limit: int = 180) -> Column:
    """At most ``limit`` characters, cut at the last blank."""
    return let(squeeze(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(_cut_at_blank(t, limit)))


def compress_evidence(c: Column | str, limit: int = 180) -> Column:
    """Keep short texts; else cut at a clause end past 80, else at a blank."""
    def cut(t: Column) -> Column:
        out = F.when(F.length(t) <= limit, t)
        for marker in (". ", "; ", ", "):
            at = F.locate(marker, t, 81) - 1
            out = out.when((at > 0) & (at <= limit), F.trim(F.substring(t, F.lit(1), at)))
        return out.otherwise(_cut_at_blank(t, limit))

    return let(squeeze(c), cut)


CODE_PATTERN = rf"(?<![{WORD}])(PRODUCT|PRICE|DELIVERY|SELLER)#[A-Z_]+(?![{WORD}])"
RISK_NAME_PATTERN = rf"(?i)(?<![{WORD}])(delivery_accuracy|delivery_packaging|size_fit)(?![{WORD}])"


def summarize_opinion(c: Column | str, limit: int = 150) -> Column:
    """Compressed evidence without internal codes."""
    scrub = lambda t: squeeze(F.regexp_replace(F.regexp_replace(t, CODE_PATTERN, ""), RISK_NAME_PATTERN, ""))

    def coded(t: Column) -> Column:
        # a plain search first, as few texts hold a code or an internal name
        hit = F.lit(False)
        for mark in ("PRODUCT#", "PRICE#", "DELIVERY#", "SELLER#"):
            hit = hit | F.contains(t, F.lit(mark))
        return hit | F.contains(t, F.lit("_"))

    return let(compress_evidence(c, limit), lambda t: F.when(coded(t), scrub(t)).otherwise(t))


def public_text(c: Column | str) -> Column:
    """Text fit to show: no think blocks, codes or internal names."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, CODE_PATTERN, "")
    t = F.regexp_replace(t, RISK_NAME_PATTERN, "")
    return squeeze(F.regexp_replace(t, r"(?i)</?think>", ""))


def evidence_key(c: Column | str) -> Column:
    """Key under which two evidence texts count as the same."""
    return F.trim(F.regexp_replace(F.lower(summarize_opinion(c, 120)), rf"[^{WORD}]+", " "))


def text_key(c: Column | str) -> Column:
    """sha1 of the squeezed lower-case text."""
    return F.sha1(squeeze(F.lower(_col(c))))


def point_id(product: Column, review: Column, aspect: Column, sentiment: Column, text: Column) -> Column:
    """Deterministic id of an opinion chunk: the first 64 bits of a sha1."""
    raw = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (product, review, aspect, sentiment, text)))
    return F.conv(F.substring(F.sha1(raw), 1, 16), 16, 10).cast("decimal(20,0)")


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any of a fixed, short list of strings occurs."""
    return text.rlike(longest_of(needles))


def keyword_match(aspect: Column, lowered: Column, required: dict[str, list[str]],
                  forbidden: dict[str, list[str]] | None = None) -> Column:
    """A required keyword of the aspect occurs, and no forbidden one.

    Aspects without a list need their own name after '#'.
    """
    name = F.lower(F.element_at(F.split(aspect, "#"), -1))
    hit = None
    for code, needles in required.items():
        ok = contains_any(lowered, needles)
        if forbidden and code in forbidden:
            ok = ok & ~contains_any(lowered, forbidden[code])
        hit = F.when(aspect == code, ok) if hit is None else hit.when(aspect == code, ok)
    return hit.otherwise(F.contains(lowered, name))
