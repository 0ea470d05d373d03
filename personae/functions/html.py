"""Fields of a fetched profile page, read with Column expressions only."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from personae.functions.text import blank_to_null, js_trim

# text a browser would not treat as markup
_OPAQUE = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
)
_META_TAG = r"""(?is)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ENTITY = r"(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"


@lru_cache(maxsize=1)
def _named_entities() -> str:
    return "\x02".join(f"{name}\x01{text}" for name, text in html5.items())


def _from_code_point(code: Column) -> Column:
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe.cast("long")), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Character references to text; text without ``&`` passes through."""
    named = F.str_to_map(F.lit(_named_entities()), F.lit("\x02"), F.lit("\x01"))

    def decoded(piece: Column) -> Column:
        # leading zeros mean nothing; more digits than any character has are none
        digits = F.regexp_replace(
            F.regexp_replace(piece, "^&#[xX]?|;$", ""), "^0+", ""
        )
        none = F.lit(0x110000).cast("long")
        hexadecimal = F.when(F.length(digits) > 8, none).otherwise(
            F.conv(digits, 16, 10).cast("long")
        )
        decimal = F.when(F.length(digits) > 10, none).otherwise(digits.try_cast("long"))
        return (
            F.when(piece.rlike("^&#[xX]"), _from_code_point(hexadecimal))
            .when(piece.startswith("&#"), _from_code_point(decimal))
            .when(
                piece.startswith("&"),
                F.coalesce(
                    F.try_element_at(named, F.substring(piece, F.lit(2), F.length(piece))), piece
                ),
            )
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(1))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")
                  ).otherwise(c)


def markup(html: Column) -> Column:
    """``html`` without comments, scripts and styles."""
    return F.regexp_replace(html, _OPAQUE, "")


def meta_tags(html_markup: Column) -> Column:
    return F.regexp_extract_all(html_markup, F.lit(_META_TAG), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"'/]{name}{_VALUE}"
    return F.coalesce(
        *[blank_to_null(F.regexp_extract(tag, pattern, g)) for g in (1, 2, 3)], F.lit("")
    )


def meta_content(tags: Column, prop: str) -> Column:
    """``content`` of the first meta tag with that property, NULL if there is none."""
    matching = F.filter(tags, lambda t: _attribute(t, "property") == prop)
    first = F.get(matching, F.lit(0))
    has_content = first.rlike(r"(?is)[\s\"'/]content\s*=")
    return F.when(has_content, decode_entities(_attribute(first, "content")))


def page_title(html_markup: Column) -> Column:
    """Trimmed text of the first <title>, NULL if absent or blank."""
    text = F.regexp_extract(html_markup, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return blank_to_null(js_trim(decode_entities(text)))
