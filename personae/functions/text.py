"""Text clean-up as Column functions.

All of it runs inside the JVM. Whitespace follows the wide Unicode definition
(NBSP, BOM, ideographic space ...), word boundaries are ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import DEFAULT_DESCRIPTORS, Descriptors

# fixed values: the white space class and the separators trimmed off names
_WS_SET = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{_WS_SET}]"
NON_WS = f"[^{_WS_SET}]"
WS_CHARS = "".join(
    map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
SEPARATORS = ".,;:|/_-–—"

_LOWER = "abcdefghijklmnopqrstuvwxyz"

# fixed values: Extended_Pictographic of the Unicode emoji data, as ranges
EXTENDED_PICTOGRAPHIC = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF "
    "23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 "
    "2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 "
    "274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 "
    "2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F "
    "1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F "
    "1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F "
    "1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F "
    "1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)
EMOJI_MODIFIERS = "1F3FB-1F3FF"


def _code_point_class(ranges: str) -> str:
    parts = []
    for item in ranges.split():
        ends = item.split("-")
        parts.append("-".join(rf"\x{{{e}}}" for e in ends))
    return "".join(parts)


_EMOJI = (
    "[" + _code_point_class(EXTENDED_PICTOGRAPHIC)
    + _code_point_class(EMOJI_MODIFIERS) + r"\p{Mn}]"
)

_WORD = r"(?<![A-Za-z0-9_])"
_WORD_END = r"(?![A-Za-z0-9_])"
# two UTF-16 units must stay in front: two code points or one beyond U+FFFF
_FRONT = r"[\x{10000}-\x{10FFFF}]"


def _suffix_any(words: Descriptors) -> str:
    return rf"(?is)^({_FRONT}|.{{2,}}?)(?:{words.glued})$"


def _suffix_one_word(words: Descriptors) -> str:
    return rf"(?is)^({_FRONT}|{NON_WS}{{2,}}?)(?:{words.glued})$"


def blank_to_null(c: Column) -> Column:
    """'' counts as absent everywhere in the engine."""
    return F.nullif(c, F.lit(""))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_whitespace(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, WS + "+", " "), F.lit(" "))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def strip_bio_tags(c: Column) -> Column:
    """``Name | tag | tag`` -> ``Name ``."""
    return F.substring_index(c, "|", 1)


# --- compatibility folding -----------------------------------------------------


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, str]:
    """Tables for ``fold_unicode``, derived from the Unicode database.

    Returns (from, to) for ``translate``, the characters whose folding is longer
    than one character, and those foldings as ``char\\x01folding`` pairs joined
    by \\x02. Hangul syllables follow an arithmetic rule and are in no table.
    """
    single_from, single_to, deleted, multi = [], [], [], []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        folded = "".join(
            x for x in unicodedata.normalize("NFKD", ch)
            if not 0x300 <= ord(x) <= 0x36F
        )
        if folded == ch:
            continue
        if len(folded) == 0:
            deleted.append(ch)
        elif len(folded) == 1:
            single_from.append(ch)
            single_to.append(folded)
        else:
            multi.append((ch, folded))
    return (
        "".join(single_from + deleted),
        "".join(single_to),
        "".join(ch for ch, _ in multi),
        "\x02".join(f"{ch}\x01{folded}" for ch, folded in multi),
    )


def _utf16_char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _hangul_jamo(ch: Column) -> Column:
    """Leading consonant, vowel and optional trailing consonant of a syllable."""
    s = F.ascii(ch) - 0xAC00
    lead = _utf16_char((F.floor(s / 588) + 0x1100).cast("long"))
    vowel = _utf16_char((F.floor((s % 588) / 28) + 0x1161).cast("long"))
    tail = _utf16_char((s % 28 + 0x11A7).cast("long"))
    return F.concat(lead, vowel, F.when(s % 28 == 0, "").otherwise(tail))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold_unicode(c: Column) -> Column:
    """NFKD without the marks U+0300-036F: fancy fonts and accents to base letters."""
    source, target, long_chars, long_map = _folding()
    folds = F.str_to_map(F.lit(long_map), F.lit("\x02"), F.lit("\x01"))
    spread = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                ch.between("가", "힣"), _hangul_jamo(ch)
            ).otherwise(F.coalesce(F.try_element_at(folds, ch), ch)),
        ),
        "",
    )
    rare = F.translate(c, long_chars, "") != c
    rare = rare | c.rlike(r"[가-힣]")
    return (
        F.when(is_ascii(c), c)
        .when(rare, F.translate(spread, source, target))
        .otherwise(F.translate(c, source, target))
    )


def strip_emoji(c: Column) -> Column:
    """Pictographs, skin tones and leftover marks become a space."""
    return F.regexp_replace(c, _EMOJI, " ")


# --- punctuation and descriptors -----------------------------------------------


def collapse_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"([.,;:|/_\-–—])\1+", "$1")


def strip_descriptors(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    return F.regexp_replace(c, words.anywhere, "")


def strip_of_count(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i){_WORD}of{WS}+[0-9]+{_WORD_END}", "")


def trim_separators(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS + SEPARATORS))


def strip_descriptor_suffix(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    """Drop a descriptor glued to the end (``janepilates`` -> ``jane``)."""
    return F.when(_may_end_in(c, words), F.regexp_replace(c, _suffix_any(words), "$1")).otherwise(c)


def _may_end_in(c: Column, words: Descriptors) -> Column:
    """Whether a glued descriptor can be at the end: the patterns try one at every character.

    Their ``$`` also holds before a line break at the end.
    """
    glued = words.glued.split("|")
    n = min(map(len, glued))
    end = F.right(F.rtrim(c, F.lit("\n\r\u0085\u2028\u2029")), F.lit(n))
    return F.lower(end).isin(sorted({w[-n:] for w in glued}))


def is_descriptor_word(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    return F.lower(c).isin(words.exact)


def contains_descriptor(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    return c.rlike(words.anywhere)


def _first_raised(word: Column) -> Column:
    return F.concat(
        F.translate(F.left(word, F.lit(1)), _LOWER, _LOWER.upper()),
        F.substring(word, 2, 2**31 - 1),
    )


def title_case_if_shouty(c: Column) -> Column:
    """Title-case text whose ASCII letters are all upper or all lower case."""
    lowered, gap = F.lower(c), f"(?:{WS}|['-])"
    raised = F.array_join(F.transform(F.split(lowered, f"(?<={gap})"), _first_raised), "")
    # most names are one word: nothing to split, which compiles its pattern for each row
    raised = F.when(lowered.rlike(gap), raised).otherwise(_first_raised(lowered))
    return F.when(c.rlike("[a-z]") != c.rlike("[A-Z]"), raised).otherwise(c)


def _bare(c: Column, words: Descriptors) -> Column:
    """Everything of ``strip_decoration`` except the descriptor glued to the end."""
    name = strip_bio_tags(c)
    # neither folding nor pictographs concern plain ASCII
    c = F.when(is_ascii(name), name).otherwise(strip_emoji(fold_unicode(name)))
    c = collapse_whitespace(collapse_punctuation(c))
    c = strip_of_count(strip_descriptors(c, words))
    return collapse_whitespace(trim_separators(c))


def _without_glued(c: Column, words: Descriptors) -> Column:
    return F.when(
        _may_end_in(c, words), F.regexp_replace(c, _suffix_one_word(words), "$1")
    ).otherwise(c)


def strip_decoration(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    """Everything of ``clean_name`` except the final casing."""
    return _without_glued(_bare(c, words), words)


def clean_name(c: Column, words: Descriptors = DEFAULT_DESCRIPTORS) -> Column:
    """A name-like string reduced to the name, '' if nothing is left."""
    return title_case_if_shouty(strip_decoration(c, words))


def with_clean_names(
    df: DataFrame, names: dict[str, str], words: Descriptors = DEFAULT_DESCRIPTORS
) -> DataFrame:
    """Add ``clean_name`` of {new column: source column}, NULL if nothing is left.

    Same result as the Column function, but what is used more than once is computed once
    in a projection of its own.
    """
    bare = {f"_s_{out}": _bare(F.col(src), words) for out, src in names.items()}
    stripped = {c: _without_glued(F.col(c), words) for c in bare}
    cased = {
        out: blank_to_null(title_case_if_shouty(F.col(f"_s_{out}"))) for out in names
    }
    return df.withColumns(bare).withColumns(stripped).withColumns(cased).drop(*bare)


# --- tokens ----------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Split on ``. _ -``, strip digits at token ends, drop empty tokens."""
    # a pattern to split at is compiled anew for each row, unless it is one character
    parts = F.transform(
        F.split(F.translate(c, "_-", ".."), r"\."),
        lambda t: F.regexp_replace(t, "^[0-9]+|[0-9]+$", ""),
    )
    return F.filter(parts, lambda t: t != "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, WS + "+", " "), " "), lambda t: t != "")


def first_of(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def last_of(arr: Column) -> Column:
    """Last element of an array with two or more elements, else NULL."""
    return F.when(F.size(arr) >= 2, F.element_at(arr, -1))


def middle_of(arr: Column) -> Column:
    """Elements strictly between first and last, NULL if there are none."""
    return F.when(F.size(arr) > 2, F.slice(arr, 2, F.greatest(F.size(arr) - 2, F.lit(0))))


# --- headers, field names, dates ---------------------------------------------------


def normalize_header(c: Column) -> Column:
    c = F.regexp_replace(js_trim(F.lower(c)), "[_-]+", " ")
    return F.regexp_replace(c, WS + "+", " ")


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([A-Z])", "_$1"))


def format_epoch_ms(c: Column, time_zone: str = "UTC",
                    pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    at = F.convert_timezone(
        F.lit("UTC"), F.lit(time_zone), F.timestamp_millis(c).cast("timestamp_ntz")
    )
    return F.date_format(at, pattern)
