"""Tagging, money, names, links and table rows in text as native column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdata.functions.clean import _c
from regdata.vocab import (
    ASCII_SPELLINGS, CYRILLIC_SPELLINGS, DATED_LINE, GREEK_SPELLINGS, HTML_REFERENCES, JOB_LEVEL, MONEY, MONEY_MILLIONS, PROPER_NOUNS,
)


def dated_line(col) -> Column:
    """True for ``m/d/yy: text`` lines."""
    return _c(col).rlike(DATED_LINE)


def dated_line_parts(col) -> Column:
    """struct(date, text) of a dated line; text ends at a second colon."""
    return F.struct(
        F.split_part(_c(col), F.lit(":"), F.lit(1)).alias("date"),
        F.regexp_replace(F.split_part(_c(col), F.lit(":"), F.lit(2)), r"^\s+", "").alias("text"),
    )


def classify(col, rules, default: str) -> Column:
    """Class of the first rule that has a term inside the text, ignoring case."""
    low, out = F.lower(_c(col)), None
    for name, terms in rules:
        hit = _any_term(low, terms)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def _any_term(low: Column, terms) -> Column:
    hit = F.contains(low, F.lit(terms[0].lower()))
    for term in terms[1:]:
        hit = hit | F.contains(low, F.lit(term.lower()))
    return hit


def keyword_flags(df, col: str, flags: dict[str, list[str]], compat: bool = False):
    """One boolean column per flag: any of its terms occurs in the lower-cased text.

    Terms are lower-cased too. ``compat=True`` leaves them as given, so a term with
    capitals never matches, as in the published tables.
    """
    low = F.lower(F.col(col))
    out = {}
    for name, terms in flags.items():
        if compat:
            terms = [t for t in terms if t == t.lower()]
        out[name] = _any_term(low, terms) if terms else F.lit(False)
    return df.withColumns(out)


def roman_level(col, default: str = "NONE") -> Column:
    """Roman numeral I-VI at the end of a title."""
    level = F.upper(F.regexp_extract(F.lower(_c(col)), JOB_LEVEL, 1))
    return F.when(level == "", default).otherwise(level)


def extract_money(col, compat: bool = False) -> Column:
    """First dollar amount in the text; "million" scales it, null when there is none.

    ``compat=True`` reproduces the published figures, where the amount is scaled only
    if the text up to its first decimal point equals the plain amount.
    """
    digits = lambda x: F.nullif(F.regexp_replace(x, "[$,]", ""), F.lit("")).try_cast("double")
    if compat:
        plain, big = F.regexp_extract(_c(col), MONEY, 0), F.regexp_extract(_c(col), MONEY_MILLIONS, 0)
        scaled = (big != "") & (F.split_part(F.split_part(big, F.lit("."), F.lit(1)), F.lit(" "), F.lit(1)) == plain)
        return F.when(plain == "", None).when(scaled, digits(F.split_part(big, F.lit(" "), F.lit(1))) * 1e6).otherwise(digits(plain))
    # the first amount, with "million" where it follows; texts without a dollar sign are not searched
    found = F.when(F.contains(_c(col), F.lit("$")), F.regexp_extract(_c(col), f"(?:{MONEY_MILLIONS})|(?:{MONEY})", 0))
    millions = found.endswith(" million")
    return digits(F.split_part(found, F.lit(" "), F.lit(1))) * F.when(millions, 1e6).otherwise(1.0)


def proper_nouns(col) -> Column:
    """Runs of capitalised words."""
    runs = F.regexp_extract_all(_c(col), F.lit(PROPER_NOUNS), F.lit(0))
    return F.transform(runs, lambda run: F.regexp_replace(run, r"^\s+", ""))


def parse_list_literal(col) -> Column:
    """``['A', 'B']`` written as text to an upper-cased array."""
    items = F.from_json(F.translate(_c(col), "'", '"'), "array<string>")
    return F.transform(items, F.upper)


def _latin_folding() -> tuple[str, str]:
    """Accented letters up to U+017F whose base is one plain letter, and these letters."""
    source, target = "", ""
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            source, target = source + chr(code), target + base
    return source, target


def fold_ascii(col) -> Column:
    """Latin letters without accents; other characters stay."""
    return F.translate(_c(col), *_latin_folding())


LAST_SPELLED = 0x2600  # code points from here on have no spelling
NO_SPELLING = "\x01"


@functools.cache
def _spellings() -> dict[str, str]:
    """Spelling in ASCII of each character beyond it that has one: a given one, or that of what it decomposes to."""
    known = {**ASCII_SPELLINGS, **GREEK_SPELLINGS, **CYRILLIC_SPELLINGS}
    known |= {c.upper(): s.capitalize() for c, s in [*GREEK_SPELLINGS.items(), *CYRILLIC_SPELLINGS.items()] if len(c.upper()) == 1}
    out = {}
    for c in map(chr, range(0x80, LAST_SPELLED)):
        parts = [p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)]
        if c in known:
            out[c] = known[c]
        elif parts and all(p.isascii() or p in known for p in parts):
            out[c] = "".join(known.get(p, p) for p in parts)
    return out


def transliterate(col) -> Column:
    """Letters of Latin, Greek and Cyrillic, quotes, dashes, spaces, fractions and ligatures spelled in ASCII; the rest stays.

    Texts in ASCII stay as they are. Characters spelled by one character are exchanged first. Only texts with others are
    cut at these, and each looks its spelling up by its number in one array.
    """
    known = _spellings()
    single = {k: v for k, v in known.items() if len(v) == 1}
    out = F.translate(_c(col), "".join(single), "".join(single.values()))
    table = "\x02".join(known.get(chr(i), NO_SPELLING) for i in range(0x80, LAST_SPELLED))
    spelled = F.split(F.lit(table), "\x02")

    def spell(part: Column) -> Column:
        found = F.get(spelled, F.ascii(part) - 0x80)
        return F.when(found.isNull() | (found == NO_SPELLING), part).otherwise(found)

    parts = F.regexp_extract_all(out, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.when(_is_ascii(col), _c(col)).when(out.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(parts, spell), "")).otherwise(out)


def _is_ascii(col) -> Column:
    """Whether each character is one byte."""
    return F.octet_length(_c(col)) == F.char_length(_c(col))


def unspelled(col) -> Column:
    """How many characters have no ASCII spelling and are lost in :func:`to_ascii`."""
    return F.regexp_count(transliterate(col), F.lit(r"[^\x00-\x7F]"))


def to_ascii(col) -> Column:
    """:func:`transliterate`, without the characters that have no spelling (:func:`unspelled` counts them)."""
    return F.when(_is_ascii(col), _c(col)).otherwise(F.regexp_replace(transliterate(col), r"[^\x00-\x7F]", ""))


def decode_references(col) -> Column:
    """Character references of HTML as characters: named ones of the list, and all numbered ones by their code point.

    Texts without an ampersand are left alone, others are cut once; what a reference stands for is not read again.
    """
    names = F.create_map(*[F.lit(x) for pair in HTML_REFERENCES.items() for x in pair])

    def decode(part: Column) -> Column:
        number = F.coalesce(F.conv(F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});?$", 1), 16, 10).try_cast("int"), F.regexp_extract(part, r"^&#([0-9]{1,7});?$", 1).try_cast("int"))
        sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(~part.startswith("&"), part).when(sound, sign).otherwise(F.coalesce(F.try_element_at(names, F.regexp_extract(part, "^&([A-Za-z0-9]+);$", 1)), part))

    parts = F.regexp_extract_all(_c(col), F.lit(r"&#?[A-Za-z0-9]+;?|[^&]+|&"), F.lit(0))
    return F.when(F.contains(_c(col), F.lit("&")), F.array_join(F.transform(parts, decode), "")).otherwise(_c(col))


def links(col) -> Column:
    """All ``href`` targets of a piece of markup: any letter case, double, single or no quotes."""
    found = F.regexp_extract_all(_c(col), F.lit(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda x: decode_references(F.regexp_replace(x, r"""^["']|["']$""", "")))


def path_part(url) -> Column:
    """URL without query and fragment."""
    return F.split_part(F.split_part(_c(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def is_pdf(url) -> Column:
    return F.lower(path_part(url)).endswith(".pdf")


def base_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def join_url(base, href) -> Column:
    """Absolute URL of a link target."""
    return F.when(F.contains(_c(href), F.lit("://")), _c(href)).otherwise(
        F.concat(F.rtrim(_c(base), F.lit("/")), F.lit("/"), F.ltrim(_c(href), F.lit("/")))
    )


def strip_tags(col) -> Column:
    """Text of a piece of markup, without white space around it."""
    return F.trim(decode_references(F.regexp_replace(_c(col), "<[^>]*>", "")))


def facility_label(col) -> Column:
    """Text of a facility cell: no markup, no "(PDF" remark, first line only, nothing up to a link's title."""
    text = decode_references(F.regexp_replace(_c(col), "<[^>]*>", ""))
    first = F.split_part(F.split_part(text, F.lit(" (PDF"), F.lit(1)), F.lit("\n"), F.lit(1))
    return F.substring_index(first, "in new window.'>", -1)


def grouped_number(col) -> Column:
    return F.format_number(_c(col), 0)


def dollar_range(low, high) -> Column:
    """``$200 - 400`` label of a bin."""
    return F.concat(F.lit("$"), grouped_number(low), F.lit(" - "), grouped_number(high))


def title_of_flag(col) -> Column:
    """Display name of a flag column name: the part after the first underscore."""
    return F.initcap(F.trim(F.split_part(_c(col), F.lit("_"), F.lit(2))))
