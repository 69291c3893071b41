"""Column functions over text, ratings and semi-structured strings."""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rating scale, best first.
RATINGS = ("Buy", "Overweight", "Hold", "Underweight", "Sell")
#: Placeholders of identity fields and of numbers.
PLACEHOLDERS = ("none", "n/a", "nan", "null")
NULLISH = ("", "none", "n/a", "na", "null", "nil", "-", "tbd", "unknown")
#: What rate limits and missing keys are told by.
LIMIT_PHRASES = ("rate limit", "requests per day", "call frequency", "premium")
KEY_PHRASES = ("api key", "apikey")


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Named references, with and without a semicolon, as the standard library lists them.
_NAMED = {n: c for n, c in html.entities.html5.items()}
#: Those that need none, the longest first: they are read even where letters follow.
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers that stand for the characters of an old code page.
_CODE_PAGE = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}


def _map(values: dict) -> Column:
    """A constant map; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,string>")


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number; one that is too long is out of range as well."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) > 8, F.lit(0x110000)).otherwise(F.conv(short, base, 10).cast("long"))
    page = F.try_element_at(_map(_CODE_PAGE), n.cast("string"))
    out_of_range = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    empty = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(page, F.when(out_of_range, "\ufffd").when(empty, "").otherwise(char))


def unescape(text: Column, ended: bool = False) -> Column:
    """Character references decoded, all named and numbered ones, as the standard library does: a name without its semicolon by its longest known start.

    ended: only those that end with a semicolon, as markup that is well formed has them; others stay as they are.
    Only texts with an ampersand are looked into, and all of it stays in the JVM.
    """
    names, bare = _map(_NAMED), "^(" + "|".join(_BARE) + ")"

    def decoded(part: Column, i: Column) -> Column:
        ref = F.regexp_extract(part, _REFERENCE, 1)
        rest = F.substr(part, F.length(ref) + 1)
        start = F.regexp_extract(ref, bare, 1)
        digits = lambda pattern: F.regexp_extract(ref, pattern, 1)
        known = F.try_element_at(names, ref)
        named = known if ended else F.coalesce(known, F.when(start != "", F.concat(F.try_element_at(names, start), F.substr(ref, F.length(start) + 1))))
        char = F.when(ref.rlike("^#[xX]"), _numbered(digits("^#[xX]([0-9a-fA-F]+)"), 16)).when(ref.startswith("#"), _numbered(digits("^#([0-9]+)"), 10)).when(ref != "", named)
        char = F.when(ref.endswith(";"), char) if ended else char
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part)))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), decoded), "")).otherwise(text)


def strip_markup(content: Column, ended: bool = False) -> Column:
    """Text of an HTML fragment: what stands between the feed's markers if both are there, without tags, references decoded (ended: see :func:`unescape`), white space squeezed."""
    begin, end = "<!-- SC_OFF -->", "<!-- SC_ON -->"
    inner = F.split_part(F.split_part(content, F.lit(begin), F.lit(2)), F.lit(end), F.lit(1))
    text = F.when(content.contains(begin) & content.contains(end), inner).otherwise(content)
    return F.coalesce(squeeze(unescape(F.regexp_replace(text, r"<[^>]+>", " "), ended)), F.lit(""))


def truncate(text: Column, longest: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def clean_identity(value: Column) -> Column:
    """Trimmed; null if blank or a placeholder."""
    v = F.trim(value)
    return F.when((v != "") & ~F.lower(v).isin(*PLACEHOLDERS), v)


def optional_number(value: Column) -> Column:
    """A number as text; null for placeholders and what is no number."""
    return F.when(~F.lower(F.trim(value)).isin(*NULLISH), F.trim(value).try_cast("double"))


def identity(long_name: Column, short_name: Column) -> Column:
    return F.coalesce(clean_identity(long_name), clean_identity(short_name))


def _labelled_word(line: Column) -> Column:
    """In a line in lower case: the word after the label and a colon or dash, stars and blanks passed over; a mark that no word follows is passed over, too."""
    after = F.split(F.get(F.split(line, "rating", 2), F.lit(1)), "[:-]")
    heads = F.transform(F.slice(after, 2, 1 << 20), lambda x: F.regexp_extract(F.regexp_replace(x, r"^[\s*]+", ""), r"(?U)^\w+", 0))
    return F.try_element_at(F.filter(heads, lambda x: x != ""), F.lit(1))


def parse_rating(text: Column, default: str = "Hold") -> Column:
    """The rating of a decision: that of the first line with a label and a rating, else the first rating word, else the default."""
    scale = F.array(*(F.lit(r.lower()) for r in RATINGS))
    lines = F.split(F.lower(text), r"\r\n|\n|\r")
    labelled = F.filter(F.transform(lines, _labelled_word), lambda x: F.array_contains(scale, x))
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.regexp_replace(x, r"^[*:.,]+|[*:.,]+$", ""))
    words = F.filter(words, lambda x: F.array_contains(scale, x))
    return F.coalesce(F.initcap(F.try_element_at(labelled, F.lit(1))), F.initcap(F.try_element_at(words, F.lit(1))), F.lit(default))


def json_strings(value: Column) -> Column:
    """A JSON array kept as a string; empty if null or broken."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def first_probability(prices: Column) -> Column:
    """The first outcome's price as a number; null if there is none or it is no number."""
    return F.try_element_at(prices, F.lit(1)).try_cast("double")


def signed_percent(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%+.1f%%", value * 100))


def signed_number(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%+.{places}f", value)


def thousands(value: Column) -> Column:
    """A whole number (half to even) with commas."""
    return F.format_string("%,d", F.bround(value, 0).cast("long"))


def whole_percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def points(change: Column) -> Column:
    """A change of a share in percentage points; none of 0 or null."""
    return F.when(change != 0, F.format_string("%+.1fpp", change * 100))


def human_count(n: Column) -> Column:
    """Thousands with one place, half to even."""
    return F.when(n >= 1000, F.format_string("%.1fk", F.bround(n / 1000, 1))).otherwise(n.cast("string"))


def show(value: Column, kind: str) -> Column:
    """A value for people: date ISO, double with two places, anything else as text; null is N/A."""
    text = F.date_format(value, "yyyy-MM-dd") if kind in ("date", "timestamp", "timestamp_ntz") else F.format_string("%.2f", value) if kind in ("double", "float") else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("N/A"))


def content_text(content: Column, joint: str = "\n") -> Column:
    """A message's text: the content itself, or of a JSON array the strings and the texts of blocks of type text, joined; other blocks are left out."""
    block = lambda b: F.when(b.startswith("{"), F.when(F.get_json_object(b, "$.type") == "text", F.get_json_object(b, "$.text"))).otherwise(b)
    texts = F.filter(F.transform(F.from_json(content, "array<string>"), block), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(F.array_join(texts, joint), content)).otherwise(content)


def classify_notice(message: Column) -> Column:
    """What a vendor's notice means. Rate limits are looked for before keys, since notices about limits name the key, too."""
    m = F.lower(message)
    some = lambda phrases: F.exists(F.array(*(F.lit(x) for x in phrases)), lambda x: F.contains(m, x))
    return F.when(some(LIMIT_PHRASES), "rate_limited").when(some(KEY_PHRASES), "not_configured").when(message.isNotNull(), "other")


def first_match(value: Column, exact: dict[str, str], patterns: dict[str, str], default: str) -> Column:
    """The entry of an exact name, else of the first pattern that is found in it, else the default."""
    out = F.when(F.lit(False), default)
    for name, result in exact.items():
        out = out.when(value == name, result)
    for pattern, result in patterns.items():
        out = out.when(value.rlike(pattern), result)
    return out.otherwise(default)


def in_order(names: Column, order: list[str]) -> Column:
    """The known names of an array, in the canonical order."""
    return F.filter(F.array(*(F.lit(n) for n in order)), lambda n: F.array_contains(names, n))
