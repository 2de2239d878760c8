"""Text normalisation, cleaning and tolerant extraction, as column expressions that stay in whole-stage codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# letters with a canonical decomposition into one base letter, by rule
_ACCENTED = {
    chr(c): d[0]
    for c in range(0xC0, 0x250)
    if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])
}
_FROM, _TO = "".join(_ACCENTED), "".join(_ACCENTED.values())

# The named HTML entities that are decoded.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó",
    "uacute": "ú", "ntilde": "ñ", "uuml": "ü", "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú",
    "Ntilde": "Ñ", "Uuml": "Ü", "iexcl": "¡", "iquest": "¿", "ordm": "º", "ordf": "ª", "laquo": "«", "raquo": "»",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "euro": "€", "amp": "&",
}


def once(col: Column, f) -> Column:
    """``f`` of a value that is worked out a single time, however often ``f`` names it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def fold_accents(col: Column) -> Column:
    """Latin letters without their accents; combining marks go, all else stays."""
    return F.regexp_replace(F.translate(col, _FROM, _TO), "[\\u0300-\\u036f]", "")


def squeezed(col: Column) -> Column:
    """White space of any kind collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalized(col: Column) -> Column:
    """Words only: lower case, no accents, anything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(col)), r"[^\p{L}\p{N}]+", " "))


def folded(col: Column) -> Column:
    """Lower case without accents; punctuation and inner spaces stay."""
    return F.trim(fold_accents(F.lower(col)))


def without_invisible(col: Column) -> Column:
    """Without zero-width characters and byte order marks."""
    return F.regexp_replace(col, "[\\u200b-\\u200d\\u2060\\ufeff]", "")


def without_trailing_date(col: Column) -> Column:
    """A title without a date in brackets at its end."""
    return squeezed(F.regexp_replace(col, r"\s*\(\d{1,2}/\d{1,2}/\d{2,4}\)\s*$", ""))


def without_prefixes(col: Column, words: list[str]) -> Column:
    """A value without any number of the given words, with their colons and dashes, before it."""
    return squeezed(F.regexp_replace(col, rf"(?iu)^(?:\s*(?:{'|'.join(words)})\s*[:\-–—]?[\s:–—-]*)+", ""))


def accepted(col: Column, most: int, unwanted: str) -> Column:
    """The value, or an empty text if it is missing, too long or matches the unwanted pattern."""
    return F.when(col.isNull() | (F.length(col) > most) | col.rlike(unwanted), "").otherwise(col)


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def ladder(col: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The label of the first rule ``(pattern, label)`` a value matches, in the order given."""
    out = None
    for pattern, label in rules:
        out = F.when(col.rlike(pattern), label) if out is None else out.when(col.rlike(pattern), label)
    return out.otherwise(F.lit(None) if otherwise is None else otherwise)


def any_and_any(col: Column, first: list[str], second: list[str]) -> Column:
    """Whether a text contains one of the first words and one of the second."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(col, w))
    return has(first) & has(second)


def decoded_entities(col: Column) -> Column:
    """Named and numeric HTML entities decoded; the ampersand last, so that nothing is decoded twice."""
    for name, sign in ENTITIES.items():
        if name != "amp":
            col = F.replace(col, F.lit(f"&{name};"), F.lit(sign))
    numeric = F.regexp_extract_all(col, F.lit(r"(?i)&#(\d+|x[0-9a-f]+);"), F.lit(1))
    col = F.aggregate(
        F.array_distinct(numeric), col,
        lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), _character(n)),
    )
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def _character(number: Column) -> Column:
    """The character of a decimal or ("x…") hexadecimal number, through UTF-32; U+FFFD where Unicode has none."""
    hexadecimal = F.lower(F.substring(number, 1, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(number, "^[xX]", ""), "^0+(?=.)", "")
    # seven decimal and six hexadecimal figures hold all of Unicode
    code = F.when(hexadecimal, F.when(F.length(digits) <= 6, F.conv(digits, 16, 10).try_cast("int"))).otherwise(F.when(F.length(digits) <= 7, digits.try_cast("int")))
    none = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0)
    return F.when(none, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(none, 32).otherwise(code)), 8, "0")), "UTF-32"))


def html_text(col: Column) -> Column:
    """The readable text of HTML: no scripts, styles and comments, a space for each tag, entities decoded."""
    col = F.regexp_replace(col, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    col = F.regexp_replace(col, r"(?s)<!--.*?-->", " ")
    return squeezed(decoded_entities(F.regexp_replace(col, r"(?s)<[^>]*>", " ")))


def cut_from(col: Column, markers: list[str]) -> Column:
    """A text up to the first of the markers (patterns), case ignored."""
    for marker in markers:
        col = F.regexp_replace(col, rf"(?is)(?:{marker}).*$", "")
    return col


def html_escaped(col: Column) -> Column:
    """The five signs of HTML as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(sign), F.lit(entity))
    return col


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta tag by its name or property, whatever the order of attributes; null if there is none."""
    key, value = rf"(?:name|property)\s*=\s*[\"']{name}[\"']", r"content\s*=\s*[\"']([^\"']*)[\"']"
    return first_filled(
        F.regexp_extract(html, rf"(?is)<meta\b[^>]*?{key}[^>]*?{value}", 1),
        F.regexp_extract(html, rf"(?is)<meta\b[^>]*?{value}[^>]*?{key}", 1),
    )


def links(html: Column, pattern: str, most: int | None = None) -> Column:
    """Distinct targets of links that match a pattern, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(rf"(?i)href\s*=\s*[\"']([^\"']*{pattern}[^\"']*)[\"']"), F.lit(1)))
    return found if most is None else F.slice(found, 1, most)


def xml_items(xml: Column, tag: str, fields: list[str]) -> Column:
    """The elements of a tag as structs of their fields' texts, CDATA unwrapped."""
    items = F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))

    def text(item: Column, field: str) -> Column:
        inner = F.regexp_extract(item, rf"(?is)<{field}\b[^>]*>(.*?)</{field}\s*>", 1)
        return squeezed(decoded_entities(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))

    return F.transform(items, lambda item: F.struct(*[text(item, f).alias(f) for f in fields]))


def clipped_slug(col: Column, most: int) -> Column:
    """Lower case words joined by hyphens, without hyphens at the ends, of bounded length."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(slug, 1, most)


def length_class(col: Column, steps: list[tuple[int, str]], otherwise: str) -> Column:
    """The label of the first step whose length a text reaches."""
    out = F.when(F.lit(False), "")
    for least, label in steps:
        out = out.when(F.length(col) >= least, label)
    return out.otherwise(otherwise)


def initials(col: Column, most: int) -> Column:
    """The first letters of a text's words, upper case."""
    words = F.filter(F.split(squeezed(col), " "), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.substring(w, 1, 1)), ""))
