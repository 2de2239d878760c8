"""Places as typed: keys for comparing, search names, generic labels, cleaning. Wordings are parameters with their usual values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagre.functions.similarity import fuzzy
from almagre.functions.text import normalized, once, squeezed

# Towns that a place means if it contains the name, in order; the last only where provinces in brackets don't count.
TOWNS = (
    "madrid", "azpeitia", "pamplona", "sevilla", "huelva", "malaga", "bilbao", "valencia", "cordoba", "santander", "san sebastian", "dax", "beziers", "nimes", "arles",
)
PROVINCE_TOWNS = (("guipuzcoa", "azpeitia"),)
# What says nothing about the place, and what it stands for where that isn't nothing.
UNSAID = (("espana", " "), ("plaza de toros", " "), ("monumental", " "), ("real maestranza", " maestranza "))
ARENAS = (("las ventas", "madrid"),)
# Countries left out of a comparison, and those kept in a search name.
COUNTRIES = ("españa", "spain", "portugal", "francia", "france", "méxico", "mexico", "colombia", "perú", "peru")
SEARCHED = ("España", "Portugal", "Francia", "México", "Colombia", "Perú", "Ecuador")
# Labels that name no event or place (normalised).
GENERIC = ("television", "toros en cmm", "toros 2026", "festejo taurino", "cartel por confirmar", "localidad por confirmar", "programa taurino")
LISTING = r"^(?:toros(?: 20\d{2})?|corrida(?: de toros)?|festejo taurino)$"
# Terms of a country's places, by code, in order; no term means the home country.
COUNTRY_TERMS = (
    ("FR", ("francia", "france", "nimes", "arles", "beziers", "dax", "bayona", "bayonne", "mont de marsan", "vic fezensac")),
    ("PT", ("portugal", "lisboa", "santarem", "vilafranca de xira", "vila franca de xira", "campo pequeno", "moita")),
    ("MX", ("mexico", "aguascalientes", "queretaro", "tlaxcala", "zacatecas")), ("CO", ("colombia", "bogota", "cali", "manizales", "medellin")),
    ("PE", ("peru", "lima", "acho", "cajabamba")), ("EC", ("ecuador", "quito", "riobamba", "latacunga")), ("ES", ("espana",)),
)


def first_contained(col: Column, pairs: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first pair whose key a text contains."""
    return reduce(lambda rest, p: F.when(F.contains(col, F.lit(p[0])), p[1]).otherwise(rest), reversed(pairs), otherwise)


def _said(text: Column, also: tuple = ()) -> Column:
    """A normalised place without the words that say nothing."""
    return squeezed(reduce(lambda t, p: F.regexp_replace(t, rf"\b{p[0]}\b", p[1]), [*UNSAID, *also], text))


def canonical_place(col: Column, towns: tuple = TOWNS, by_province: tuple = PROVINCE_TOWNS, arenas: tuple = ARENAS) -> Column:
    """The place's key: a known town or arena it contains, else its words; what stands in brackets doesn't count. Null is empty."""
    col = F.coalesce(col, F.lit(""))
    text = _said(normalized(F.regexp_replace(col, r"\([^)]*\)", " ")))
    return first_contained(normalized(col), list(arenas), once(text, lambda t: first_contained(t, [(x, x) for x in towns] + list(by_province), t)))


def shown_place(col: Column, towns: tuple = TOWNS, arenas: tuple = ARENAS) -> Column:
    """The same for agendas shown together, where what stands in brackets counts."""
    text = _said(normalized(F.coalesce(col, F.lit(""))), tuple((a, f" {t} ") for a, t in arenas))
    return once(text, lambda t: first_contained(t, [(x, x) for x in towns], t))


def match_place(col: Column, countries: tuple = COUNTRIES) -> Column:
    """A place's words for similarity: without brackets and countries (whole ASCII words, as accented ends never part a word)."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), r"\([^)]*\)", " ")
    plain = "|".join(c for c in countries if c[-1].isascii())
    return normalized(F.regexp_replace(bare, rf"(?i)(?<![A-Za-z0-9_])(?:{plain})(?![A-Za-z0-9_])", " "))


def place_similarity(a: Column, b: Column) -> Column:
    """How alike two places are, by their words or letters."""
    return fuzzy(match_place(a), match_place(b))


def generic_label(col: Column, labels: tuple = GENERIC) -> Column:
    """Whether a label is missing or names nothing."""
    return F.coalesce(normalized(col), F.lit("")).isin("", *labels)


def generic_listing(cols: list[Column], labels: tuple = GENERIC, pattern: str = LISTING) -> Column:
    """Whether one of the labels that are there is generic or only says that there is something on."""
    return F.exists(F.array(*[F.coalesce(normalized(c), F.lit("")) for c in cols]), lambda x: (x != "") & (x.isin(*labels) | x.rlike(pattern)))


def search_name(col: Column, countries: tuple = SEARCHED) -> Column:
    """What to look a place up by: the town before a comma or bracket, and a country named anywhere."""
    text = squeezed(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)\b(plaza de toros|plaza monumental|coso taurino)\b", " "))
    town = F.trim(F.regexp_extract(text, r"^([^,(]+)", 1))
    country = F.regexp_extract(text, rf"(?iu)(?<![\p{{L}}\d])({'|'.join(countries)})(?![\p{{L}}\d])", 1)
    return F.array_join(F.filter(F.array(F.when(town == "", text).otherwise(town), country), lambda x: x != ""), ", ")


def country_code(parts: list[Column], explicit: Column | None = None, rules: tuple = COUNTRY_TERMS, home: str = "ES") -> Column:
    """An explicit country code that is known, else the first rule with a term in the parts, else home."""
    text = normalized(F.concat_ws(" ", *parts))
    pairs = [(term, code) for code, terms in rules for term in terms]
    found = once(text, lambda t: first_contained(t, pairs, F.lit(home)))
    if explicit is None:
        return found
    code = F.upper(F.trim(explicit))
    return F.when(code.isin(*[c for c, _ in rules]), code).otherwise(found)


def without_lead(col: Column) -> Column:
    """A place without weekdays, dates and times before it."""
    weekday = r"(?:lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo)"
    date = r"(?:\d{1,2}\s+de\s+[a-zñ]+(?:\s+de\s+\d{4})?|\d{1,2}/\d{1,2}(?:/\d{2,4})?)"
    return squeezed(F.regexp_replace(col, rf"(?iu)^(?:\s*(?:{weekday}|{date}|\d{{1,2}}[:.]\d{{2}}(?:\s*(?:h|horas)\b)?)\s*[,.:;–—-]*)+\s*", ""))


def without_tail(col: Column, markers: list[str]) -> Column:
    """A place up to the first clause that begins with one of the words, without punctuation at its end."""
    cut = F.regexp_replace(col, rf"(?iu)\s*[,.;–—-]?\s+(?:{'|'.join(markers)})\b.*$", "")
    return squeezed(F.regexp_replace(cut, r"[\s,.;:–—-]+$", ""))


def more_telling(a: Column, b: Column) -> Column:
    """The longer of two places, where some words weigh more and the home country less; the first of equals, the other if one is empty."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))

    def points(v: Column) -> Column:
        terms = (("(?i)plaza de toros", 30), ("(?i)monumental", 20), (r"\(", 10), ("(?iu)españa", -8))
        return F.length(v) + sum((F.when(v.rlike(p), n).otherwise(0) for p, n in terms[1:]), F.when(v.rlike(terms[0][0]), terms[0][1]).otherwise(0))

    return F.when(x == "", y).when(y == "", x).when(points(x) >= points(y), x).otherwise(y)
