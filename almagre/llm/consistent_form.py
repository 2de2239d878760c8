"""Visually identical text with different characters: one consistent form.

``consistent`` is the form of a single value, ``consistent_column`` the vectorised column expression
(each distinct value of an Arrow batch is worked out once), ``not_consistent`` the report of the rows
that were not in that form and ``comparison_key`` the case-folded form for comparing.

Steps: per character compatibility decomposition, except for the characters that are meant as they are
(ordinal signs, ellipsis, superscripts and the like); whitespace that only imitates a space becomes U+0020;
default-ignorable characters go, except an emoji's variation selector and joiner; letters that only look
like those of their word's script are replaced; the result is composed (NFC).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter (Unicode confusables, single letters only).
CYRILLIC_LIKE_LATIN = dict(
    zip("аеорсухѕіјԁԛԝһӏкАВЕЅІЈКМНОРСТУХԚԜҺӀ", "aeopcyxsijdqwhlkABESIJKMHOPCTYXQWHI", strict=True)
)
GREEK_LIKE_LATIN = dict(zip("αγικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ayikvopuxABEZHIKMNOPTYX", strict=True))
# The Greek letters drawn as the Latin one itself; the other small ones are only similar.
GREEK_SAME_AS_LATIN = set("νοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
# Letters of further scripts, and phonetic ones, drawn like a Latin letter (Unicode confusables, single letters only).
OTHER_LIKE_LATIN = dict(
    zip("օսոհցզՍՕԼᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏚᏞᏟᏢᏦᏴᏙⲟⲣⲥⲞⲢⲤⲎⲒⲔⲘⲚⲦⲬⲨⲂⲀꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴɑɡᴄᴏᴠᴡᴢꜱ",
        "ounhgqUOLDRTiAJEWMHYGhZbSLCPKBVopcOPCHIKMNTXYBABPDTGKJCZFMNLSRVHWXYAEIOUagcovwzs", strict=True)
)
# Compatibility characters that are written on purpose.
MEANT = set("ªº…´¨¸¯™℠½¼¾⅓⅔№")
# Signs without a decomposition that only imitate an ASCII sign.
SIGNS = {"‐": "-", "‑": "-", "−": "-", "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "ꞏ": ".", "․": ".", "‚": ",", "ǃ": "!", "∣": "|", "ǀ": "|", "∗": "*", "⁎": "*"}
# Ranges of default-ignorable code points (Unicode DerivedCoreProperties) and the byte order mark.
IGNORABLE = (
    r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    r"\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# White space that is not U+0020 (Unicode White_Space) and the separators of ASCII.
SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Values of these characters only are consistent; every other one is looked at. (JVM-side filter; matched whole, as $ would pass over a last line end.)
PLAIN = r"[ -~áéíóúüñçàèìòùâêîôûãõäëïöÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÃÕÄËÏÖ«»¿¡ªº·–—‘’“”…‹›]*"

_plain = re.compile(PLAIN)
_spaces = re.compile(f"[{SPACES}]")
_ignorable = re.compile(f"[{IGNORABLE}]")
_word = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_other = re.compile(f"[{''.join(OTHER_LIKE_LATIN)}]")
_DECOMPOSED = {"LATIN": {}, "CYRILLIC": CYRILLIC_LIKE_LATIN, "GREEK": GREEK_LIKE_LATIN}
_TO_LATIN = CYRILLIC_LIKE_LATIN | GREEK_LIKE_LATIN
_FROM_LATIN = {
    "CYRILLIC": {v: k for k, v in reversed(CYRILLIC_LIKE_LATIN.items())},
    "GREEK": {v: k for k, v in reversed(GREEK_LIKE_LATIN.items())},
}


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK") if name.startswith(s)), "OTHER")


def _without_ignorable(text: str) -> str:
    """Drops default-ignorable characters, but keeps a variation selector after an emoji and a joiner between two."""
    out = ""
    for i, ch in enumerate(text):
        if _ignorable.match(ch):
            after = out[-1:] and (unicodedata.category(out[-1]) in ("So", "Sk") or out[-1] == "\ufe0f")
            keycap = ch == "\ufe0f" and out[-1:].isascii() and text[i + 1 : i + 2] == "\u20e3"
            joins = ch == "\u200d" and after and unicodedata.category(text[i + 1 : i + 2] or " ") == "So"
            if not (joins or keycap or ch == "\ufe0f" and after and out[-1] != "\ufe0f"):
                continue
        out += ch
    return out


@lru_cache(maxsize=65536)
def _plain_form(ch: str) -> str:
    """A character's compatibility form, unless it is meant as it is."""
    if ch in MEANT or ch in SIGNS:
        return SIGNS.get(ch, ch)
    tag = unicodedata.decomposition(ch).partition(">")[0]
    if tag in ("<super", "<sub", "<fraction", "<circle", "<square"):
        return ch
    return unicodedata.normalize("NFKC", ch) if tag.startswith("<") else ch


def _word_script(letters: str) -> str | None:
    """The script a mixed or doubtful word is written in; None if it stays as it is.

    Letters without a look-alike decide; without any, the word is Latin if it holds a Latin letter.
    """
    scripts = {s for s in map(_script, letters) if s != "OTHER"}
    if scripts == {"LATIN"} or not scripts:
        return None
    sure = {"LATIN": 0, "CYRILLIC": 0, "GREEK": 0}
    for ch in letters:
        s = _script(ch)
        if s in ("CYRILLIC", "GREEK") and ch not in _DECOMPOSED[s]:
            sure[s] += 1
        elif s == "LATIN" and not any(ch in _FROM_LATIN[x] for x in scripts - {"LATIN"}):
            sure[s] += 1
    if sure["LATIN"] and sure["LATIN"] >= max(sure["CYRILLIC"], sure["GREEK"]):
        return "LATIN"
    if sure["CYRILLIC"] or sure["GREEK"]:
        return "CYRILLIC" if sure["CYRILLIC"] >= sure["GREEK"] else "GREEK"
    if "LATIN" in scripts:
        return "LATIN"
    return "DOUBTFUL"


def _latin_only(word: str) -> str:
    """A word with other scripts' letters that look Latin, in Latin if it holds a letter of the basic Latin script too."""
    if _other.search(word) and any("a" <= c.casefold() <= "z" for c in unicodedata.normalize("NFD", word)):
        return _other.sub(lambda m: OTHER_LIKE_LATIN[m.group()], word)
    return word


def _one_script(text: str) -> str:
    if _other.search(text):
        text = _word.sub(lambda m: _latin_only(m.group()), text)
    spans = [(m.start(), m.end(), m.group()) for m in _word.finditer(text)]
    bare = [unicodedata.normalize("NFC", w) for _, _, w in spans]
    base = ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in bare]
    if all(_script(c) in ("LATIN", "OTHER") for w in base for c in w):
        return text
    kinds = [_word_script(w) for w in base]
    really = {s for w, k in zip(base, kinds, strict=True) if k in ("CYRILLIC", "GREEK") for s in (k,)}
    out, at = [], 0
    for (a, b, w), letters, kind in zip(spans, base, kinds, strict=True):
        if kind == "DOUBTFUL":  # each letter has a Latin look-alike: another script only beside a word surely in it
            own = {_script(c) for c in letters}
            same = all(c in GREEK_SAME_AS_LATIN or c in CYRILLIC_LIKE_LATIN for c in letters)
            kind = "LATIN" if same and not own & really else None
        if kind:
            table = _TO_LATIN if kind == "LATIN" else _FROM_LATIN[kind]
            w = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", w))
        out += [text[at:a], w]
        at = b
    return "".join([*out, text[at:]])


def consistent(text: str | None) -> str | None:
    """The consistent form of one value; null stays null, an empty text empty."""
    if text is None or _plain.fullmatch(text):
        return text
    text = _spaces.sub(" ", "".join(map(_plain_form, text)))
    if _ignorable.search(text):
        text = _without_ignorable(text)
    return unicodedata.normalize("NFC", _one_script(unicodedata.normalize("NFC", text)))


def folded(text: str | None) -> str | None:
    """The form for comparing: consistent, fully case-folded, composed, spaces collapsed."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFC", consistent(text).casefold()).split())


def _by_distinct(f):
    def run(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values, use_na_sentinel=True)
        done = pd.Series([f(u) for u in uniques], dtype=object)
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return F.pandas_udf(run, StringType())


def consistent_column(col: Column) -> Column:
    """``consistent`` as a column: one call per distinct value of a batch, no shuffle."""
    return _by_distinct(consistent)(col)


def comparison_key(col: Column) -> Column:
    """``folded`` as a column."""
    return _by_distinct(folded)(col)


def not_consistent(df: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """``(key, value, form)`` of the rows whose value isn't in consistent form.

    Null and empty values are consistent; repeated rows are reported as often as they stand; columns
    of any other name pass unread. Plain values never leave the JVM: only those with an unusual
    character reach Python.
    """
    doubtful = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where(~F.col("value").rlike(rf"\A{PLAIN}\z"))
    formed = doubtful.withColumn("form", consistent_column(F.col("value")))
    return formed.where(F.col("form") != F.col("value"))
