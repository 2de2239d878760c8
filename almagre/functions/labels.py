"""What an event is called and whether it is on television: classes, labels, keys. Wordings are parameters with their usual values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagre.functions.places import GENERIC, generic_label
from almagre.functions.text import decoded_entities, first_filled, ladder, normalized, once, squeezed, without_invisible

# Channels that are none (normalised).
NO_CHANNEL = ("sin tv", "no televisado", "no televisada", "sin television")
NOT_SHOWN = (*NO_CHANNEL, "no tv")
UNNAMED = ("canal por confirmar", "por confirmar", "sin confirmar", "no confirmado", "ninguno")
# Patterns of a normalised channel and its name, in order.
CHANNELS = (
    (r"^onetoro$|^one toro$", "OneToro"), ("canal sur", "Canal Sur"), ("canal extremadura|extremadura tv|extremadura television", "Canal Extremadura"), ("telemadrid", "Telemadrid"),
    ("castilla la mancha|cmmedia|^cmm$", "CMM"), ("castilla y leon|la 7 cyl|^cyltv$", "La 7 CyL"), ("rtve|la 2|tendido cero", "RTVE"), ("toros en espana play", "Toros en España Play"),
)
# Patterns of a normalised type and its name, in order.
TYPES = (
    ("programa", "Programa taurino"), ("mixta|mixto", "Festejo mixto"), ("rejones|rejoneo", "Rejones"), (r"novillada.*sin (?:picadores|caballos)|sin (?:picadores|caballos).*novillada", "Novillada sin picadores"),
    ("novillada.*picadores|picadores.*novillada", "Novillada con picadores"), ("novillada", "Novillada"), ("corrida", "Corrida de toros"), ("recortadores|recortes", "Concurso de recortadores"),
)
# Patterns of a normalised type and its fine class, in order.
CLASSES = (
    ("rejones|rejoneo|rejoneadores", "rejones"), ("novillada con picadores|novillada picada|novillos con picadores", "novillada-picadores"),
    ("novillada sin picadores|novillada sin caballos|novillos sin picadores", "novillada-sin-picadores"), ("novillada", "novillada"), ("festival", "festival"), ("recortes|recortadores", "recortes"),
    ("clase practica", "clase-practica"), ("becerrada|becerros", "becerrada"), ("tentadero|tienta", "tentadero"), ("mixta|mixto", "mixta"), ("corrida|toros", "corrida"),
)
# Page text that makes a breeder's name, or a participant, unusable.
NO_BREEDING = r"(?iu)servicio gratis|me gusta responder|comentarios?|pulsa aqu[ií]"
NO_PERSON = r"(?iu)\b(?:con|sin)\s+picadores\b|cookies?|privacidad|derechos reservados|publicidad|navegaci[oó]n"
DEFERRED = r"(?i)\b(?:en\s+)?diferido\b"
MOVED = r"(?i)aplaz|cambi[ao]|reubic|nueva.?fecha|traslad"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def filled(col: Column) -> Column:
    return _text(col) != ""


def cleaned_name(col: Column) -> Column:
    """A name without a date in brackets behind it and the word for a breeder before it."""
    col = F.regexp_replace(_text(col), r"\s*\(\d{2}/\d{2}/\d{4}\)\s*$", "")
    return squeezed(F.regexp_replace(col, r"(?iu)^ganader[ií]a\s*:\s*", ""))


def cleaned_breeding(col: Column, most: int = 220, unwanted: str = NO_BREEDING) -> Column:
    """A breeder's name: entities decoded, no quotes and invisible characters, any number of leading words for a breeder gone; empty if it can't be one."""
    col = without_invisible(decoded_entities(F.regexp_replace(_text(col), r"(?i)&(?:laquo|raquo|ldquo|rdquo|quot);", " ")))
    col = squeezed(F.regexp_replace(col, "[«»“”\"'´`]", " "))
    col = cleaned_name(F.regexp_replace(col, r"(?iu)^(?:\s*ganader[íi]a\s*[:\-–—]?[\s:–—-]*)+", ""))
    return once(col, lambda c: F.when((F.length(c) > most) | c.rlike(unwanted), "").otherwise(c))


def without_edges(col: Column) -> Column:
    """A value without quotes at its ends and full stops behind it."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.trim(_text(col)), "^[\"'«»“”‘’]+", ""), "[\"'«»“”‘’.\\s]+$", ""))


def without_prefix_words(col: Column, words: list[str]) -> Column:
    """A breeder without one of the words, its colon and what leads to it, before the name."""
    return squeezed(F.regexp_replace(_text(col), rf"(?iu)^\s*(?:(?:{'|'.join(words)})\s*(?:de\s+(?:la\s+|los\s+|las\s+)?)?[:\-–—]?\s*)+", ""))


def channel_name(col: Column, channels: tuple = CHANNELS) -> Column:
    """A channel's name by the first pattern, else as typed; a missing one is just television."""
    return once(F.coalesce(normalized(col), F.lit("")), lambda t: ladder(t, list(channels), first_filled(cleaned_name(col), F.lit("Televisión"))))


def type_name(col: Column, types: tuple = TYPES) -> Column:
    """A kind of event by the first pattern, else as typed; a missing one is just an event."""
    return once(F.coalesce(normalized(col), F.lit("")), lambda t: F.when(t == "", "Festejo taurino").otherwise(ladder(t, list(types), cleaned_name(col))))


def type_class(col: Column, classes: tuple = CLASSES) -> Column:
    """The fine class of a kind of event."""
    return once(F.coalesce(normalized(col), F.lit("")), lambda t: ladder(t, list(classes), F.lit("other")))


def no_channel(col: Column, words: tuple = NO_CHANNEL) -> Column:
    """Whether a channel is missing or says that there is none."""
    return F.coalesce(normalized(col), F.lit("")).isin("", *words)


def real_channel(col: Column) -> Column:
    """Whether a channel is named and isn't a word for none."""
    return ~no_channel(col, NOT_SHOWN)


def not_televised(flag: Column, channel: Column) -> Column:
    """Whether an event isn't on television: the flag counts before the channel."""
    return F.coalesce(flag == F.lit(False), F.lit(False)) | no_channel(channel, NOT_SHOWN)


def deferred(flag: Column, cols: list[Column]) -> Column:
    """Whether an event is broadcast later: by its flag or a word in any of the fields."""
    return F.coalesce(flag, F.lit(False)) | F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols]).rlike(DEFERRED)


def moved_signal(cols: list[Column]) -> Column:
    """Whether any of the fields says that a date or place has changed."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols]).rlike(MOVED)


def broadcast(channel: Column, source: Column, flag: Column) -> Column:
    """``(confirmed, label)``: whether a broadcast is confirmed, by flag or by a named channel (or source), and what to show."""
    raw = F.trim(_text(first_filled(channel, source)))
    named = ~F.coalesce(normalized(raw), F.lit("")).isin("", *UNNAMED)
    confirmed = ~F.coalesce(flag == F.lit(False), F.lit(False)) & (F.coalesce(flag, F.lit(False)) | named)
    label = F.when(confirmed, first_filled(raw, F.lit("Emisión confirmada"))).otherwise("Sin emisión confirmada")
    return F.struct(confirmed.alias("confirmed"), label.alias("label"))


def broadcast_url(explicit: list[Column], shown: Column, links: list[tuple[str, str]]) -> Column:
    """An explicit address, else that of the first known channel which a confirmed broadcast's label contains; else empty."""
    text = F.coalesce(normalized(shown["label"]), F.lit(""))
    known = F.lit("")
    for name, url in reversed(links):
        known = F.when(F.contains(text, normalized(F.lit(name))), url).otherwise(known)
    return F.coalesce(first_filled(*[F.trim(c) for c in explicit]), F.when(shown["confirmed"], known), F.lit(""))


def programme_name(cols: list[Column], ignored: tuple = ("television", "programa taurino")) -> Column:
    """The first label of a programme that says which it is, else the first there is."""
    plain = lambda c: F.coalesce(normalized(c), F.lit(""))
    telling = F.get(F.filter(F.array(*[_text(c) for c in cols]), lambda c: ~plain(c).isin("", *ignored)), F.lit(0))
    return F.trim(F.coalesce(telling, first_filled(*cols[:2]), F.lit("Programa taurino")))


def joined_key(cols: list[Column], normal: bool = True) -> Column:
    """A key of fields, with a place for missing ones."""
    return F.concat_ws("|", *[F.coalesce(normalized(c), F.lit("")) if normal else _text(c) for c in cols])


def dotted_label(cols: list[Column]) -> Column:
    """The fields that are filled, with dots between."""
    return F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in cols])


def lead_time(mins: Column) -> Column:
    """Minutes before an event as hours where they are whole ones."""
    return F.when(mins == 60, "1 hora").when((mins > 60) & (mins % 60 == 0), F.concat(F.floor(mins / 60).cast("string"), F.lit(" horas"))).otherwise(F.concat(mins.cast("string"), F.lit(" min")))


def information(time: Column, location: Column, name: Column, title: Column, kind: Column, breeding: Column, people: Column, url: Column, labels: tuple = GENERIC) -> Column:
    """Points for what a record says; generic labels say nothing."""
    said = lambda c: filled(c) & ~generic_label(c, labels)
    points = [(filled(time), 4), (said(location), 8), (said(name), 8), (said(title), 5), (filled(kind) & (type_name(kind) != "Festejo taurino"), 3), (filled(breeding), 4), (filled(url), 1)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.least(F.lit(8), F.coalesce(F.size(people), F.lit(0)) * 2))


def informative(first: Column, second: Column, prefer_second: Column, labels: tuple = GENERIC) -> Column:
    """Of two values the one that is there, then the one that isn't generic, then the preferred one."""
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    plain_a, plain_b = generic_label(a, labels), generic_label(b, labels)
    return (
        F.when(a.isNull() | b.isNull(), F.coalesce(a, b, first, second)).when(plain_a & ~plain_b, b).when(~plain_a & plain_b, a)
        .when(prefer_second, b).otherwise(a)
    )
