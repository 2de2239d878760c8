"""Reading names typed by people: usable values, persons and breeders taken apart."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from almagre.llm.consistent_form import consistent
from almagre.llm.slips import lost

# Words of texts that stand for a missing value (folded, without accents).
PLACEHOLDER = re.compile(
    r"^[\W_]*$|^(?:n/?a|s/?d|nd|tbc|tba|null|none|pendiente)$"
    r"|\b(?:por|sin)\s+(?:confirmar|designar|determinar|definir|anunciar|conocer|asignar)\b"
)
# Channel texts that name no channel.
NO_CHANNEL = frozenset(["sin tv", "sin television", "television", "tv", "no televisado", "plataforma de pago", "web del ayuntamiento"])
# Words and signs of page text caught in a value (folded, without accents).
PAGE_TEXT = re.compile(
    r"[|›»€©@#<>]|https?:|www\.|\d/\d|\b(?:leer|ver|saber)\s+(?:mas|todo|cartel|carteles|video)\b|\bver$|\bcompartir\b|\bcookies\b|\bmenu\b"
    r"|\bnoticias?\s+relacionad|\babonos?\s+a\s+la\s+venta\b|\bentradas?\b|\btaquilla|\bdespacho\b|\blocalidades\b"
    r"|\bsuspendido\b|\baplazado\b|\bcartel\s+completo\b|\bprogramacion\s+de\s+la\b|\bempresa\s+hara\b"
    r"|\bproximo\s+dia\b|\babrira\b|\bcontacto\b|\binicio\b|\bactualidad\b|\bpublicidad\b|\bsuscrib|\bhaz\s+clic\b"
)
CUT = re.compile(r"\.\.\.|…|\[\]$")
# Words inside names that carry no meaning of their own.
LINKS = frozenset("de del d la las los el y e".split())
#: Stands for the given name where there is none; no given name begins so.
LONE = "·"
# Honorifics before a name.
HONORIFICS = frozenset("sr sra sres sras don dona d dna excmo excma".split())
# What breeders' names begin with, and its usual short forms.
TITLES = {
    "ganaderia": "gan ganad gana", "dehesa": "deh", "conde": "cde cond", "condesa": "cdsa cdesa", "marques": "mques marq mqs", "marquesa": "mqsa mquesa marqsa marq",
    "duque": "dq", "duquesa": "dqsa", "viuda": "vda", "hijos": "hjos hjs", "hijas": "hjas", "hermanos": "hnos hermnos", "hermanas": "hnas",
    "herederos": "hros hdros hered herds", "sucesores": "suc sucs suces", "explotaciones": "explot expl explots", "doctor": "dr", "doctora": "dra",
    "toros": "", "hierro": "", "finca": "", "vizconde": "vzde", "baron": "bar", "baronesa": "", "sobrinos": "sobs", "nietos": "",
}
_titles = {short: tuple(t for t, s in TITLES.items() if short == t or short in s.split()) for x in TITLES for short in (x, *TITLES[x].split())}
# Spanish familiar forms of given names.
FAMILIAR = {
    "francisco": "paco curro pancho kiko quico fran paquito currito", "jose": "pepe pepito chepe josele", "manuel": "manolo lolo manu manolito manolete",
    "antonio": "tono toni antonito antonin tonin", "ignacio": "nacho inaki", "enrique": "quique kike", "joaquin": "quino chimo ximo kino",
    "crescencio": "chencho crescen", "vicente": "chente vicen", "alberto": "beto berto", "rafael": "rafa rafi rafalito falo", "nicolas": "nico colas", "sebastian": "sebas chano",
    "gabriel": "gabi gabri", "gonzalo": "gonza chalo", "ramon": "moncho mon", "jesus": "chus chuso suso", "santiago": "santi yago chago", "javier": "javi xavi", "daniel": "dani",
    "fernando": "nando fer", "pedro": "perico", "gregorio": "goyo", "luis": "lucho luisito", "eduardo": "edu lalo", "ricardo": "richi", "miguel": "migue miguelito", "roberto": "berto beto",
    "guillermo": "guille memo", "alfonso": "fonso alfon poncho", "alejandro": "alex jandro", "teofilo": "teo filo", "teodoro": "teo doro", "leandro": "lea leo", "ernesto": "neto tito", "agustin": "agus tin",
    "martin": "tin marti", "damian": "dami", "julian": "juli", "adrian": "adri", "tomas": "tomi tomasin", "angel": "angelito gelo", "andres": "andresito andy", "benito": "beni", "victor": "vito vitin",
    "felix": "feli", "ezequiel": "cheque zeque", "raimundo": "rai mundo", "emilio": "milio mili", "lucia": "luci lucita", "rocio": "rochi chio", "isidro": "isi sidro", "hilario": "lalo hila", "eusebio": "sebio use",
    "carmelo": "melo", "marcos": "marquitos", "salvador": "salva", "bartolome": "bartolo", "baltasar": "balta", "lazaro": "lazarillo", "esteban": "teba esteve", "german": "mancho", "diego": "dieguito", "pablo": "pablito", "saul": "sauli",
    "ruben": "rube", "mateo": "teo", "matias": "mati", "simon": "moncho", "fermin": "mincho", "oscar": "osqui", "gaspar": "gaspi", "bruno": "brunito", "cesar": "cesarin", "elias": "eli", "ciriaco": "ciri", "quintin": "quinti",
}
_familiar: dict[str, set[str]] = {}
for _full, _short in FAMILIAR.items():
    for _s in _short.split():
        _familiar.setdefault(_s, set()).add(_full)


def plain(text: str) -> str:
    """Consistent, folded and without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", consistent(text).casefold()) if not unicodedata.combining(c))


def usable(text: str | None) -> bool:
    """Whether a value is there, is no placeholder, isn't cut off and holds nothing but itself."""
    if text is None or not text.strip():
        return False
    form = plain(text).strip()
    return not (CUT.search(consistent(text)) or PLACEHOLDER.search(form) or PAGE_TEXT.search(form))


def names_channel(text: str | None) -> bool:
    """Whether a channel value is usable and names a channel."""
    return usable(text) and plain(text).strip() not in NO_CHANNEL


class Name(NamedTuple):
    """A name taken apart. ``head``: given name or titles; ``rest``: surnames or the breeder's own name."""

    kind: str
    head: str
    heads: tuple[str, ...]
    rest: tuple[str, ...]
    short: bool


def similar(a: str, b: str) -> bool:
    """Longest-common-subsequence ratio of at least one letter short of the longer token (of five letters or more)."""
    return a == b or (max(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and lost(a, b) <= 1)


def _title(token: str) -> tuple[str, ...]:
    """The titles a word may be: itself or a short form, or with one letter lost."""
    if token in _titles:
        return _titles[token]
    return tuple(t for t in TITLES if len(t) >= 5 and similar(token, t)) if len(token) >= 4 else ()


def breeder(text: str, most: int | None = 4) -> Name | None:
    """A breeder's name, or None: title and own name, in either order; the own name has at most so many words, or any number (None)."""
    form = re.sub(r"[,.]?\s*\bs\.?\s*[lac]\.?\s*(?:u\.?)?\s*$", "", plain(text)).strip()
    m = re.match(r"^(.*?)\s*\(\s*(\w+\.?)\s*\)$", form) or re.match(r"^([^,]+),\s*(.+)$", form)
    if m and _title(re.split(r"\W+", m.group(2))[0]):
        form = f"{m.group(2)} {m.group(1)}"
    if re.search(r"[^\w\s.,'’-]|\d", form):
        return None
    words = [w for w in re.findall(r"[^\W\d_]+", form)]
    while words and (words[0] in HONORIFICS or words[0] in LINKS):
        words = words[1:]
    if len(words) > 1 and not _title(words[0]) and words[-1] in ("hermanos", "hnos", "hijos", "herederos", "sucesores"):
        words = [words[-1], *words[:-1]]
    titles = _title(words[0]) if words else ()
    own = tuple(w for w in words[1:] if w not in LINKS)
    if not titles or not own or (most is not None and len(own) > most):
        return None
    # the name after the title is written as a name: it begins with a capital, unless all is small
    return Name("breeder", words[0], titles, own, False)


def person(text: str) -> Name | None:
    """A person's name, or None: given name and one or two surnames, in either order."""
    shown = consistent(text).strip()
    if re.search(r"[^\w\s.,'’-]|\d", shown):
        return None
    m = re.match(r"^([^,]+),\s*([^,]+)$", shown)
    if "," in shown and not m:
        return None
    given, family = (m.group(2), m.group(1)) if m else (None, None)
    words = shown.split() if not m else given.split() + family.split()
    if not 2 <= len(words) <= 4 or any(not w.rstrip(".") for w in words):
        return None
    caps = [w[0].isupper() for w in words]
    if any(caps) and not all(caps):
        return None
    folded = [plain(w) for w in words]
    bare = [w.rstrip(".") for w in folded]
    if any(not b.replace("'", "").replace("’", "").replace("-", "").isalpha() for b in bare) or any(b in LINKS or b in HONORIFICS for b, f in zip(bare, folded, strict=True) if not f.endswith(".")):
        return None
    n = len(given.split()) if m else 1
    head, rest = " ".join(bare[:n]), tuple(f if f.endswith(".") or len(f) == 1 else b for f, b in zip(folded[n:], bare[n:], strict=True))
    if not rest or rest[0].endswith(".") or len(rest[0]) < 3:
        return None
    short = folded[0].endswith(".") or len(bare[0]) == 1 or rest[-1].endswith(".") or len(rest[-1]) == 1
    return Name("person", head, (), rest, short)


def familiar_for(short: str) -> tuple[str, ...]:
    """The given names a familiar form may stand for."""
    return tuple(_familiar.get(short, ()))


def any_person(text: str) -> Name | None:
    """As ``person``, also with link words, any number of words, surnames of two letters, and names without a given name.

    "Juan de la Torre" is juan torre; the head of "El Juli" or "Antoñete" is ``LONE`` and the word in front. Towns are written so
    too: a caller leaves out those it knows. Two given names with "y" between them are no name.
    """
    if found := person(text):
        return found
    shown = consistent(text).strip()
    m = re.match(r"^([^,]+),\s*([^,]+)$", shown)
    if ("," in shown and not m) or re.search(r"[^\w\s.,'’-]|\d", shown):
        return None
    given, family = (m.group(2).split(), m.group(1).split()) if m else ([], shown.split())
    words = given + family
    linked = [plain(w) in LINKS for w in words]
    own = [w for w, link in zip(words, linked, strict=True) if not link]
    caps = [w[0].isupper() for w in own]
    if not own or (any(caps) and not all(caps)) or (not m and len(words) > 1 and plain(words[1]) in ("y", "e")):
        return None
    folded = [plain(w) for w in own]
    bare = [w.rstrip(".") for w in folded]
    if not all(re.sub("['’-]", "", b).isalpha() for b in bare) or any(b in HONORIFICS for b in bare):
        return None
    rest = [f if f.endswith(".") or len(f) == 1 else b for f, b in zip(folded, bare, strict=True)]
    n = 0 if linked[0] or len(own) == 1 else sum(not link for link in linked[: len(given)]) or 1
    head = " ".join(bare[:n]) if n else LONE + (plain(words[0]) if linked[0] else "")
    rest = tuple(rest[n:])
    if not rest or rest[0].endswith(".") or len(rest[0]) < (2 if n else 3):
        return None
    short = bool(n) and (folded[0].endswith(".") or len(bare[0]) == 1) or rest[-1].endswith(".") or len(rest[-1]) == 1
    return Name("person", head, (), rest, short)


def same_head(short: str, full: str) -> int:
    """How a given name may stand for another: 0 the same, 1 a short or familiar form, 2 with a letter lost, 9 not at all."""
    if short == full:
        return 0
    if full in _familiar.get(short, ()):
        return 1
    rest = iter(full)
    if len(short) < len(full) and short[0] == full[0] and (full.startswith(short) or (len(short) <= min(4, len(full) - 2) and all(c in rest for c in short) and full[-1] == short[-1])):
        return 1
    close = max(len(short), len(full)) == 4 and min(len(short), len(full)) >= 3 and lost(short, full) <= 1
    return 2 if close or similar(short, full) else 9
