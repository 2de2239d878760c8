"""One agenda out of many feeds: adapters, an ordered fold of each day's records, survivorship, exclusions, moved events.

A record has ``rank`` (its feed's place in the order) and ``seq`` (its place in the feed). Records of another date or content type never
match, so each (date, content type) is folded on its own. A record joins the record that it matches best so far, if
the score reaches the threshold, and the two become one; so the outcome depends on the order. Days too large for one fold
are split where no match is possible: between places that exclude each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from almagre.functions import labels, places
from almagre.functions.dates import closeness, minutes
from almagre.functions.similarity import fuzzy, rounded, share_of_smaller
from almagre.functions.text import first_filled, normalized
from almagre.operators.joins import close_pairs
from almagre.session import cut

DETAIL = "struct<name: string, confidence: int, sourceUrl: string, fetchedAt: string>"
#: Columns of a record after its adapter.
EVENT = {
    "id": "string", "date": "string", "time": "string", "channel": "string", "deferred": "boolean", "televised": "boolean", "televisionUnconfirmed": "boolean",
    "location": "string", "type": "string", "contentType": "string", "breeding": "string", "participants": "array<string>", "name": "string", "title": "string",
    "image": "string", "eventUrl": "string", "sourceUrl": "string", "sources": "array<string>", "sourceDetails": f"array<{DETAIL}>", "confidence": "int", "status": "string",
}
_SCHEMA = ", ".join(f"{c} {t}" for c, t in EVENT.items())


@dataclass(frozen=True)
class Rules:
    """Thresholds, points and wordings of the merge. Fixed values."""

    same_people: float = 0.5
    same_breeding: float = 0.72
    same_place: float = 0.72
    other_place: float = 0.45
    close_time: float = 0.8
    least: dict = field(default_factory=lambda: {"programa": 82.0, "festejo": 70.0})
    trusted: dict = field(default_factory=lambda: {
        "Canal Sur": 98, "Canal Extremadura": 98, "OneToro": 96, "El Muletazo": 90, "Programas taurinos": 88, "Mundotoro": 86, "Las Ventas oficial": 100,
        "Va de Toros": 95, "Aplausos": 96, "Telemadrid": 98, "CMM": 98, "RTVE": 98, "La 7 CyL": 98, "Toros en España Play": 94,
    })
    default_trust: int = 80
    official: str = "Las Ventas oficial"
    confirmed: int = 94
    similar_names: float = 0.75
    time_steps: tuple = ((0, 1.0), (30, 0.8), (60, 0.5), (90, 0.25))
    base: float = 40.0
    points: dict = field(default_factory=lambda: {"location": 35.0, "place": 18.0, "channel": 8.0, "time": 7.0, "people": 12.0, "breeding": 5.0})


RULES = Rules()


# -- adapters ---------------------------------------------------------------------------------------------


def trust(source: Column, rules: Rules = RULES) -> Column:
    """How far a source is trusted."""
    table = F.create_map(*[F.lit(x) for pair in rules.trusted.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(rules.default_trust))


def event_confidence(rules: Rules = RULES) -> Column:
    """The best source's trust, two points for each further source and one for each of four things that are known."""
    known = [labels.filled(F.col("date")) & labels.filled(F.col("location")) & labels.filled(F.col("channel")), labels.filled(F.col("time")), labels.filled(F.col("breeding")), F.coalesce(F.size("participants"), F.lit(0)) > 0]
    best = F.coalesce(F.array_max(F.transform("sources", lambda s: trust(s, rules))), F.lit(0))
    more = F.greatest(F.lit(0), F.size("sources") - 1) * 2
    return F.least(F.lit(100), best + more + sum((k.cast("int") for k in known[1:]), known[0].cast("int"))).cast("int")


def adapted(df: DataFrame, source: str | Column, forced: dict[str, Column] | None = None, fetched: str = "fetchedAt", rules: Rules = RULES) -> DataFrame:
    """A feed's rows as records: ``rec, rank, seq`` pass as they are, all else is brought to the columns of ``EVENT``.

    ``forced`` replaces raw columns first (a feed's channel, a place taken from the name, programmes). Raw columns a feed lacks are null.
    Nulls and empty texts get the defaults of their column; a row without a date keeps none and matches nothing.
    """
    have = {c: F.col(c) for c in df.columns} | (forced or {})
    raw = lambda c, t="string": (have[c] if c in have else F.lit(None)).cast(t)
    name = source if isinstance(source, Column) else F.lit(source)
    own = df.select("rec", "rank", "seq", name.alias("source_"), *[raw(c).alias(c) for c in ("id", "date", "time", "channel", "location", "type", "contentType", "breeding", "name", "title", "image", "eventUrl", "sourceUrl", "sourceText")],
                    raw("participants", "array<string>").alias("participants"), *[raw(c, "boolean").alias(c) for c in ("deferred", "televised", "televisionUnconfirmed")], raw(fetched).alias("at_"))
    programme = F.coalesce(F.col("contentType") == "programa", F.lit(False)) | (labels.type_name(F.col("type")) == "Programa taurino")
    people = F.transform(F.array_compact(F.coalesce("participants", F.array().cast("array<string>"))), labels.cleaned_name)
    people = F.array_distinct(F.filter(people, lambda p: (p != "") & (F.length(p) <= 90) & ~p.rlike(labels.NO_PERSON)))
    channel, url = first_filled(F.col("channel"), F.col("source_")), first_filled(F.col("sourceUrl"), F.col("eventUrl"))
    out = own.select(
        "rec", "rank", "seq", F.nullif("id", F.lit("")).alias("id"), F.nullif("date", F.lit("")).alias("date"), F.nullif("time", F.lit("")).alias("time"), labels.channel_name(channel).alias("channel"),
        labels.deferred(F.col("deferred"), [F.col(c) for c in ("sourceText", "title", "name", "type", "channel")]).alias("deferred"),
        (F.coalesce(F.col("televised"), F.lit(True)) & ~labels.no_channel(channel)).alias("televised"),
        (~F.coalesce(F.col("televised"), F.lit(False)) & F.coalesce(F.col("televisionUnconfirmed"), F.lit(False))).alias("televisionUnconfirmed"),
        labels.cleaned_name(first_filled(F.col("location"), F.col("name"), F.lit("Televisión"))).alias("location"),
        F.when(programme, "Programa taurino").otherwise(labels.type_name(F.col("type"))).alias("type"), F.when(programme, "programa").otherwise("festejo").alias("contentType"),
        F.when(programme, "").otherwise(labels.cleaned_breeding(F.col("breeding"))).alias("breeding"), F.when(programme, F.array().cast("array<string>")).otherwise(people).alias("participants"),
        labels.cleaned_name(first_filled(*[F.col(c) for c in ("name", "title", "location", "type")], F.lit("Festejo taurino"))).alias("name"),
        F.when(labels.filled(F.col("title")), labels.cleaned_name(F.col("title"))).alias("title"), F.nullif("image", F.lit("")).alias("image"),
        first_filled(F.col("eventUrl"), F.col("sourceUrl")).alias("eventUrl"), url.alias("sourceUrl"), F.array("source_").alias("sources"),
        F.array(F.struct(F.col("source_").alias("name"), trust(F.col("source_"), rules).cast("int").alias("confidence"), url.alias("sourceUrl"), F.col("at_").alias("fetchedAt"))).alias("sourceDetails"),
    )
    out = out.withColumn("confidence", event_confidence(rules))
    return out.withColumn("status", F.when(F.col("confidence") >= rules.confirmed, "confirmed").otherwise("probable"))


def programmes(source: str) -> dict[str, Column]:
    """What a feed of programmes forces: kind, place, name and title; for ``adapted``."""
    named = first_filled(F.col("title"), F.col("name"), F.lit("Programa taurino"))
    return {
        "channel": first_filled(F.col("channel"), F.lit(source)), "location": first_filled(F.col("location"), F.lit("Televisión")), "type": F.lit("Programa taurino"),
        "contentType": F.lit("programa"), "name": named, "title": named, "breeding": F.lit(""), "participants": F.array().cast("array<string>"),
    }


def historical(events: DataFrame, as_of: str, rank: int = -1) -> DataFrame:
    """Merged events of an earlier run whose day is over, as the first records of the next run; they keep confidence, status and sources."""
    past = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("date") < as_of)
    return events.where(past).select("rec", F.lit(rank).alias("rank"), "seq", *EVENT)


def quarantined(records: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records that may be merged, and how many of each source in quarantine were left out."""
    held = F.arrays_overlap("sources", F.array(*map(F.lit, sources))) if sources else F.lit(False)
    return records.where(~held), records.where(held).groupBy(F.col("sources")[0].alias("source")).agg(F.count("*").alias("n"))


def excluded(records: DataFrame, *conditions: Column) -> DataFrame:
    """The records that meet none of the conditions; a condition that is null isn't met."""
    for c in conditions:
        records = records.where(~F.coalesce(c, F.lit(False)))
    return records


# -- scores -------------------------------------------------------------------------------------------------


def score_keys(df: DataFrame) -> DataFrame:
    """The records with what a score needs of each, worked out once a record and not once a pair; for ``match_score`` with ``keyed``."""
    c = F.col
    label = first_filled(c("location"), c("name"))
    names = F.array_distinct(F.filter(F.transform(F.coalesce(c("participants"), F.array().cast("array<string>")), normalized), lambda n: n != ""))
    return df.select(
        "rec", "date", "time", "contentType", places.canonical_place(label).alias("key_"), places.match_place(label).alias("match_"), places.generic_label(label).alias("unsaid_"),
        labels.channel_name(c("channel")).alias("station_"), minutes(c("time")).alias("minute_"), normalized(F.coalesce(c("breeding"), F.lit(""))).alias("herd_"), names.alias("people_"),
        (places.generic_label(c("location")) | places.generic_label(c("name")) | places.generic_label(c("title"))).alias("generic_"), places.generic_listing([c("location"), c("name"), c("title")]).alias("listing_"),
        (~places.generic_label(c("location")) | (F.coalesce(F.size("participants"), F.lit(0)) > 0) | labels.filled(c("breeding"))).alias("detailed_"),
    )


def match_score(a: str, b: str, rules: Rules = RULES, keyed: bool = False) -> Column:
    """The score of two records in columns with the prefixes a and b; the first decisive agreement counts, else points per field. ``keyed``: both have ``score_keys``."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    label = lambda s: first_filled(s("location"), s("name"))
    text = lambda s: normalized(F.coalesce(s("breeding"), F.lit("")))
    names = lambda s: F.array_distinct(F.filter(F.transform(F.coalesce(s("participants"), F.array().cast("array<string>")), normalized), lambda n: n != ""))
    timed = lambda s: labels.filled(s("time"))
    generic = lambda s: places.generic_label(s("location")) | places.generic_label(s("name")) | places.generic_label(s("title"))
    listing = lambda s: places.generic_listing([s("location"), s("name"), s("title")])
    detailed = lambda s: ~places.generic_label(s("location")) | (F.coalesce(F.size(s("participants")), F.lit(0)) > 0) | labels.filled(s("breeding"))
    station, key, match = (lambda s: labels.channel_name(s("channel"))), (lambda s: places.canonical_place(label(s))), (lambda s: places.match_place(label(s)))
    unsaid, minute = (lambda s: places.generic_label(label(s))), (lambda s: minutes(s("time")))
    if keyed:
        generic, listing, detailed, station, key, match, unsaid, minute, text, names = ((lambda s, c=c: s(c)) for c in ("generic_", "listing_", "detailed_", "station_", "key_", "match_", "unsaid_", "minute_", "herd_", "people_"))
    channel = station(x) == station(y)
    alike, key_a, key_b = fuzzy(match(x), match(y)), key(x), key(y)
    place = (key_a == key_b) & (key_a != "")
    conflict = (key_a != "") & (key_b != "") & ~unsaid(x) & ~unsaid(y) & (key_a != key_b) & (alike < rules.other_place)
    people, breeding = share_of_smaller(names(x), names(y)), fuzzy(text(x), text(y))
    near = closeness(minute(x), minute(y), list(rules.time_steps))
    exact, one_missing = timed(x) & (x("time") == y("time")), timed(x) != timed(y)
    same = (people >= rules.same_people) | (breeding >= rules.same_breeding)
    close = near >= rules.close_time
    event = x("contentType") == "festejo"
    p = rules.points
    sum_ = rules.base + alike * p["location"] + F.when(place, p["place"]).otherwise(0.0) + F.when(channel, p["channel"]).otherwise(0.0) + near * p["time"] + people * p["people"] + breeding * p["breeding"]
    apart = (x("date") != y("date")) | (x("contentType") != y("contentType"))
    return (
        F.when(F.coalesce(apart, F.lit(True)) | (x("date") == ""), 0.0).when(conflict, 0.0)
        .when(event & place & (people >= rules.same_people), 98.0).when(event & place & (breeding >= rules.same_breeding), 94.0)
        .when(event & channel & exact & (generic(x) | generic(y)) & same, 96.0).when(event & channel & close & (listing(x) != listing(y)), 97.0)
        .when(event & channel & close & ((generic(x) & detailed(y)) | (generic(y) & detailed(x))) & (same | (alike >= rules.same_place)), 94.0)
        .when(event & channel & one_missing & (alike >= rules.same_place), 88.0).otherwise(rounded(sum_, 2))
    )


_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _plain(text: str | None) -> str:
    return " ".join(_WORD.findall(_MARKS.sub("", unicodedata.normalize("NFD", text or "")).lower()))


@lru_cache(maxsize=100_000)
def _edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@lru_cache(maxsize=100_000)
def _words(text: str) -> frozenset[str]:
    return frozenset(w for w in text.split() if len(w) > 1)


def _shared(a: str, b: str) -> float:
    """Common words of more than a letter over the larger set."""
    x, y = _words(a), _words(b)
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def _fuzzy(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(_shared(a, b), 1 - _edits(a, b) / max(len(a), len(b)))


def _generic(text: str | None) -> bool:
    return _plain(text) in ("", *places.GENERIC)


_listing = re.compile(places.LISTING)


class _Side:
    """What a score needs of a record, worked out once."""

    def __init__(self, e: dict) -> None:
        texts = [_plain(e[c]) for c in ("location", "name", "title")]
        self.channel, self.place, self.match, self.minute = e["channel_"], e["place_"], e["match_"], e["minute_"]
        self.label = e["location"] or e["name"]
        self.people = {p for p in map(_plain, e["participants"]) if p}
        self.breeding, self.time = _plain(e["breeding"]), e["time"] or ""
        self.generic = any(_generic(t) for t in texts)
        self.listing = any(t and (_generic(t) or _listing.match(t)) for t in texts)
        self.detailed = bool(e["participants"] or e["breeding"] or not _generic(e["location"]))


def _score(a: _Side, b: _Side, event: bool, rules: Rules) -> float:
    alike, place = _fuzzy(a.match, b.match), a.place != "" and a.place == b.place
    if a.place and b.place and not place and not _generic(a.label) and not _generic(b.label) and alike < rules.other_place:
        return 0.0
    people = len(a.people & b.people) / min(len(a.people), len(b.people)) if a.people and b.people else 0.0
    breeding, channel = _fuzzy(a.breeding, b.breeding), a.channel == b.channel
    near = 0.0 if a.minute is None or b.minute is None else next((v for most, v in rules.time_steps if abs(a.minute - b.minute) <= most), 0.0)
    same, close = people >= rules.same_people or breeding >= rules.same_breeding, near >= rules.close_time
    rungs = [
        (98.0, place and people >= rules.same_people), (94.0, place and breeding >= rules.same_breeding),
        (96.0, channel and a.time != "" and a.time == b.time and (a.generic or b.generic) and same), (97.0, channel and close and a.listing != b.listing),
        (94.0, channel and close and (a.generic and b.detailed or b.generic and a.detailed) and (same or alike >= rules.same_place)),
        (88.0, channel and (a.time == "") != (b.time == "") and alike >= rules.same_place),
    ]
    decided = next((value for value, holds in rungs if holds), None) if event else None
    if decided is not None:
        return decided
    p = rules.points
    total = rules.base + alike * p["location"] + place * p["place"] + channel * p["channel"] + near * p["time"] + people * p["people"] + breeding * p["breeding"]
    return float(int(total * 100 + 0.5)) / 100


# -- survivorship -------------------------------------------------------------------------------------------


def _either(a, b, second: bool):
    """The value that is there, then the preferred one."""
    there = [v for v in ((b, a) if second else (a, b)) if v is not None and v != ""]
    return there[0] if there else (a if a is not None else b)


def _telling(a, b, second: bool):
    """The value that is there, then the one that isn't generic, then the preferred one."""
    if a and b and _generic(a) != _generic(b):
        return b if _generic(a) else a
    return _either(a, b, second)


def _information(e: dict) -> int:
    said = lambda c: bool(e[c]) and not _generic(e[c])
    return (
        4 * bool(e["time"]) + 8 * said("location") + 8 * said("name") + 5 * said("title") + 3 * (bool(e["type"]) and e["type"] != "Festejo taurino")
        + 4 * bool(e["breeding"]) + min(8, 2 * len(e["participants"])) + bool(e["eventUrl"] or e["sourceUrl"])
    )


def _merged(a: dict, b: dict, rules: Rules) -> dict:
    """Two records of one event as one."""
    trusted = lambda e: rules.trusted.get(e["sources"][0] if e["sources"] else "", rules.default_trust)
    second = (_information(b), trusted(b)) > (_information(a), trusted(a))
    out = {c: _either(a[c], b[c], second) for c in ("id", "date", "time", "image", "eventUrl", "sourceUrl", "channel")}
    none = [_plain(e["channel"]) in ("", *labels.NO_CHANNEL) for e in (a, b)]
    if none[0] != none[1]:
        out["channel"] = b["channel"] if none[0] else a["channel"]
    shown = _plain(out["channel"]) not in ("", *labels.NO_CHANNEL)
    out |= {c: _telling(a[c], b[c], second) for c in ("location", "type", "breeding", "name", "title")}
    people = list(a["participants"])
    for p in b["participants"]:
        if all(_shared(_plain(kept), _plain(p)) < rules.similar_names for kept in people):
            people.append(p)
    official = next((e for e in (a, b) if rules.official in e["sources"]), None)
    if official:
        out["breeding"], people = official["breeding"], list(official["participants"])
    details: dict[str, dict] = {}
    for d in [*a["sourceDetails"], *b["sourceDetails"]]:
        if d["name"] not in details or d["confidence"] > details[d["name"]]["confidence"]:
            details[d["name"]] = d
    out |= {
        "deferred": bool(a["deferred"] or b["deferred"]), "televised": shown, "televisionUnconfirmed": not shown and bool(a["televisionUnconfirmed"] or b["televisionUnconfirmed"]),
        "contentType": a["contentType"], "participants": people, "sources": list(dict.fromkeys([*a["sources"], *b["sources"]])), "sourceDetails": list(details.values()),
    }
    known = [out["date"] and out["location"] and out["channel"], out["time"], out["breeding"], people]
    best = max((rules.trusted.get(s, rules.default_trust) for s in out["sources"]), default=0)
    out["confidence"] = min(100, best + 2 * max(0, len(out["sources"]) - 1) + sum(map(bool, known)))
    out["status"] = "confirmed" if out["confidence"] >= rules.confirmed else "probable"
    if out["contentType"] == "festejo" and out["location"] and not _generic(out["location"]):
        out["title"] = None
    # the keys go with the values they belong to
    for key, of in (("place_", "location"), ("match_", "location"), ("channel_", "channel"), ("minute_", "time")):
        out[key] = a[key] if out[of] == a[of] else b[key]
    return out


# -- the fold -----------------------------------------------------------------------------------------------

#: Records of a (date, content type) from which the block is split by places that exclude each other; records of one call, on average.
LARGE, PER_CALL = 5_000, 1_000
#: Large blocks (a date and a content type each) up to which their list is broadcast.
BROADCAST_BLOCKS = 100_000
_KEYS = "place_ string, match_ string, channel_ string, minute_ int"


#: Texts of a block whose similarities to all others are kept at a time; the others' are worked out again.
KEPT_TEXTS = 2_000
#: Pairs of texts that are compared in one step.
PAIRS_AT_ONCE = 50_000
_FOLDED = "rec string, cluster string, score double, rank int, seq bigint"


class _Texts:
    """The distinct texts of a block, numbered, and the ``_fuzzy`` of one to all the others."""

    def __init__(self, texts: Iterable[str]) -> None:
        self.texts = sorted(set(texts), key=len, reverse=True)
        self.number = {t: i for i, t in enumerate(self.texts)}
        self.rows: dict[int, np.ndarray] = {}
        self.lengths = np.array([len(t) for t in self.texts])
        self.letters = {c: i for i, c in enumerate(sorted({c for t in self.texts for c in t}))}
        # the letters by place; at each place only the texts that reach it, which are the first ones
        reach = [int((self.lengths > k).sum()) for k in range(self.lengths[0] if len(self.texts) else 0)]
        self.places = [np.array([self.letters[t[k]] for t in self.texts[:n]]) for k, n in enumerate(reach)]
        self.words = [{w for w in t.split() if len(w) > 1} for t in self.texts]
        self.n_words = np.array([len(w) for w in self.words])
        self.having: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            for w in ws:
                self.having.setdefault(w, []).append(i)

    def edits(self, first: int, last: int) -> np.ndarray:
        """The edit distances of some of the texts to all, at once: a bit for each letter (a text of more than 64 is compared by itself)."""
        own = self.lengths[first:last]
        bits = (own > 0) & (own <= 64)
        one, masks = np.uint64(1), np.zeros((last - first, len(self.letters)), dtype=np.uint64)
        for k in np.flatnonzero(bits):
            for b, c in enumerate(self.texts[first + k]):
                masks[k, self.letters[c]] |= np.uint64(1 << b)
        top = np.where(bits, one << np.maximum(own - 1, 0).astype(np.uint64) % np.uint64(64), np.uint64(0))[:, None]
        out = np.repeat(own[:, None], len(self.texts), axis=1)
        more, less = np.full(out.shape, ~np.uint64(0)), np.zeros(out.shape, dtype=np.uint64)
        for letters in self.places:
            n = len(letters)
            more, less, equal = more[:, :n], less[:, :n], masks[:, letters]
            down = equal | less
            across = (((equal & more) + more) ^ more) | equal
            up, fall = less | ~(across | more), more & across
            out[:, :n] += (up & top) != 0
            out[:, :n] -= (fall & top) != 0
            up = (up << one) | one
            more, less = (fall << one) | ~(down | up), up & down
        for k in np.flatnonzero(own > 64):
            out[k] = [_edits(self.texts[first + k], t) for t in self.texts]
        return out

    def to(self, i: int) -> np.ndarray:
        if i not in self.rows:
            # so many at a time that a step's arrays stay small; one by one where not all are kept
            n = len(self.texts)
            at_once = 1 if n > KEPT_TEXTS else max(1, PAIRS_AT_ONCE // n)
            first = i // at_once * at_once
            last = min(n, first + at_once)
            edits = self.edits(first, last)
            for k in range(first, last):
                if len(self.rows) >= KEPT_TEXTS:
                    self.rows.pop(next(iter(self.rows)))
                self.rows[k] = self._alike(k, edits[k - first])
        return self.rows[i]

    def _alike(self, i: int, edits: np.ndarray) -> np.ndarray:
        if not self.texts[i]:
            return np.zeros(len(self.texts))
        shared = np.zeros(len(self.texts))
        for w in self.words[i]:
            shared[self.having[w]] += 1
        shared = shared / np.maximum(1, np.maximum(len(self.words[i]), self.n_words))
        out = np.where(self.lengths > 0, np.maximum(shared, 1 - edits / np.maximum(self.lengths[i], self.lengths)), 0.0)
        out[i] = 1.0
        return out


class _Kept:
    """The events of a block so far as columns, and the score of the next record against all of them at once: that of ``_score``."""

    _KINDS = {"place": np.int32, "match": np.int32, "herd": np.int32, "channel": np.int32, "time": np.int32, "minute": np.float64, "n_people": np.int32, "unsaid": bool, "generic": bool, "listing": bool, "detailed": bool}

    def __init__(self, sides: list[_Side], event: bool, rules: Rules) -> None:
        self.rules, self.event, self.n = rules, event, 0
        self.matches, self.herds = _Texts(s.match for s in sides), _Texts(s.breeding for s in sides)
        self.numbers: dict[str, dict] = {"place": {"": 0}, "channel": {}, "time": {"": 0}}
        self.c = {k: np.zeros(len(sides), dtype=t) for k, t in self._KINDS.items()}
        self.sides: list[_Side] = []
        self.having: dict[str, set[int]] = {}

    def _values(self, s: _Side) -> dict:
        number = lambda k, v: self.numbers[k].setdefault(v, len(self.numbers[k]))
        return {
            "place": number("place", s.place), "match": self.matches.number[s.match], "herd": self.herds.number[s.breeding], "channel": number("channel", s.channel), "time": number("time", s.time),
            "minute": np.nan if s.minute is None else s.minute, "n_people": len(s.people), "unsaid": _generic(s.label), "generic": s.generic, "listing": s.listing, "detailed": s.detailed,
        }

    def put(self, s: _Side, i: int | None = None) -> None:
        """Adds an event, or replaces the one with the number."""
        if i is None:
            i, self.n = self.n, self.n + 1
            self.sides.append(s)
        else:
            for p in self.sides[i].people - s.people:
                self.having[p].discard(i)
            self.sides[i] = s
        for p in s.people:
            self.having.setdefault(p, set()).add(i)
        for k, v in self._values(s).items():
            self.c[k][i] = v

    def best(self, s: _Side) -> tuple[float, int]:
        """The best score and the oldest event that has it; 0 and -1 if all are excluded."""
        if not self.n:
            return 0.0, -1
        v, r = self._values(s), self.rules
        all_ = {k: a[: self.n] for k, a in self.c.items()}
        alike = self.matches.to(v["match"])[all_["match"]]
        same_place = all_["place"] == v["place"]
        if v["place"] and not v["unsaid"]:
            at = np.flatnonzero(same_place | (alike >= r.other_place) | all_["unsaid"] | (all_["place"] == 0))
        else:
            at = np.arange(self.n)
        if not len(at):
            return 0.0, -1
        o = {k: a[at] for k, a in all_.items()}
        alike, place = alike[at], same_place[at] & (v["place"] != 0)
        people = np.zeros(self.n)
        for p in s.people:
            if i := self.having.get(p):
                people[np.fromiter(i, dtype=np.int64, count=len(i))] += 1
        people = people[at] / np.maximum(1, np.minimum(v["n_people"], o["n_people"]))
        breeding, channel = self.herds.to(v["herd"])[o["herd"]], o["channel"] == v["channel"]
        near = np.zeros(len(at))
        gap = np.abs(o["minute"] - v["minute"])
        for most, value in reversed(r.time_steps):
            near[gap <= most] = value
        p = r.points
        total = r.base + alike * p["location"] + place * p["place"] + channel * p["channel"] + near * p["time"] + people * p["people"] + breeding * p["breeding"]
        score = np.floor(total * 100 + 0.5) / 100
        if self.event:
            same, close = (people >= r.same_people) | (breeding >= r.same_breeding), channel & (near >= r.close_time)
            told = (o["generic"] & v["detailed"]) | (o["detailed"] & v["generic"])
            for value, holds in (
                (88.0, channel & ((o["time"] == 0) != (v["time"] == 0)) & (alike >= r.same_place)), (94.0, close & told & (same | (alike >= r.same_place))),
                (97.0, close & (o["listing"] != v["listing"])), (96.0, channel & (v["time"] != 0) & (o["time"] == v["time"]) & (o["generic"] | v["generic"]) & same),
                (94.0, place & (breeding >= r.same_breeding)), (98.0, place & (people >= r.same_people)),
            ):
                score[holds] = value
        k = int(score.argmax())
        return float(score[k]), int(at[k])


def _fold(rules: Rules, columns: tuple[str, ...], schema: str):
    own = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        # several blocks come in one call, for its fixed cost; each is folded on its own
        blocks: dict[tuple, list[dict]] = {}
        for row in table.to_pylist():
            blocks.setdefault((row["date"], row["contentType"], row["part_"]), []).append(row)
        out = [row for rows in blocks.values() for row in block(rows)]
        return pa.Table.from_arrays([pa.array(values, type=f.type) for f, values in zip(own, zip(*out, strict=True), strict=True)], schema=own)

    def block(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in ("rank", "seq", "rec")))
        for e in rows:
            for c in ("participants", "sources", "sourceDetails"):
                e[c] = e[c] or []
        sides = [_Side(e) for e in rows]
        kept: list[tuple[dict, str]] = []
        columns_ = _Kept(sides, rows[0]["contentType"] == "festejo", rules)
        out = []
        for e, side in zip(rows, sides, strict=True):
            best, at = columns_.best(side)
            if at >= 0 and best >= rules.least[e["contentType"]]:
                one = _merged(kept[at][0], e, rules)
                kept[at] = (one, kept[at][1])
                columns_.put(_Side(one), at)
                out.append((e["rec"], kept[at][1], best))
            else:
                kept.append((e, e["rec"]))
                columns_.put(side)
                out.append((e["rec"], e["rec"], best))
        heads = {rec: e for e, rec in kept}
        firsts = {e["rec"]: (e["rank"], e["seq"]) for e in rows}
        none = (None,) * len(columns)
        return [(*o, *firsts[o[1]], *(tuple(heads[o[0]][c] for c in columns) if o[0] == o[1] else none)) for o in out]

    return run


def _split(records: DataFrame, sizes: DataFrame, rules: Rules, large: int) -> DataFrame:
    """The records with ``part_``: 0, or in large blocks the number of their group of places that no match crosses.

    Two places exclude each other unless their keys are equal or their names alike; a merged record has one of its members' places. So groups of places
    linked by pairs that don't exclude each other can be folded apart. A block with a generic label, which matches any place, stays whole.
    """
    size = sizes.where(F.col("n") > large).select("date", "contentType")
    if size.isEmpty():
        return records.withColumn("part_", F.lit(0).cast("bigint"))
    label = first_filled(F.col("location"), F.col("name"))
    size = F.broadcast(size) if size.count() <= BROADCAST_BLOCKS else size
    said = records.join(size, ["date", "contentType"], "left_semi").groupBy("date", "contentType", "place_", "match_").agg(F.max(places.generic_label(label) | (F.col("place_") == "")).alias("any_"))
    bridged = said.where("any_").select("date", "contentType").distinct()
    nodes = cut(said.join(bridged, ["date", "contentType"], "left_anti").select("date", "contentType", "place_", "match_", F.xxhash64("place_", "match_").alias("node")))
    x, y = (nodes.select("date", "contentType", *[F.col(c).alias(f"{c}{s}") for c in ("place_", "match_", "node")]) for s in "ab")
    alike = (F.col("place_a") == F.col("place_b")) | (fuzzy(F.col("match_a"), F.col("match_b")) >= rules.other_place)
    edges = cut(x.join(y, ["date", "contentType"]).where(alike).select("date", "contentType", F.col("nodea").alias("node"), F.col("nodeb").alias("other")))
    parts = cut(nodes.select("date", "contentType", "node", F.col("node").alias("part")))
    while True:
        near = edges.join(parts.select("date", "contentType", F.col("node").alias("other"), F.col("part").alias("p")), ["date", "contentType", "other"])
        least = near.groupBy("date", "contentType", "node").agg(F.min("p").alias("least"))
        new = cut(parts.join(least, ["date", "contentType", "node"]).select("date", "contentType", "node", "part", F.least("part", "least").alias("new")))
        parts = new.select("date", "contentType", "node", F.col("new").alias("part"))
        if new.where("new <> part").isEmpty():
            break
    named = nodes.join(parts, ["date", "contentType", "node"]).select("date", "contentType", "place_", "match_", F.col("part").alias("part_"))
    return records.join(named, ["date", "contentType", "place_", "match_"], "left").withColumn("part_", F.coalesce("part_", F.lit(0).cast("bigint")))


def folded(records: DataFrame, rules: Rules = RULES, large: int = LARGE, events: bool = True) -> DataFrame:
    """``(rec, cluster, score, rank, seq, ...)``: each record with the record its event began with, and its best score when it came.

    The rows where ``rec`` is ``cluster`` hold the merged event in the columns of ``EVENT``, on the others these are null; ``rank`` and ``seq`` are the first member's.
    Records without a date or content type begin an event each. Ties in score go to the older event. Order: rank, seq, rec. Without ``events`` only the first five columns come.
    """
    columns = tuple(EVENT) if events else ()
    label = first_filled(F.col("location"), F.col("name"))
    keyed = records.select(
        "rec", "rank", "seq", *EVENT, places.canonical_place(label).alias("place_"), places.match_place(label).alias("match_"),
        labels.channel_name(F.col("channel")).alias("channel_"), minutes(F.col("time")).cast("int").alias("minute_"),
    )
    alone = F.coalesce(F.col("date"), F.lit("")).isin("") | F.col("contentType").isNull()
    single = keyed.where(alone).select("rec", F.col("rec").alias("cluster"), F.lit(0.0).alias("score"), F.col("rank").cast("int"), F.col("seq").cast("bigint"), *columns)
    some = keyed.where(~alone)
    sizes = cut(records.where(~alone).groupBy("date", "contentType").agg(F.count("*").alias("n")))  # one row a block
    calls = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // PER_CALL))
    blocks = _split(some, sizes, rules, large)
    call = F.pmod(F.xxhash64("date", "contentType", "part_"), F.lit(calls)).alias("call_")
    schema = ", ".join([_FOLDED, *[f"{c} {EVENT[c]}" for c in columns]])
    found = blocks.withColumn("call_", call).groupBy("call_").applyInArrow(_fold(rules, columns, schema), schema)
    return found.unionByName(single)


def events_of(fold: DataFrame) -> DataFrame:
    """The merged events of a fold."""
    return fold.where(F.col("rec") == F.col("cluster")).select("rec", "rank", "seq", *EVENT)


def fold_statistics(fold: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, added, merged)``: how many records of each source began an event or joined one; ``sources`` is (rec, source)."""
    return fold.select("rec", "cluster").join(sources, "rec").groupBy("source").agg(
        F.count_if(F.col("rec") == F.col("cluster")).alias("added"), F.count_if(F.col("rec") != F.col("cluster")).alias("merged")
    )


# -- moved events and order ---------------------------------------------------------------------------------


def moved(events: DataFrame, most_days: int = 21, least_people: float = 0.67, least_confidence: int = 95, rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """The events without those that another one replaces, and ``(old, new)``: which replaces which.

    The later event is at the same place within so many days, has enough of the people, the same breeder or all the people, is trusted,
    stands in two sources and says that something has changed. The first such event in order counts; one that is itself replaced may replace.
    """
    own = events.where("contentType = 'festejo' and date is not null").select(
        F.col("rec"), F.struct("rank", "seq", "rec").alias("order_"), places.canonical_place(F.col("location")).alias("place_"), F.datediff(F.try_to_date("date", "yyyy-MM-dd"), F.lit("2000-01-01").cast("date")).alias("day_"),
        F.array_distinct(F.filter(F.transform("participants", normalized), lambda n: n != "")).alias("people_"), normalized(F.col("breeding")).alias("breeding_"),
        ((F.col("confidence") >= least_confidence) & (F.size("sources") >= 2) & labels.moved_signal([F.col(c) for c in ("title", "name", "eventUrl", "sourceUrl")])).alias("sure_"),
    )
    people = share_of_smaller(F.col("a_people_"), F.col("b_people_"))
    same = (people >= least_people) & ((fuzzy(F.col("a_breeding_"), F.col("b_breeding_")) >= rules.same_breeding) | (people == 1.0))
    pairs = close_pairs(own, ["place_"], "day_", "day_", most_days, F.col("b_sure_") & same)
    links = cut(pairs.groupBy(F.col("a_rec").alias("old")).agg(F.min_by("b_rec", "b_order_").alias("new")))
    return events.join(links.select(F.col("old").alias("rec")), "rec", "left_anti"), links


def in_order(events: DataFrame) -> DataFrame:
    """By day, time (missing ones last) and name in Spanish order."""
    return events.orderBy("date", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")), F.collate(F.coalesce(first_filled(F.col("name"), F.col("title")), F.lit("")), "es"), "rank", "seq")
