"""The agenda as it is shown: events of a day, place and kind that share people or a breeder are one, the first match counting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagre.functions import labels, places
from almagre.functions.text import first_filled, normalized
from almagre.operators.merge import PER_CALL, _plain
from almagre.operators.resolution import _alike

#: Columns of an event that is shown, besides rec, rank and seq.
SHOWN = {
    "date": "string", "time": "string", "channel": "string", "televised": "boolean", "location": "string", "type": "string", "contentType": "string",
    "breeding": "string", "participants": "array<string>", "name": "string", "title": "string", "sources": "array<string>",
}
# What makes a label more telling, besides its length.
_TELLING = ((re.compile("plaza de toros", re.I), 30), (re.compile("monumental", re.I), 20), (re.compile(r"\("), 10), (re.compile("españa", re.I), -8))


def _points(label: str) -> int:
    return len(label) + sum(n for pattern, n in _TELLING if pattern.search(label))


def _more_telling(a: str | None, b: str | None) -> str:
    x, y = (a or "").strip(), (b or "").strip()
    return y if not x else x if not y or _points(x) >= _points(y) else y


def _shown(channel: str | None) -> bool:
    return _plain(channel) not in ("", *labels.NOT_SHOWN)


def _joined(a: dict, b: dict) -> dict:
    """Two events as one: the one on television first, what it lacks from the other."""
    on = [e["televised"] is not False and _shown(e["channel"]) for e in (a, b)]
    first, second = (b, a) if on[1] and not on[0] else (a, b)
    real = next((e["channel"] for e in (a, b) if _shown(e["channel"])), first["channel"] or second["channel"])
    return {
        **first, **{c: _more_telling(a[c], b[c]) for c in ("location", "title", "name")}, "time": first["time"] or second["time"] or "", "channel": real, "televised": any(on),
        "breeding": first["breeding"] or second["breeding"] or "", "participants": first["participants"] or second["participants"], "sources": list(dict.fromkeys([*a["sources"], *b["sources"]])),
    }


def deduplicated(events: DataFrame, least_people: float = 0.5, least_breeding: float = 0.72) -> DataFrame:
    """``(rec, cluster, ...)``: each event with the one it is shown as; the rows where both are equal hold what is shown, on the others it is null.

    Programmes, and events without a date or any label for a place, stand alone. An event joins the first one of its day, place (its location, name or
    title) and kind that shares half of the people of the smaller line-up, or whose breeder is alike; order: rank, seq, rec. A merged event is compared with what it then says.
    """
    place = places.shown_place(first_filled(F.col("location"), F.col("name"), F.col("title")))
    kind = F.coalesce(normalized(F.col("type")), F.lit(""))
    keyed = events.select("rec", "rank", "seq", *SHOWN, place.alias("place_"), kind.alias("kind_")).withColumn("breeding", labels.cleaned_breeding(F.col("breeding")))
    alone = F.coalesce(F.col("contentType") == "programa", F.lit(False)) | F.coalesce(F.col("date"), F.lit("")).isin("") | (F.col("place_") == "")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # several blocks come in one call, for its fixed cost; each is folded on its own
        return pd.concat([block(own) for _, own in pdf.groupby(["date", "place_", "kind_"], sort=False)], ignore_index=True)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        out = []
        for row in pdf.sort_values(["rank", "seq", "rec"]).to_dict("records"):
            e = {c: row[c] for c in ("rec", *SHOWN)}
            e["participants"], e["sources"] = (list(e[c]) if e[c] is not None else [] for c in ("participants", "sources"))
            people, breeding = {p for p in map(_plain, e["participants"]) if p}, _plain(e["breeding"])
            for i, k in enumerate(kept):
                other = {p for p in map(_plain, k["participants"]) if p}
                if (people and other and len(people & other) / min(len(people), len(other)) >= least_people) or _alike(breeding, _plain(k["breeding"])) >= least_breeding:
                    kept[i] = {**_joined(k, e), "rec": k["rec"]}
                    out.append((e["rec"], k["rec"]))
                    break
            else:
                kept.append(e)
                out.append((e["rec"], e["rec"]))
        heads = {k["rec"]: k for k in kept}
        return pd.DataFrame([[rec, c, *[heads[rec][f] if rec == c else None for f in SHOWN]] for rec, c in out], columns=["rec", "cluster", *SHOWN])

    schema = "rec string, cluster string, " + ", ".join(f"{c} {t}" for c, t in SHOWN.items())
    calls = max(1, -(-events.count() // PER_CALL))
    call = F.pmod(F.xxhash64("date", "place_", "kind_"), F.lit(calls)).alias("call_")
    folded = keyed.where(~alone).withColumn("call_", call).groupBy("call_").applyInPandas(fold, schema)
    return folded.unionByName(keyed.where(alone).select("rec", F.col("rec").alias("cluster"), *SHOWN))
