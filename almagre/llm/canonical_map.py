"""Mapping free-entered values to a canonical list: token-level repair and soft TF-IDF.

Distinct values are folded and cut into tokens; each distinct token is joined to the reference vocabulary by edit
distance (through shared deletions) or as an abbreviation. The repaired tokens are combined per entry with
soft TF-IDF weights; the best entry that passes the field's thresholds is the value's meaning.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagre.llm.consistent_form import folded
from almagre.session import cut

# Function words, which carry no weight.
STOP = frozenset("a al d de del e el en la las lo los o para por y".split())

_initials = re.compile(r"\b(?:[a-z]\.){2,}")
_token = re.compile(r"[a-z0-9]+\.?")
_vowel = re.compile(r"[aeiou]")


@dataclass(frozen=True)
class Rules:
    """How a field's values are read.

    ``noise``: what is cut away before matching; ``separator``: between two entries named in one value;
    ``parts``: labels "Town (Province)" may also be meant by the town alone or with a shortened province;
    ``least_score``: soft TF-IDF cosine; ``least_value`` and ``least_entry``: the share of
    the value's and the entry's weight that must be matched at all.
    """

    noise: str = ""
    separator: str = ""
    parts: bool = False
    least_score: float = 0.55
    least_value: float = 0.0
    least_entry: float = 0.45


def bare(text: str) -> str:
    """Folded and without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", folded(text)) if not unicodedata.combining(c))


def tokens_of(text: str) -> list[str]:
    """The tokens of a bare text; abbreviations keep their full stop, initials are joined."""
    text = _initials.sub(lambda m: m.group().replace(".", "") + " ", text)
    out = []
    for t in _token.findall(text):
        if len(t) == 1 and t not in STOP:
            t += "."
        if t.rstrip(".") in STOP:
            continue
        out.append(t)
    return out


def _segments(rules: dict[str, Rules]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = {k: (re.compile(r.noise or r"(?!)"), re.compile(r.separator or r"(?!)")) for k, r in rules.items()}
        for batch in batches:
            rows = []
            for kind, value in zip(batch["kind"], batch["value"], strict=True):
                noise, separator = patterns[kind]
                for seg, part in enumerate(separator.split(noise.sub(" ", bare(value)))):
                    words = tokens_of(part)
                    rows += [(kind, value, seg, [i], t, near_stop(t)) for i, t in enumerate(words)]
                    rows += [(kind, value, seg, [i, i + 1], a + b, False) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["kind", "value", "seg", "at_value", "token", "light"])

    return run


def _forms(rules: dict[str, Rules]):
    """Each way an entry may be written, with its plain and run-together tokens and the positions they cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, ref, label, aka in zip(batch["kind"], batch["ref_id"], batch["label"], batch["aka"], strict=True):
                own, other = tokens_of(bare(label)), tokens_of(bare(aka)) if aka else []
                town, _, rest = bare(label).partition("(")
                forms = [own, other, own + other]
                if rules[kind].parts and rest:
                    forms += [tokens_of(town) + tokens_of(rest)[:1], tokens_of(town)]
                for f, words in enumerate(forms):
                    if not words or words in forms[:f]:
                        continue
                    words = [w.rstrip(".") for w in words]
                    rows += [
                        (kind, ref, f, "".join(words[i : i + n]), list(range(i, i + n)), n == 1)
                        for n in (1, 2, 3)
                        for i in range(len(words) - n + 1)
                    ]
            yield pd.DataFrame(rows, columns=["kind", "ref_id", "form", "word", "covers", "plain"])

    return run


def near_stop(token: str) -> bool:
    """Whether an otherwise unknown token is a function word with a slip."""
    return len(token) <= 4 and any(len(s) > 1 and edit_distance(token, s, 1) <= 1 for s in STOP)


#: Letters of a word up to which it is found by its deletions; a longer one is found by a piece that no edit touches.
LONGEST = 64
#: Edits of the longest words, and pieces of a long one: two edits, exchanged neighbours on a border included, touch four at most.
EDITS, PIECES = 2, 5


def most_edits(length: int) -> int:
    """The edits a reference token of so many letters may be repaired by."""
    return 0 if length < 3 else 1 if length < 10 else EDITS


def _deletions(token: str, edits: int) -> set[str]:
    out = {token}
    for _ in range(edits):
        out |= {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out


def _cuts(length: int) -> list[int]:
    return [length * i // PIECES for i in range(PIECES + 1)]


def _word_keys(word: str) -> set[str]:
    """What a reference word shares with every token it may repair."""
    if len(word) <= LONGEST:
        return _deletions(word, most_edits(len(word)))
    cuts = _cuts(len(word))
    return {f"{len(word)}:{i}:{xxhash.xxh64_hexdigest(word[cuts[i] : cuts[i + 1]])}" for i in range(PIECES)}


def _token_keys(token: str) -> set[str]:
    """What a token shares with every reference word that may repair it; linear in its length."""
    out = _deletions(token, most_edits(min(len(token) + 1, LONGEST))) if len(token) <= LONGEST + EDITS else set()
    for length in range(max(LONGEST + 1, len(token) - EDITS), len(token) + EDITS + 1):
        cuts = _cuts(length)
        for i in range(PIECES):
            n = cuts[i + 1] - cuts[i]
            for at in range(max(0, cuts[i] - EDITS), min(len(token) - n, cuts[i] + EDITS) + 1):
                out.add(f"{length}:{i}:{xxhash.xxh64_hexdigest(token[at : at + n])}")
    return out


def _with_keys(keys):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, x) for t in batch["token"] for x in keys(t)], columns=["token", "rest"])

    return run


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits, with exchanged neighbours as one, or ``most + 1`` where there are more; only the diagonals within ``most`` are filled."""
    over = most + 1
    if abs(len(a) - len(b)) > most:
        return over
    before: list[int] | None = None
    last = [min(j, over) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [over] * (len(b) + 1)
        row[0] = min(i, over)
        for j in range(low, high + 1):
            y = b[j - 1]
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, over)
        if min(row[low - 1 : high + 1]) > most:
            return over
        before, last = last, row
    return last[-1]


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t, w in zip(batch["token"], batch["word"], strict=True):
            most = most_edits(len(w)) if _vowel.search(w) else 0  # an acronym isn't repaired
            d = edit_distance(t, w, most)
            if d <= most:
                rows.append((t, w, 1 - 0.2 * d))
        yield pd.DataFrame(rows, columns=["token", "word", "sim"])


def _abbreviates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t, w in zip(batch["token"], batch["word"], strict=True):
            short, rest = t.rstrip("."), iter(w)
            if len(short) < len(w) and _vowel.search(w) and (w.startswith(short) if t.endswith(".") and _vowel.search(short) else all(c in rest for c in short)):
                rows.append((t, w, 0.9))
        yield pd.DataFrame(rows, columns=["token", "word", "sim"])


def repaired_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(kind, token, word, sim)``: the reference words each distinct token may stand for; tokens and words are distinct per kind."""
    schema = "token string, word string, sim double"
    short = tokens.where(F.col("token").endswith(".") | (~F.col("token").rlike("[aeiou]") & (F.length("token") <= 4)))
    same = tokens.join(words.select("word").distinct(), F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("sim"))
    long = tokens.where(~F.col("token").endswith(".") & ~F.col("token").rlike("^[0-9]+$")).select("token").distinct()
    deleted = long.mapInPandas(_with_keys(_token_keys), "token string, rest string")
    kept = words.select(F.col("word").alias("token")).distinct().mapInPandas(_with_keys(_word_keys), "token string, rest string")
    near = (
        deleted.join(kept.withColumnRenamed("token", "word"), "rest")
        .where(F.col("token") != F.col("word")).select("token", "word").distinct()
        .mapInPandas(_edits, schema)
    )
    # run-together words aren't abbreviated
    abbreviated = (
        short.select("token", F.substring("token", 1, 1).alias("c")).distinct()
        .join(words.where("plain").select("word", F.substring("word", 1, 1).alias("c")).distinct(), "c")
        .select("token", "word").mapInPandas(_abbreviates, schema)
    )
    return same.unionByName(near).unionByName(abbreviated).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def _best_entries(rules: dict[str, Rules]):
    """For a batch of values with all their hits: the best entry of each segment by soft TF-IDF."""

    def run(hits: pd.DataFrame) -> pd.DataFrame:
        key = ["kind", "value", "seg", "ref_id", "form"]
        hits = hits.assign(sw=hits["sim"] * hits["w"], place=hits["at_value"].map(tuple))
        # value side: a token that covers several words weighs as all of them, spread over its places
        word = hits.groupby([*key, "place", "word"], sort=False).agg(sw=("sw", "sum"), w=("w", "sum"), light=("light", "first")).reset_index()
        token = word.sort_values("sw").groupby([*key, "place"], sort=False).last().reset_index()
        n = token["place"].map(len)
        token = token.assign(sw=token["sw"] / n, w=token["w"] / n, known=~token["light"]).explode("place")
        placed = token.sort_values("sw").groupby([*key, "place"], sort=False).last().reset_index()
        value = placed.groupby(key, sort=False).agg(value_sim=("sw", "sum"), value_hit=("w", "sum"), known=("known", "sum"))
        # entry side: each of its words counts once
        entry = hits.groupby([*key, "at"], sort=False).agg(sw=("sw", "max"), w=("w", "max")).reset_index()
        entry = entry.groupby(key, sort=False).agg(entry_sim=("sw", "sum"), entry_hit=("w", "sum"))
        fixed = hits.groupby(key, sort=False).agg(entry_weight=("entry_weight", "first"), tokens=("tokens", "first"), rarest=("rarest", "first"))
        s = value.join(entry).join(fixed).reset_index()
        weight = s["value_hit"] + (s["tokens"] - s["known"]).clip(lower=0) * s["rarest"]
        s["score"] = (s["value_sim"] / weight * s["entry_sim"] / s["entry_weight"]) ** 0.5
        least = {c: s["kind"].map(lambda k, c=c: getattr(rules[k], c)) for c in ("least_score", "least_value", "least_entry")}
        s = s[
            (s["score"] >= least["least_score"])
            & (s["value_hit"] >= least["least_value"] * weight - 1e-9)
            & (s["entry_hit"] >= least["least_entry"] * s["entry_weight"] - 1e-9)
        ]
        s = s.groupby(["kind", "value", "seg", "ref_id"], sort=False)["score"].max().reset_index().sort_values(["score", "ref_id"], ascending=[False, True])
        best = s.groupby(["kind", "value", "seg"], sort=False)["score"].nlargest(2).groupby(["kind", "value", "seg"], sort=False).agg(["max", "min", "size"]).reset_index() if len(s) else s
        if not len(s):
            return pd.DataFrame([], columns=["kind", "value", "ref_id"])
        clear = best[(best["size"] == 1) | (best["max"] - best["min"] > 1e-6)]
        top = s.drop_duplicates(["kind", "value", "seg"]).merge(clear[["kind", "value", "seg"]])
        return top[["kind", "value", "ref_id"]].drop_duplicates()

    return run


#: Distinct values scored together in one call.
VALUES_PER_GROUP = 500


def mapped(values: DataFrame, refs: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """``(kind, value, ref_id)`` for each distinct value of a kind: the entries it means, or 0 if none.

    ``values`` has columns kind and value, ``refs`` kind, ref_id, label and aka. Null values and entries without a label or number are left out, empty values mean
    none. Of two entries that fit equally well none is meant. With an empty list all values mean none.
    """
    kinds = list(rules)
    distinct = cut(values.select("kind", "value").where(F.col("value").isNotNull() & F.col("kind").isin(kinds)).distinct())
    typed = cut(distinct.mapInPandas(_segments(rules), "kind string, value string, seg int, at_value array<int>, token string, light boolean"))
    refs = refs.where(F.col("label").isNotNull() & F.col("ref_id").isNotNull() & F.col("kind").isin(kinds)).select("kind", "ref_id", "label", "aka").distinct()
    forms = cut(refs.mapInPandas(_forms(rules), "kind string, ref_id bigint, form int, word string, covers array<int>, plain boolean"))
    # weights: inverse frequency of a word over the entries; an unknown token weighs as much as the rarest word
    plain = forms.where("plain").select("kind", "ref_id", "form", "word", F.explode("covers").alias("at"))
    entries = refs.groupBy("kind").agg(F.count("*").alias("entries"))
    frequency = plain.groupBy("kind", "word").agg(F.countDistinct("ref_id").alias("df")).join(entries, "kind")
    log2 = lambda x: F.pow(F.log1p(x), 2)
    weighted = plain.join(frequency, ["kind", "word"]).select(
        "kind", "ref_id", "form", "at", log2(F.col("entries") / F.col("df")).alias("w"), log2(F.col("entries").cast("double")).alias("rarest"),
    )
    weighted = weighted.withColumn("entry_weight", F.sum("w").over(Window.partitionBy("kind", "ref_id", "form")))
    index = cut(
        forms.select("kind", "ref_id", "form", "word", F.explode("covers").alias("at"))
        .join(weighted, ["kind", "ref_id", "form", "at"])
    )
    sims = cut(repaired_tokens(typed.select("token").distinct(), forms.select("word", "plain")))
    size = typed.where(F.size("at_value") == 1).groupBy("kind", "value", "seg").agg(F.sum((~F.col("light")).cast("int")).alias("tokens"))
    groups = max(1, -(-distinct.count() // VALUES_PER_GROUP))
    hits = (
        typed.join(sims, "token").join(index, ["kind", "word"]).join(size, ["kind", "value", "seg"])
        .withColumn("group_no", F.pmod(F.xxhash64("value"), F.lit(groups)))
    )
    # a fixed number of partitions, as the groups cost more time than their bytes say
    tasks = min(groups, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = cut(hits.repartition(tasks, "group_no").groupBy("group_no").applyInPandas(_best_entries(rules), "kind string, value string, ref_id bigint"))
    none = distinct.join(best, ["kind", "value"], "left_anti").select("kind", "value", F.lit(0).cast("bigint").alias("ref_id"))
    return best.unionByName(none)


# How this project's three free-typed fields are read, by the kind of their reference list.
RULES = {
    "channel": Rules(separator=r"\s*[/+&;]\s*|\s+y\s+"),
    "type": Rules(),
    "place": Rules(
        noise=r"^\s*(?:plaza de toros de|toros desde|desde|en)\s+|(?:^|\s)feria\s+de.*$",
        parts=True, least_score=0.5, least_value=1.0, least_entry=1.0,
    ),
}
