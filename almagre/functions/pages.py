"""What pages and API answers hold: JSON-LD, sitemaps, feeds, class contents, arrays and texts wherever they stand. Expressions; broken input gives null or nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagre.functions.text import decoded_entities, first_filled, squeezed, xml_items

# Where an answer's list of items may stand, in order; keys that hold no public text.
LISTS = ("contents", "content", "items", "videos", "children")
PRIVATE = "^(?:_id|id|slug|url|href|image|thumbnail|token|key)$"


def quoted(pattern: str) -> str:
    """A text as a pattern that matches itself."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def article_body(html: Column, depth: int = 3) -> Column:
    """The body of the first JSON-LD block that has one, at its top, in its array or under ``@graph``; null if none has."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def body(raw: Column) -> Column:
        node = F.try_parse_json(F.trim(raw))
        paths, roots = [], ["$", "$[0]", "$[1]", "$[2]"]
        for _ in range(depth):
            paths += [f"{r}.articleBody" for r in roots]
            roots = [f"{r}['@graph']{i}" for r in roots for i in ("", "[0]", "[1]", "[2]", "[3]")][:60]
        return F.coalesce(*[F.try_variant_get(node, p, "string") for p in paths])

    return F.nullif(squeezed(F.get(F.filter(F.transform(blocks, body), lambda b: b.isNotNull()), F.lit(0))), F.lit(""))


def class_content(html: Column, name: str, tag: str = "[a-z0-9]+") -> Column:
    """The inside of the first element with a class, up to the first end of its tag; empty if there is none."""
    return F.regexp_extract(html, rf"(?is)<({tag})\b[^>]*class=[\"'][^\"']*\b{quoted(name)}\b[^\"']*[\"'][^>]*>(.*?)</\1>", 2)


def canonical_link(html: Column) -> Column:
    """The canonical address of a page, whatever the order of attributes."""
    return first_filled(
        F.regexp_extract(html, r"(?is)<link\b[^>]*?rel\s*=\s*[\"']canonical[\"'][^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1),
        F.regexp_extract(html, r"(?is)<link\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*?rel\s*=\s*[\"']canonical[\"']", 1),
    )


def page_title(html: Column) -> Column:
    """The title of a page, its entities decoded."""
    return F.nullif(squeezed(decoded_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))), F.lit(""))


def resolved_url(base: Column, link: Column) -> Column:
    """An address as it is, or from a page's host (``/…``), scheme (``//…``) or folder."""
    host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return (
        F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, F.lit("/"), link))
    )


def feed_items(xml: Column, most: int = 40) -> Column:
    """The first items of a feed that have a link and a title, in order."""
    items = xml_items(xml, "item", ["title", "link", "pubDate"])
    return F.slice(F.filter(items, lambda i: (i["title"] != "") & (i["link"] != "")), 1, most)


def sitemap_items(xml: Column, containing: str, keywords: str) -> Column:
    """The entries of a sitemap whose address contains a text and whose title or address a keyword; titles may be the address."""
    raw = F.regexp_extract_all(xml, F.lit(r"(?is)(<url\b.*?</url>)"), F.lit(1))

    def tag(entry: Column, name: str) -> Column:
        inner = F.regexp_extract(entry, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
        return squeezed(decoded_entities(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))

    items = F.transform(raw, lambda e: F.struct(
        first_filled(tag(e, "news:title"), tag(e, "image:title"), tag(e, "loc")).alias("title"), tag(e, "loc").alias("link"), first_filled(tag(e, "news:publication_date"), tag(e, "lastmod")).alias("published"),
    ))
    return F.filter(items, lambda i: (i["link"] != "") & F.contains(i["link"], F.lit(containing)) & F.lower(F.concat_ws(" ", i["title"], i["link"])).rlike(keywords))


def monthly_names(as_of: Column, pattern: str, months: int = 3) -> Column:
    """The names of this month's file and those before, ``pattern`` in Java's date letters."""
    return F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.date_format(F.add_months(F.trunc(as_of, "month"), -i), pattern))


def located_array(json: Column, names: tuple = LISTS) -> Column:
    """The first of the named members that is an array, as a variant; null if none is."""
    def array(name: str) -> Column:
        v = F.try_variant_get(json, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), v)

    return F.coalesce(*[array(n) for n in names])


def flat_names(participants: Column) -> Column:
    """Names out of a variant: an array of texts and objects (by name, displayName or title), a single one, or nothing."""
    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        named = first_filled(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("name", "displayName", "title")])
        return F.trim(F.when(kind.startswith("OBJECT"), named).otherwise(F.when(kind == "STRING", v.cast("string"))))

    many = F.try_variant_get(participants, "$", "array<variant>")
    all_ = F.when(F.schema_of_variant(participants).startswith("ARRAY"), many).otherwise(F.array(participants))
    return F.filter(F.transform(all_, one), lambda n: n.isNotNull() & (n != ""))


def public_texts(df: DataFrame, key: str, json: str, private: str = PRIVATE, depth: int = 5) -> DataFrame:
    """``(key, texts)``: all texts of a JSON document up to a depth, without those under private keys, in order; broken JSON has none.

    A walk over nested values of any shape has no built-in expression; it runs over Arrow batches.
    """
    import json as parser
    import re

    ignored = re.compile(private, re.IGNORECASE)

    def walk(value, level: int, out: list) -> None:
        if level > depth or value is None:
            return
        if isinstance(value, str):
            text = " ".join(value.split())
            if text:
                out.append(text)
        elif isinstance(value, list):
            for v in value:
                walk(v, level + 1, out)
        elif isinstance(value, dict):
            for k, v in value.items():
                if not ignored.match(k):
                    walk(v, level + 1, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for raw in batch["json_"]:
                own: list = []
                try:
                    walk(parser.loads(raw) if raw else None, 0, own)
                except ValueError:
                    pass
                texts.append(own)
            yield pd.DataFrame({key: batch[key], "texts": texts})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(json).alias("json_")).mapInPandas(run, f"{key} {kind}, texts array<string>")


def integers_of(json: Column) -> Column:
    """The whole numbers of a stored list; anything else, broken or missing, is an empty list."""
    items = F.from_json(json, "array<string>")
    return F.coalesce(F.transform(F.filter(items, lambda x: x.rlike(r"^-?\d{1,18}$")), lambda x: x.try_cast("bigint")), F.array().cast("array<bigint>"))


def alert_settings(json: Column, default: int = 30) -> Column:
    """``(categories, minutes)`` of stored settings, repaired: no list is an empty one, no whole number the default."""
    node = F.try_parse_json(json)
    minutes = F.try_variant_get(node, "$.minutesBefore", "string")
    return F.struct(
        F.coalesce(F.try_variant_get(node, "$.categories", "array<string>"), F.array().cast("array<string>")).alias("categories"),
        F.when(minutes.rlike(r"^-?\d{1,9}$"), minutes.try_cast("int")).otherwise(default).alias("minutes"),
    )


def entry(col: Column, unwanted: str, least: int = 12, most_place: int = 150, least_rest: int = 8) -> Column:
    """"place - description" as a struct, or null: too short, unwanted, without the dash, or with an overlong place."""
    text = squeezed(col)
    place = F.trim(F.regexp_extract(text, r"^(.*?)\s[-–—]\s", 1))
    rest = F.regexp_extract(text, r"^.*?\s[-–—]\s+(.*)$", 1)
    ok = (F.length(text) >= least) & ~text.rlike(unwanted) & (place != "") & (F.length(place) <= most_place) & (F.length(rest) >= least_rest)
    return F.when(ok, F.struct(place.alias("place"), rest.alias("description")))


def cell_title(col: Column, codes: list[str], canonical: list[tuple[str, str]], keyword: str) -> Column:
    """A title out of a grid cell: codes dropped, a known programme by its name, else from the keyword on, with dashes between its parts."""
    text = squeezed(F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?i)\b(?:{'|'.join(codes)})\b", ""))
    start = F.instr(F.upper(text), keyword.upper())
    own = F.when(start > 0, F.substring(text, start, F.length(text))).otherwise(text)
    own = squeezed(F.regexp_replace(own, r"\s*-\s*", " – "))
    own = F.regexp_replace(F.regexp_replace(own, rf"(?i)^{keyword}\s*(?:–\s*)?", f"{keyword.upper()} – "), r"\s*–\s*$", "")
    known = None
    for contained, title in canonical:
        known = F.when(F.contains(F.upper(text), F.lit(contained.upper())), title) if known is None else known.when(F.contains(F.upper(text), F.lit(contained.upper())), title)
    return own if known is None else known.otherwise(own)
