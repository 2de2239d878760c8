"""Schemas that drift between files: a catalogue of column lifespans.

Each delivered line's keys are exploded once into (file, field, JSON type). Per producer and field the files
form islands (lag over the file order); an island's start and end are a field's appearance and disappearance,
a start and an end at the same file with the same content for the same records are a renaming, and a
change of the prevailing type within an island is a retyping. The renamings make the alias table by
which all files come out as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagre.session import cut

TYPES = ("string", "number", "boolean", "array", "object")

#: Share of the records in both files, with both values there, that must agree in a renaming.
SAME_CONTENT = 0.8


def exploded(lines: DataFrame, record_id: str = "id") -> DataFrame:
    """``(feed, file_no, line_no, id, field, type, content)`` of each key of each line.

    ``type`` is null for JSON null. Lines that aren't a JSON object have no fields. Keys are case-sensitive.
    """
    spark = lines.sparkSession
    # each payload is parsed once: the parsed value is used twice above it, so the two steps aren't folded into one
    values = spark.sql(
        """select l.feed, l.file_no, l.line_no, l.id, v.key as field, schema_of_variant(v.value) as kind, cast(v.value as string) as content
           from (select *, try_variant_get(json, {path}, 'string') as id
                 from (select feed, file_no, line_no, try_parse_json(payload) as json from {lines})) as l,
                lateral variant_explode(l.json) as v
           where v.key is not null""",
        lines=lines.select("feed", "file_no", "line_no", "payload"), path=f"$.{record_id}",
    )
    kind = (
        F.when(F.col("kind") == "VOID", None)
        .when(F.col("kind") == "STRING", "string")
        .when(F.col("kind") == "BOOLEAN", "boolean")
        .when(F.col("kind").startswith("ARRAY"), "array")
        .when(F.col("kind").startswith("OBJECT"), "object")
        .otherwise("number")
    )
    return values.select("feed", "file_no", "line_no", "id", "field", kind.alias("type"), "content")


def catalogue(values: DataFrame, lines: DataFrame) -> DataFrame:
    """``(feed, file_no, ord, files, field, type, island)``: the fields of each file with their prevailing type.

    ``ord`` is the file's place in its feed, ``files`` the number of files. A tie between types goes to
    the first of ``TYPES``; a file with nulls only keeps the type of the island so far (null if there is none).
    """
    in_order = Window.partitionBy("feed").orderBy("file_no")
    # one row a file from here on: partial aggregation leaves a row per file, field and task
    files = (
        lines.select("feed", "file_no").distinct()
        .withColumn("ord", F.row_number().over(in_order))
        .withColumn("files", F.count("*").over(Window.partitionBy("feed")))
    )
    counts = values.groupBy("feed", "file_no", "field").agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in TYPES]
    )
    most = F.greatest(*TYPES)
    own = F.when(most > 0, F.coalesce(*[F.when(F.col(t) == most, t) for t in TYPES]))
    per_field = Window.partitionBy("feed", "field").orderBy("ord")
    per_island = Window.partitionBy("feed", "field", "island").orderBy("ord")
    return (
        counts.select("feed", "file_no", "field", own.alias("own"))
        .join(files, ["feed", "file_no"])
        .withColumn("starts", F.coalesce(F.col("ord") - F.lag("ord").over(per_field) > 1, F.lit(True)))
        .withColumn("island", F.sum(F.col("starts").cast("int")).over(per_field))
        .withColumn("type", F.last("own", ignorenulls=True).over(per_island))
        .select("feed", "file_no", "ord", "files", "field", "type", "island")
    )


def _renamings(values: DataFrame, cat: DataFrame, ends: DataFrame, starts: DataFrame) -> DataFrame:
    """``(feed, ord, field, new_field)``: one-to-one pairs of an ending and a starting field with the same content."""
    def content(borders: DataFrame, at: str, name: str) -> DataFrame:
        files = cat.select("feed", "file_no", F.col("ord").alias("at")).distinct()
        keyed = borders.select("feed", "ord", F.col("field"), F.col(at).alias("at")).join(files, ["feed", "at"])
        return (
            values.where("type is not null and id is not null")
            .join(keyed.select("feed", "file_no", "field", "ord"), ["feed", "file_no", "field"])
            .select("feed", "ord", "id", F.col("field").alias(name), F.xxhash64("content").alias("h"))
            .distinct()
        )

    old, new = content(ends, "last", "field"), content(starts, "first", "new_field")
    both = (
        old.drop("h").distinct().join(new.drop("h").distinct(), ["feed", "ord", "id"])
        .groupBy("feed", "ord", "field", "new_field").agg(F.count("*").alias("both"))
    )
    same = (
        old.join(new, ["feed", "ord", "id", "h"]).select("feed", "ord", "field", "new_field", "id").distinct()
        .groupBy("feed", "ord", "field", "new_field").agg(F.count("*").alias("same"))
    )
    best = [F.desc(F.col("same") / F.col("both")), F.desc("same")]
    return (
        same.join(both, ["feed", "ord", "field", "new_field"])
        .where(F.col("same") >= SAME_CONTENT * F.col("both"))
        .withColumn("r1", F.row_number().over(Window.partitionBy("feed", "ord", "field").orderBy(*best, "new_field")))
        .withColumn("r2", F.row_number().over(Window.partitionBy("feed", "ord", "new_field").orderBy(*best, "field")))
        .where("r1 = 1 and r2 = 1")
        .select("feed", "ord", "field", "new_field")
    )


def drift(lines: DataFrame, record_id: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The exploded values, the catalogue with islands, and the log of changes.

    The log is ``(feed, file_no, change, field, new_field)``; ``change`` is added, removed, renamed or retyped,
    ``new_field`` is empty unless renamed, ``file_no`` the later of the two files. The first file of a feed
    and an empty table have no changes; a repeated line changes nothing.
    """
    values = cut(exploded(lines, record_id))
    cat = cut(catalogue(values, lines))
    islands = cat.groupBy("feed", "field", "island").agg(
        F.min("ord").alias("first"), F.max("ord").alias("last"), F.max("files").alias("files"),
        F.min_by("type", "ord").alias("first_type"), F.max_by("type", "ord").alias("last_type"),
    )
    starts = islands.where("first > 1").withColumn("ord", F.col("first"))
    ends = islands.where("last < files").withColumn("ord", F.col("last") + 1)
    renamed = cut(_renamings(values, cat, ends, starts))

    # an island of nulls only, begun by a renaming, has the type of the name before
    typed = renamed.join(ends.select("feed", "ord", "field", "last_type"), ["feed", "ord", "field"])
    before = typed.select("feed", F.col("ord").alias("begun"), F.col("new_field").alias("field"), F.col("last_type").alias("given"))
    begun = islands.select("feed", "field", "island", F.col("first").alias("begun"))
    cat = (
        cat.join(begun, ["feed", "field", "island"]).join(before, ["feed", "begun", "field"], "left")
        .withColumn("type", F.coalesce("type", "given"))
    )
    per_island = Window.partitionBy("feed", "field", "island").orderBy("ord")
    old_type = F.when(F.col("ord") == F.col("begun"), F.col("given")).otherwise(F.lag("type").over(per_island))
    retyped = cat.withColumn("old", old_type).where("old <> type").select("feed", "ord", F.lit("retyped").alias("change"), "field", F.lit("").alias("new_field"))
    added = starts.join(
        renamed.select("feed", "ord", F.col("new_field").alias("field")), ["feed", "ord", "field"], "left_anti"
    ).select("feed", "ord", F.lit("added").alias("change"), "field", F.lit("").alias("new_field"))
    removed = ends.join(renamed, ["feed", "ord", "field"], "left_anti").select(
        "feed", "ord", F.lit("removed").alias("change"), "field", F.lit("").alias("new_field")
    )
    log = (
        added.unionByName(removed).unionByName(retyped)
        .unionByName(renamed.withColumn("change", F.lit("renamed")))
        .join(cat.select("feed", "ord", "file_no").distinct(), ["feed", "ord"])
        .select("feed", F.col("file_no").cast("int").alias("file_no"), "change", "field", "new_field")
    )
    return values, cat.select("feed", "file_no", "ord", "field", "type", "island", "begun"), log


def aliases(cat: DataFrame, log: DataFrame) -> DataFrame:
    """``(feed, field, island, name)``: each island's first name in its chain of renamings, by pointer doubling."""
    islands = cat.groupBy("feed", "field", "island").agg(F.min("ord").alias("begun"), F.max("ord").alias("last"))
    order = cat.select("feed", "ord", "file_no").distinct()
    renamed = log.where("change = 'renamed'").join(order, ["feed", "file_no"]).select("feed", "ord", "field", "new_field")
    node = lambda: F.struct("field", "island")
    new = islands.select("feed", F.col("begun").alias("ord"), F.col("field").alias("new_field"), node().alias("node"))
    old = islands.select("feed", (F.col("last") + 1).alias("ord"), "field", node().alias("to"))
    links = renamed.join(new, ["feed", "ord", "new_field"]).join(old, ["feed", "ord", "field"]).select("feed", "node", "to")
    nodes = islands.select("feed", node().alias("node")).join(links, ["feed", "node"], "left")
    nodes = cut(nodes.withColumn("to", F.coalesce("to", "node")))
    while True:
        step = nodes.select("feed", F.col("node").alias("to"), F.col("to").alias("next"))
        moved = cut(nodes.join(step, ["feed", "to"]).select("feed", "node", "to", "next"))
        nodes = moved.select("feed", "node", F.col("next").alias("to"))
        if moved.where("to <> next").isEmpty():
            return nodes.select("feed", F.col("node.field"), F.col("node.island"), F.col("to.field").alias("name"))


#: Files up to which their fields' names are broadcast (a name and a field each).
BROADCAST_FILES = 100_000


def _names(cat: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(feed, file_no, field, name)``: each file's fields by their first name; ``(name, type)``: the type most files have a name in."""
    at = cut(cat.select("feed", "file_no", "field", "island", "type").join(aliases(cat, log), ["feed", "field", "island"]).select("feed", "file_no", "field", "name", "type"))
    counts = at.groupBy("name").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    most = F.greatest(*TYPES)
    types = counts.select("name", F.when(most > 0, F.coalesce(*[F.when(F.col(t) == most, t) for t in TYPES])).otherwise("string").alias("cast"))
    return at.drop("type"), cut(types)


def named_values(lines: DataFrame, record_id: str = "id") -> DataFrame:
    """``(feed, file_no, line_no, name, type, value, fits)``: every value, as text, under its first name with the name's type.

    The type of a name is the one most of its files have it in (the first of ``TYPES`` on a tie; string if it is never anything but null).
    ``fits`` says whether the value has a form in that type; null values have. A value that hasn't is null in ``one_table`` and stands only here.
    """
    values, cat, log = drift(lines, record_id)
    at, types = _names(cat, log)
    number = F.col("content").rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
    fits = F.when(F.col("type").isNull() | (F.col("cast") == "string"), True).when(F.col("cast") == "number", number)
    fits = fits.when(F.col("cast") == "boolean", F.lower("content").isin("true", "false")).otherwise(F.col("type") == F.col("cast"))
    named = values.join(at, ["feed", "file_no", "field"]).join(types, "name")
    return named.select("feed", "file_no", "line_no", "name", F.col("cast").alias("type"), F.when(F.col("type").isNotNull(), F.col("content")).alias("value"), fits.alias("fits"))


def one_table(lines: DataFrame, record_id: str = "id") -> DataFrame:
    """One table of all files: ``(feed, file_no, line_no)`` and a column per name, cast to the name's type.

    Each file's aliases are a map beside its lines, so a line becomes a row where it lies: no value is shuffled. Numbers are doubles, arrays are
    of texts, objects their JSON text. Names that differ in case only get a number behind them. Values without a form in the
    type are null (``named_values`` lists them), lines that aren't a JSON object have nulls only. The columns' names go through the driver.
    """
    _, cat, log = drift(lines, record_id)
    at, types = _names(cat, log)
    per_file = cut(at.groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "field"))).alias("alias_")))
    rows = lines.select("feed", "file_no", "line_no", F.from_json("payload", "map<string,string>").alias("json_"))
    rows = rows.join(F.broadcast(per_file) if per_file.count() <= BROADCAST_FILES else per_file, ["feed", "file_no"], "left")

    def typed(name: str, kind: str) -> Column:
        text = F.try_element_at("json_", F.try_element_at("alias_", F.lit(name)))
        if kind == "number":
            return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))
        if kind == "boolean":
            return F.when(F.lower(text).isin("true", "false"), text.try_cast("boolean"))
        if kind == "array":
            return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
        return F.when(text.rlike(r"^\s*\{"), text) if kind == "object" else text

    taken = {"feed", "file_no", "line_no"}
    columns = []
    for r in types.orderBy("name").collect():
        label, n = r["name"], 1
        while label.lower() in taken:
            label, n = f"{r['name']}_{n + 1}", n + 1
        taken.add(label.lower())
        columns.append(typed(r["name"], r["cast"]).alias(label))
    return rows.select("feed", "file_no", "line_no", *columns)
