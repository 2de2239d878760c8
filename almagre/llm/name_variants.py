"""Variant spellings of names typed by people: suffix blocking and longest-common-subsequence comparison.

Each distinct spelling is taken apart into given name or title and own name. Suffixes of the own name's first token above a
minimum length, and that token without each of its letters (so that no slip of one letter parts two tokens of any
length), index the names; a key shared by too many is refined with what given names, then next tokens, of one name must share,
before it is compared. Pairs in a block are compared
by longest-common-subsequence ratio. Every name follows its most frequent full match; short forms (initials, familiar names,
dropped surnames) follow the one full name they can stand for. The spellings of one root are one entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagre.llm.names import any_person, breeder, familiar_for, same_head, similar, usable
from almagre.llm.slips import Hashed, lost
from almagre.session import cut

#: Shortest suffix indexed; names of one block from which it is refined further.
SUFFIX, COMMON = 3, 200

#: Keys a task gathers before it passes them on.
AT_ONCE = 20_000

_SIDES = (("head", "a"), ("head", "b"), ("second", "a"), ("second", "b"))
_NODE = "kind string, head string, heads string, rest string, short boolean"


def parsed(spellings: DataFrame) -> DataFrame:
    """``(spelling, n, kind, head, heads, rest, short)`` of the spellings that are a person's or a breeder's usable name, of any number of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s, n in zip(batch["spelling"], batch["n"], strict=True):
                name = (breeder(s, None) or any_person(s)) if usable(s) else None
                if name:
                    rows.append((s, n, name.kind, name.head, " ".join(name.heads), " ".join(name.rest), name.short))
            yield pd.DataFrame(rows, columns=["spelling", "n", "kind", "head", "heads", "rest", "short"])

    return spellings.mapInPandas(run, f"spelling string, n bigint, {_NODE}")


def _head_keys(kind: str, head: str, heads: str, full: bool) -> list[str]:
    """What a head that may stand for another (``full``: that other may stand for) shares with it, whichever way ``compare`` accepts."""
    if kind == "breeder":
        return sorted(set(heads.split()))
    own = Hashed(head)
    keys = {f"d{k}" for k in own.less_one()}
    if full:
        keys |= {f"p{k}" for k in own.prefixes(own.n - 1)} | {f"s{head[0]}{head[-1]}"}
    else:
        keys |= {f"d{Hashed(f).whole()}" for f in familiar_for(head)} | {f"p{own.whole()}"} | ({f"s{head[0]}{head[-1]}"} if len(head) <= 4 else set())
    return sorted(keys)


def _second_keys(kind: str, rest: str, full: bool) -> list[str]:
    """The same of the own name's second token, which a short form may leave out or cut off."""
    second = rest.split()[1:2]
    keys = {f"d{k}" for t in second for k in Hashed(t).less_one()}
    if not second or (full and kind == "person"):
        keys.add("-")
    if full:
        keys |= {f"i{k}" for t in second for k in Hashed(t).prefixes(len(t))}
    else:
        keys |= {f"i{Hashed(t.rstrip('.')).whole()}" for t in second if t.endswith(".") or len(t) == 1}
    return sorted(keys)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Block keys of each node: the suffixes of its first own token, and that token without each of its letters."""
    for batch in batches:
        rows = []
        for node, kind, rest in zip(batch["node"], batch["kind"], batch["rest"], strict=True):
            token = Hashed(rest.split()[0])
            for k in sorted({f"{k}" for k in token.suffixes(SUFFIX)} | {f"-{k}" for k in token.less_one()}):
                rows.append((node, f"{kind}:{k}"))
                if len(rows) >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=["node", "key"])
                    rows = []
        yield pd.DataFrame(rows, columns=["node", "key"])


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What refines a node's common keys, as a short form (a) and as a full one (b)."""
    for batch in batches:
        for node, kind, head, heads, rest in zip(batch["node"], batch["kind"], batch["head"], batch["heads"], batch["rest"], strict=True):
            own = [_head_keys(kind, head, heads, False), _head_keys(kind, head, heads, True), _second_keys(kind, rest, False), _second_keys(kind, rest, True)]
            yield pd.DataFrame([(node, f, side, v) for (f, side), vs in zip(_SIDES, own, strict=True) for v in vs], columns=["node", "field", "side", "v"])


def _refined(a: DataFrame, b: DataFrame, finer: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys that too many pairs share refined by a field: one key for each of its values."""
    n = a.groupBy("key").agg(F.count("*").alias("n_a")).join(b.groupBy("key").agg(F.count("*").alias("n_b")), "key")
    large = n.where(F.col("n_a").cast("double") * F.col("n_b") > float(common) ** 2).select("key")

    def one(df: DataFrame, side: str) -> DataFrame:
        more = df.join(large, "key", "left_semi").join(finer.where(F.col("side") == side), "node")
        return df.join(large, "key", "left_anti").unionByName(more.select("node", F.concat_ws("|", "key", "v").alias("key")))

    return one(a, "a"), one(b, "b")


def candidate_pairs(nodes: DataFrame, common: int = COMMON) -> DataFrame:
    """``(a, b)``: nodes that share a key, ``a`` as a spelling or short form of ``b``.

    A key common to many is refined rather than dropped: by all that two heads can share if one may stand for the other, then by
    all that two second tokens can. So a refinement parts only pairs that ``compare`` doesn't accept.
    """
    a = b = keys = cut(nodes.select("node", "kind", "rest").mapInPandas(_blocks, "node bigint, key string"))
    often = keys.groupBy("key").count().where(F.col("count") > common).select("key")
    common_nodes = nodes.join(keys.join(often, "key", "left_semi").select("node").distinct(), "node", "left_semi")
    finer = cut(common_nodes.select("node", "kind", "head", "heads", "rest").mapInPandas(_finer, "node bigint, field string, side string, v string"))
    for by in ("head", "second"):
        a, b = _refined(a, b, finer.where(F.col("field") == by), common)
    a, b = a.select("key", F.col("node").alias("a")), b.select("key", F.col("node").alias("b"))
    return a.join(b, "key").where(F.col("a") != F.col("b")).select("a", "b").distinct()


def compare(kind: str, head_a: str, heads_a: str, rest_a: str, head_b: str, heads_b: str, rest_b: str) -> tuple[int, bool] | None:
    """How ``a`` may be a spelling of ``b``: letters lost and whether ``a`` is a short form of it; None if it isn't one."""
    a, b, cost, short = rest_a.split(), rest_b.split(), 0, False
    if kind == "breeder":
        if not set(heads_a.split()) & set(heads_b.split()) or len(a) != len(b):
            return None
    else:
        how = same_head(head_a, head_b)
        if how == 9 or len(a) > len(b):
            return None
        cost += lost(head_a, head_b) if how == 2 else 0
        short = how == 1
    for x, y in zip(a, b, strict=False):
        if x == y:
            continue
        if x is not a[0] and (x.endswith(".") or len(x) == 1) and y.startswith(x.rstrip(".")):
            short = True
        elif similar(x, y):
            cost += lost(x, y)
        else:
            return None
    return cost, short or len(a) < len(b)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            how = compare(r.kind, r.head, r.heads, r.rest, r.head_b, r.heads_b, r.rest_b)
            if how is not None and how[0] <= 2:
                rows.append((r.a, r.b, how[0], how[1]))
        yield pd.DataFrame(rows, columns=["a", "b", "cost", "short"])


def entities(spellings: DataFrame) -> DataFrame:
    """``(spelling, entity)`` of the spellings that are usable names; ``spellings`` has spelling and n (how often it stands).

    Null, empty and unusable spellings are no names. Equal spellings are one. A short form that may stand for several full names
    is an entity of its own. Ties in frequency go to the name first in order.
    """
    distinct = spellings.where("spelling is not null").groupBy("spelling").agg(F.sum("n").alias("n"))
    names = cut(parsed(distinct).withColumn("node", F.xxhash64("kind", "heads", F.when(F.col("kind") == "person", F.col("head")), "rest")))
    nodes = cut(
        names.groupBy("node").agg(
            F.sum("n").alias("n"), F.first("kind").alias("kind"), F.min("head").alias("head"), F.first("heads").alias("heads"),
            F.first("rest").alias("rest"), F.max("short").alias("short"),
        )
    )
    pairs = candidate_pairs(nodes)
    left = pairs.join(nodes.withColumnRenamed("node", "a"), "a")
    right = nodes.select(*[F.col(c).alias(f"{c}_b") for c in ("head", "heads", "rest", "kind", "node")])
    links = cut(
        left.join(right, (F.col("b") == F.col("node_b")) & (F.col("kind") == F.col("kind_b")))
        .select("a", "b", "kind", "head", "heads", "rest", "head_b", "heads_b", "rest_b")
        .mapInPandas(_compared, "a bigint, b bigint, cost int, short boolean")
    )
    weight = nodes.select("node", "n", F.col("short").alias("is_short"), "rest")
    full = (
        links.where("not short and cost <= 1")
        .join(weight.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
        .join(weight.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        .where((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    )
    parent = full.groupBy("a").agg(F.max_by("b", F.struct("nb", -F.col("b"))).alias("to"))
    tree = nodes.select(F.col("node").alias("a")).join(parent, "a", "left").select("a", F.coalesce("to", "a").alias("to"))
    roots = _roots(cut(tree))
    # short forms and roots nobody resembles in full: to the one root they can stand for, the nearest first
    # (a form that is itself short for another is no full name)
    full_names = nodes.where("not short").select(F.col("node").alias("b")).join(links.where("short").select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    to_root = (
        links.where("short").join(full_names, "b")
        .join(roots.withColumnRenamed("a", "b").withColumnRenamed("to", "root"), "b")
    )
    near = to_root.groupBy("a", "root").agg(F.min("cost").alias("cost"))
    least = Window.partitionBy("a")
    one = (
        near.withColumn("least", F.min("cost").over(least)).where("cost = least")
        .groupBy("a").agg(F.min("root").alias("root"), F.count("*").alias("n_roots")).where("n_roots = 1")
        .select(F.col("a").alias("to"), "root")
    )
    # a whole tree follows when its root does, unless that leads to a root that follows another itself (no circles)
    one = cut(one.where("root <> to"))
    one = one.join(one.select(F.col("to").alias("root")), "root", "left_anti")
    merged = roots.join(one, "to", "left").select("a", F.coalesce("root", "to").alias("to"))
    return names.join(merged, F.col("node") == F.col("a")).select("spelling", F.col("to").alias("entity"))


def _roots(links: DataFrame) -> DataFrame:
    """Follows ``a -> to`` to its end by pointer doubling; links go one way, so each round halves the way."""
    while True:
        step = links.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moved = cut(links.join(step, "to", "left").select("a", "to", F.coalesce("next", "to").alias("next")))
        links = moved.select("a", F.col("next").alias("to"))
        if moved.where("to <> next").isEmpty():
            return links


def variant_pairs(spellings: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of different spellings of one entity, the smaller first."""
    found = cut(entities(spellings))
    left = found.select("entity", F.col("spelling").alias("name_a"))
    right = found.select("entity", F.col("spelling").alias("name_b"))
    return left.join(right, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
