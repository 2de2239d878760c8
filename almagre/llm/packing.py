"""Filling fixed-capacity containers with texts: first-fit decreasing in randomised groups.

Texts are measured in tokens of a public tokenizer. Documents are dealt to groups of bounded size by a hash of
their id; each group is packed on its own with a tournament tree over the open bins' free space, once per
container kind. Only ids and lengths are shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's vocabulary of ranks; documents of one group on average.
VOCABULARY, GROUP_DOCS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 4096
# The splitting pattern published with byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file of ranks, one per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens, row)``; null and empty texts have 0 tokens. ``row`` counts the rows of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, row = encoding(vocabulary), 0
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes, "row": range(row, row + len(batch))})
            row += len(batch)

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens int, row bigint")


class Tournament:
    """Free space of the bins as a tree of maxima; finds the first bin with room in a logarithm of their number."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Takes ``size`` from the first bin with as much free space and returns the bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        best[at] -= size
        place = at - self.leaves
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left >= right else right
        return place


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """``(item, part, size, bin)`` of each part; an item is split only if it exceeds the capacity.

    A split item fills whole bins; its rest is an item like any other. Equal sizes keep their order.
    """
    if capacity <= 0:
        raise ValueError("a container's capacity must be positive")
    parts, whole = [], []
    for i, size in enumerate(sizes):
        full, rest = divmod(size, capacity) if size > capacity else (0, size)
        whole += [(i, p, capacity) for p in range(full)]
        if rest or not full:
            parts.append((i, full, rest))
    parts.sort(key=lambda x: -x[2])
    tree = Tournament(len(parts), capacity)
    out = [(i, p, size, tree.put(size)) for i, p, size in parts]
    used = 1 + max((b for *_, b in out), default=-1)
    return out + [(i, p, size, used + n) for n, (i, p, size) in enumerate(whole)]


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``(container_id, capacity, group_no, bin_no, doc_id, part, first_token, tokens)``: where each part of each text goes.

    A bin is named by container, group and number. Empty and null texts take a place of 0 tokens. A document
    that stands twice is packed twice, one without an id not at all. Container kinds are a short list of parameters (at most 1,000).
    """
    kinds = [(r["container_id"], r["capacity"]) for r in containers.where("capacity is not null and container_id is not null").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    groups = max(1, -(-documents.count() // group_docs))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"])
        ids, sizes = pdf["doc_id"].tolist(), pdf["tokens"].tolist()
        rows = [
            (kind, capacity, group[0], b, ids[i], part, part * capacity, size)
            for kind, capacity in kinds
            for i, part, size, b in first_fit_decreasing(sizes, capacity)
        ]
        return pd.DataFrame(rows, columns=["container_id", "capacity", "group_no", "bin_no", "doc_id", "part", "first_token", "tokens"])

    # a fixed number of partitions: by their bytes the groups would all be one task's, but they cost time
    tasks = min(groups, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        token_counts(documents, vocabulary)
        # the row number spreads the copies of a repeated document over the groups
        .select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).cast("int").alias("group_no"))
        .repartition(tasks, "group_no").groupBy("group_no")
        .applyInPandas(run, "container_id int, capacity int, group_no int, bin_no int, doc_id bigint, part int, first_token int, tokens int")
    )
