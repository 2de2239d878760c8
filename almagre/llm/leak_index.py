"""Evaluation texts leaking into training text: an FM-index per training shard.

Each task gathers its documents into shards of a bounded number of words, builds the shard's suffix array over
word symbols (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix and sampled suffix
positions. All windows of the evaluation items are searched backwards at once; the occurrences are located
through the samples and merged into spans to be removed. Documents are never shuffled. ``leaked_spans`` builds its index for one
set of items, over their words only; ``kept_index`` holds all words and is built once for any number of sets.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagre.session import cut

#: Consecutive words that make a leak; words of one shard's index; distance of sampled suffix positions.
WINDOW, SHARD_WORDS, SAMPLE = 12, 1 << 19, 16
#: Characters of evaluation text searched in one pass over the corpus (it is sent to every task); more go in further passes.
PASS_CHARS = 16_000_000

_word = re.compile(r"(?:[^\W_][̀-ͯ]*)+")


def word_form(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)).casefold()


def words_of(text: str | None) -> list[str]:
    """The words of a text as they stand: runs of letters and digits with their combining accents."""
    return _word.findall(text or "")


class FMIndex:
    """Backward search over a sequence of symbols; 0 matches nothing, itself included."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.n = len(text)
        self.levels = max(1, int(symbols).bit_length())
        order = _suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = before
        for bit in range(self.levels - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(int(len(b) - b.sum()))
            level = np.concatenate([level[b == 0], level[b == 1]])
        sampled = (order % SAMPLE == 0) | (before == 0)  # no walk ever crosses a 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled].astype(np.int32)

    def stored(self) -> bytes:
        """The index as bytes: bits instead of running counts."""
        head = np.array([self.n, self.levels, len(self.first), len(self.samples)], dtype=np.int64)
        bits = [np.packbits(np.diff(x)) for x in (*self.ones, self.marks)]
        return b"".join([head.tobytes(), self.first.astype(np.int64).tobytes(), self.samples.tobytes(), *[b.tobytes() for b in bits]])

    @classmethod
    def restored(cls, raw: bytes) -> FMIndex:
        """The index out of its bytes."""
        self = cls.__new__(cls)
        self.n, self.levels, firsts, samples = np.frombuffer(raw, dtype=np.int64, count=4).tolist()
        at = 32
        self.first = np.frombuffer(raw, dtype=np.int64, count=firsts, offset=at)
        at += 8 * firsts
        self.samples = np.frombuffer(raw, dtype=np.int32, count=samples, offset=at)
        at += 4 * samples
        size, counts = -(-self.n // 8), []
        for _ in range(self.levels + 1):
            bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=size, offset=at), count=self.n)
            counts.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            at += size
        self.ones, self.marks = counts[:-1], counts[-1]
        self.zeros = [self.n - int(x[-1]) for x in self.ones]
        return self

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, at = np.zeros_like(at), at.copy()
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            a, b = ones[low], ones[at]
            low = np.where(bit == 1, zeros + a, low - a)
            at = np.where(bit == 1, zeros + b, at - b)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbol at each place."""
        out, at = np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[at]
            bit = ones[at + 1] - a
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out

    def search(self, items: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``items[b:b + length]``, the numbers of those that occur, with their suffix ranges."""
        alive = np.arange(len(begin))
        low, high = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), self.n, dtype=np.int64)
        for j in range(length - 1, -1, -1):
            c = items[begin[alive] + j]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            keep = (high > low) & (c > 0)
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text position of each suffix, walking back to a sampled one."""
        at, out, steps = at.copy(), np.full(len(at), -1, dtype=np.int64), 0
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo]
            hit = self.marks[here + 1] > self.marks[here]
            out[todo[hit]] = self.samples[self.marks[here[hit]]] + steps
            todo = todo[~hit]
            here = at[todo]
            c = self.symbol(here)
            at[todo] = self.first[c] + self.rank(c, here)
            steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; each 0 is a symbol of its own, so a suffix is settled at its first 0."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum())).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.repeat(begin, size)
    open_ = order[np.repeat(size > 1, size)]  # suffixes not yet told apart, in order
    step = 1
    while len(open_):
        after = open_ + step
        key = place[open_] * np.int64(n + 1) + np.where(after < n, place[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        suffix, key = open_[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = place[suffix]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(suffix))
        within = at - np.maximum.accumulate(np.where(head, at, 0))
        spot = group + within
        order[spot] = suffix
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(suffix)]]))
        place[suffix] = np.repeat(spot[begin], size)
        open_ = suffix[np.repeat(size > 1, size)]
        step *= 2
    return order


def _search_shard(docs: list, texts: list[str], symbols: list[int], starts: list[int], plan: tuple) -> pd.DataFrame:
    items, begin, number, ids, size = plan
    index = FMIndex(np.asarray(symbols, dtype=np.int64), size)
    which, low, high = index.search(items, begin, WINDOW)
    count = high - low
    if not len(which):
        return pd.DataFrame([], columns=["item_id", "doc_id", "start", "end", "words"])
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(np.repeat(low, count) + offset)
    doc = np.searchsorted(starts, at, side="right") - 1
    hits = pd.DataFrame({"item": number[np.repeat(which, count)], "doc": doc, "at": at - np.asarray(starts)[doc]})
    hits = hits.drop_duplicates().sort_values(["doc", "item", "at"])
    same = (hits["doc"].eq(hits["doc"].shift()) & hits["item"].eq(hits["item"].shift()) & (hits["at"] <= hits["at"].shift() + WINDOW)).to_numpy()
    spans = hits.groupby((~same).cumsum()).agg(item=("item", "first"), doc=("doc", "first"), a=("at", "min"), b=("at", "max"))
    rows, places = [], {}
    for item, d, a, b in spans.itertuples(index=False):
        if d not in places:
            places[d] = [m.span() for m in _word.finditer(texts[d])]
        last = b + WINDOW - 1
        rows.append((ids[item], docs[d], places[d][a][0], places[d][last][1], last + 1 - a))
    return pd.DataFrame(rows, columns=["item_id", "doc_id", "start", "end", "words"])


def _search(plan, vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = vocabulary.value, {}
        docs, texts, symbols, starts = [], [], [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                docs.append(doc)
                texts.append(text)
                starts.append(len(symbols))
                for w in words:
                    s = seen.get(w)
                    if s is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        s = seen[w] = known.get(word_form(w), 0)
                    symbols.append(s)
                symbols.append(0)
                if len(symbols) >= SHARD_WORDS:
                    yield _search_shard(docs, texts, symbols, starts, plan.value)
                    docs, texts, symbols, starts = [], [], [], []
        if symbols:
            yield _search_shard(docs, texts, symbols, starts, plan.value)

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``(item_id, doc_id, start, end, words)``: each span of a document that holds at least twelve words of an item.

    ``start`` and ``end`` are code point offsets, ``words`` the span's length. Overlapping windows of an
    item are merged; spans of different items may overlap. Items and documents of fewer than twelve words, empty and
    null texts and rows without an id give nothing. A repeated item or document gives its spans as often. Items beyond ``pass_chars`` are
    searched in further passes over the corpus.
    """
    spark = documents.sparkSession
    items = items.where("text is not null and item_id is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_chars))
    schema = "item_id bigint, doc_id bigint, start int, end int, words int"
    parts = []
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        texts = [(r["item_id"], [word_form(w) for w in words_of(r["text"])]) for r in block]
        texts = [(i, ws) for i, ws in texts if len(ws) >= WINDOW]
        known: dict[str, int] = {}
        flat, begin, number = [], [], []
        for j, (_, ws) in enumerate(texts):
            begin += range(len(flat), len(flat) + len(ws) - WINDOW + 1)
            number += [j] * (len(ws) - WINDOW + 1)
            flat += [known.setdefault(w, len(known) + 1) for w in ws]
        plan = (
            np.asarray(flat, dtype=np.int64), np.asarray(begin, dtype=np.int64), np.asarray(number, dtype=np.int64),
            [i for i, _ in texts], len(known),
        )
        if not texts:
            parts.append(spark.createDataFrame([], schema))
            continue
        sc = spark.sparkContext
        shared = sc.broadcast(plan), sc.broadcast(known)
        found = documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(_search(*shared), schema)
        if passes > 1:  # one block of items at a time lies on the driver and in the tasks
            found = cut(found)
            for b in shared:
                b.unpersist()
        parts.append(found)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# -- an index that is kept ----------------------------------------------------------------------------------


def _hashes(words: list[str], seen: dict[str, int]) -> list[int]:
    if len(seen) > 500_000:
        seen.clear()
    return [seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(word_form(w))) for w in words]


def kept_index(documents: DataFrame) -> DataFrame:
    """``(docs, starts, vocabulary, index)``: an FM-index per shard over all its words, to be written once and searched by any number of item sets.

    ``docs`` are the shard's document ids, ``starts`` their first words, ``vocabulary`` the sorted 64-bit hashes of its words (symbols count from 1). Documents of
    fewer than twelve words, null texts and rows without an id aren't in it. No document is shuffled.
    """

    def shard(docs: list, words: list[int], starts: list[int]) -> pd.DataFrame:
        whole = np.asarray(words, dtype=np.uint64)
        ends = np.zeros(len(whole), dtype=bool)
        ends[[s - 1 for s in starts[1:]] + [len(whole) - 1]] = True
        vocabulary, symbols = np.unique(whole[~ends], return_inverse=True)
        text = np.zeros(len(whole), dtype=np.int64)
        text[~ends] = symbols + 1
        index = FMIndex(text, len(vocabulary))
        return pd.DataFrame({"docs": [docs], "starts": [starts], "vocabulary": [vocabulary.tobytes()], "index": [index.stored()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, words, starts, seen = [], [], [], {}
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = words_of(text)
                if len(own) < WINDOW:
                    continue
                docs.append(doc)
                starts.append(len(words))
                words += [*_hashes(own, seen), 0]
                if len(words) >= SHARD_WORDS:
                    yield shard(docs, words, starts)
                    docs, words, starts = [], [], []
        if words:
            yield shard(docs, words, starts)

    there = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return there.mapInPandas(run, "docs array<bigint>, starts array<int>, vocabulary binary, index binary")


def search_kept(index: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``(item_id, doc_id, first_word, words)``: the spans of indexed documents that hold at least twelve words of an item, counted in words.

    The items are made into blocks of about ``pass_chars`` characters by the tasks; every shard meets every block. Items of fewer
    than twelve words, null texts and rows without an id give nothing.
    """
    items = items.where("text is not null and item_id is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // pass_chars))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(i, _hashes(words_of(t), {})) for i, t in zip(pdf["item_id"], pdf["text"], strict=True)]
        own = [(i, ws) for i, ws in own if len(ws) >= WINDOW]
        flat = np.array([w for _, ws in own for w in ws], dtype=np.uint64)
        return pd.DataFrame({"ids": [[i for i, _ in own]], "sizes": [[len(ws) for _, ws in own]], "flat": [flat.tobytes()]})

    made = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInPandas(packed, "ids array<bigint>, sizes array<int>, flat binary")
    made = cut(made.withColumn("block", F.monotonically_increasing_id()))
    schema = "item_id bigint, doc_id bigint, first_word int, words int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, starts, vocabulary, raw, ids, sizes, flat in zip(*[batch[c] for c in ("docs", "starts", "vocabulary", "index", "ids", "sizes", "flat")], strict=True):
                known, words = np.frombuffer(vocabulary, dtype=np.uint64), np.frombuffer(flat, dtype=np.uint64)
                place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                symbols = np.where(known[place] == words, place + 1, 0) if len(known) else np.zeros(len(words), dtype=np.int64)
                ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
                begin = np.concatenate([np.arange(e - n, e - WINDOW + 1) for e, n in zip(ends, sizes, strict=True)]) if len(ids) else np.zeros(0, dtype=np.int64)
                number = np.repeat(np.arange(len(ids)), np.asarray(sizes, dtype=np.int64) - WINDOW + 1)
                yield _kept_hits(FMIndex.restored(raw), np.asarray(docs), np.asarray(starts), symbols, begin, number, np.asarray(ids))

    parts = []
    for r in made.select("block").collect():  # one number a block
        block = made.where(F.col("block") == r["block"]).drop("block")
        # (at most pass_chars characters, as numbers)
        parts.append(index.select("docs", "starts", "vocabulary", "index").crossJoin(F.broadcast(block)).mapInPandas(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else index.sparkSession.createDataFrame([], schema)


def _kept_hits(index: FMIndex, docs: np.ndarray, starts: np.ndarray, symbols: np.ndarray, begin: np.ndarray, number: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    which, low, high = index.search(symbols, begin, WINDOW)
    if not len(which):
        return pd.DataFrame([], columns=["item_id", "doc_id", "first_word", "words"])
    count = high - low
    at = index.locate(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    doc = np.searchsorted(starts, at, side="right") - 1
    hits = pd.DataFrame({"item": number[np.repeat(which, count)], "doc": doc, "at": at - starts[doc]}).drop_duplicates().sort_values(["doc", "item", "at"])
    same = (hits["doc"].eq(hits["doc"].shift()) & hits["item"].eq(hits["item"].shift()) & (hits["at"] <= hits["at"].shift() + WINDOW)).to_numpy()
    spans = hits.groupby((~same).cumsum()).agg(item=("item", "first"), doc=("doc", "first"), a=("at", "min"), b=("at", "max"))
    return pd.DataFrame({"item_id": ids[spans["item"]], "doc_id": docs[spans["doc"]], "first_word": spans["a"].to_numpy(), "words": (spans["b"] + WINDOW - spans["a"]).to_numpy()})
