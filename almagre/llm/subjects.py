"""Subject area of each document: term-weighted sentences, truncated SVD, refined seed centroids.

Each text is read once: its sentences' words become numbers, beside the document's id; all that follows works on these. The
sentences of all documents give the vocabulary (words and word pairs in a minimal share of them, and all words of the labelled
sample) with their inverse frequencies, and the truncated SVD by block power iteration over the table of distinct sentence
forms. Sentences of a bounded sample of labelled documents and the subjects' descriptions seed
centroids in that space, which are refined iteratively and get the subjects of the documents they
come from. Each sentence then goes to its nearest centroids by cosine similarity, and a document to the subjects of at
least a quarter of its sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagre.session import cut

#: Dimensions; passes of the power iteration; centroids; a document's share of sentences for a subject.
RANK, POWER, CENTROIDS, SHARE = 200, 3, 1200, 0.25
#: Least share of the sentences a term stands in. As a sentence has so many terms (about 23 here), no more than that over the share can
#: reach it, whatever the corpus' size. Words of the labelled sample and of the descriptions need no share, but a second sentence.
TERM_SHARE = 2.5e-4
#: Bounds of the labelled sample the centroids are fitted on: documents and characters, both expected values.
LABELLED_DOCS, LABELLED_CHARS = 10_000, 20_000_000
#: Subjects with their descriptions; they are columns of the model.
MOST_SUBJECTS = 10_000
#: Letters up to which a small word may link capitalised ones in title case ("de la").
LINK = 3
#: Entries a task gathers before it passes them on.
FLUSH = 200_000
#: Share of a centroid's sentences from documents of a subject from which it stands for the subject; sharpness of the vote.
PURE, SHARP = 0.6, 24

_sentence = re.compile(r"(?<=[.!?…])\s+|\n+")
_word = re.compile(r"[^\W_]+")


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that hold a word."""
    return [s for s in _sentence.split(text or "") if _word.search(s)]


def terms(sentence: str, memo: dict[str, str]) -> list[str]:
    """Words and pairs of neighbours, without numbers and names (capitals inside the sentence).

    A sentence in capitals or title case, without a small word longer than LINK after its first, says nothing of names; all its words count.
    """
    words, found = [], _word.findall(sentence)
    names = any(len(w) > LINK and w[0].islower() for w in found[1:])
    for k, w in enumerate(found):
        if not w.isdigit() and (k == 0 or not names or not w[0].isupper()):
            f = memo.get(w)
            if f is None:
                if len(memo) > FLUSH:
                    memo.clear()
                f = memo[w] = _fold(w)
            words.append(f)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _numbers(text: str | None, memo: dict[str, int]) -> tuple[list[int], list[int]]:
    """The words of a text's sentences as 32-bit hashes, by the rule of ``terms``, and where each sentence ends."""
    words: list[int] = []
    ends: list[int] = []
    for s in sentences(text):
        found = _word.findall(s)
        names = any(len(w) > LINK and w[0].islower() for w in found[1:])
        for k, w in enumerate(found):
            if k == 0 or not names or not w[0].isupper():
                n = memo.get(w)
                if n is None:
                    if len(memo) > FLUSH:
                        memo.clear()
                    n = memo[w] = 0 if w.isdigit() else xxhash.xxh32_intdigest(_fold(w)) or 1
                if n:
                    words.append(n)
        ends.append(len(words))
    return words, ends


def numbered(documents: DataFrame) -> DataFrame:
    """``(doc_id, chars, words, ends)``: each text's words as numbers (uint32) and its sentences' ends (int32)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words, ends = _numbers(text, memo)
                rows.append((doc, len(text), np.array(words, dtype=np.uint32).tobytes(), np.array(ends, dtype=np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "chars", "words", "ends"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chars int, words binary, ends binary")


def _terms_of(words: list[bytes], ends: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each sentence of some documents: (sentence, term), in order of term; and how many sentences each document has.

    A word is its number, a pair of neighbours the first one's number before the second one's: below and from 2**32.
    """
    parts = [np.frombuffer(w, dtype=np.uint32) for w in words]
    borders = [np.frombuffer(e, dtype=np.int32) for e in ends]
    per_doc = np.array([len(e) for e in borders], dtype=np.int64)
    sizes = np.concatenate([np.diff(e, prepend=np.int32(0)) for e in borders]) if len(borders) else np.zeros(0, dtype=np.int32)
    word = (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)).astype(np.int64)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pair = np.flatnonzero(sentence[1:] == sentence[:-1])
    # (unsigned pairs as signed numbers: the order doesn't matter)
    term = np.concatenate([word, (word[pair].astype(np.uint64) << np.uint64(32) | word[pair + 1].astype(np.uint64)).view(np.int64)])
    at = np.concatenate([sentence, sentence[pair]])
    order = np.argsort(term, kind="stable")  # (sentences are in order among the words and among the pairs, which differ)
    term, at = term[order], at[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (at[1:] != at[:-1])
    return at[new], term[new], per_doc


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: how many sentences hold each term; term 0 counts the sentences."""
    for batch in batches:
        _, term, per_doc = _terms_of(batch["words"].tolist(), batch["ends"].tolist())
        found, n = np.unique(term, return_counts=True)
        yield pd.DataFrame({"term": np.concatenate([[0], found]), "n": np.concatenate([[per_doc.sum()], n])})


def _forms_of(words: list[bytes], ends: list[bytes], known: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The form of each sentence, the numbers of its vocabulary terms in order; and how many sentences each document has."""
    at, term, per_doc = _terms_of(words, ends)
    place = np.minimum(np.searchsorted(known, term), len(known) - 1)
    there = known[place] == term
    at, place = at[there], place[there].astype(np.int32)
    order = np.argsort(at, kind="stable")  # terms are in order already, as the vocabulary is
    flat, begin = place[order].tobytes(), np.searchsorted(at[order], np.arange(per_doc.sum() + 1)) * 4
    return [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], per_doc


def _forms(vocabulary):
    """Per task: each distinct form with its number of sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = vocabulary.value, Counter()
        flat = lambda: pd.DataFrame(list(counts.items()), columns=["form", "n"])
        for batch in batches:
            counts.update(_forms_of(batch["words"].tolist(), batch["ends"].tolist(), known)[0])
            if len(counts) > FLUSH:
                yield flat()
                counts.clear()
        yield flat()

    return run


#: Entries of sentence forms multiplied at a time: by the rank they must fit the cache's order of magnitude.
ENTRIES_AT_ONCE = 20_000


class Space:
    """Sentence forms as sparse, weighted, normalised rows over the vocabulary."""

    def __init__(self, forms: list[bytes], idf: np.ndarray) -> None:
        parts = [np.frombuffer(f, dtype=np.int32) for f in forms]
        self.rows = len(parts)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]) if parts else np.zeros(1, dtype=np.int64)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.ends))
        weight = idf[self.ids]
        length = np.sqrt(np.bincount(self.row, weight**2, minlength=self.rows))
        self.weight = (weight / np.maximum(length[self.row], 1e-12)).astype(np.float32)

    def times(self, basis: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, basis.shape[1]), dtype=basis.dtype)
        # rows of equal length are one batch of small products
        sizes = np.diff(self.ends)
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(sizes[order]) > 0, [True]])) if self.rows else np.zeros(1, dtype=int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = int(sizes[order[a]])
            if not n:
                continue
            step = max(1, ENTRIES_AT_ONCE // n)
            for i in range(a, b, step):
                rows = order[i : min(b, i + step)]
                at = self.ends[rows][:, None] + np.arange(n)
                out[rows] = np.matmul(self.weight[at][:, None, :], basis[self.ids[at]])[:, 0]
        return out

    def add_transposed_times(self, total: np.ndarray, y: np.ndarray) -> None:
        """Adds X'y to ``total``."""
        order = np.argsort(self.ids, kind="stable")
        ids, row, weight = self.ids[order], self.row[order], self.weight[order]
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(ids) > 0, [True]])) if len(ids) else np.zeros(1, dtype=int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            # one term's forms: a row vector by the forms' rows
            total[ids[a]] += weight[a:b] @ y[row[a:b]]

    def embedded(self, basis: np.ndarray) -> np.ndarray:
        y = self.times(basis)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


#: Terms of one block of the summed products.
BLOCK = 512


#: Parts of a block that are added up in one call.
FAN_IN = 32


def _power_step(idf, basis):
    """Per task: its share of X'(X Q), in blocks of terms, weighted by each form's sentences; blocks that stay 0 aren't passed on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, q = idf.value, basis.value
        total = np.zeros_like(q, dtype=np.float64)
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.iloc[at : at + 20_000]
                x = Space(part["form"].tolist(), weights)
                x.add_transposed_times(total, x.times(q) * part["n"].to_numpy()[:, None])
        blocks = [b for b in range(0, len(weights), BLOCK) if total[b : b + BLOCK].any()]
        yield pd.DataFrame({"block": [b // BLOCK for b in blocks], "part": [total[b : b + BLOCK].astype(np.float32).tobytes() for b in blocks]})

    return run


def _sum_parts(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["part"].iloc[0]) // 4)
    for p in pdf["part"]:
        total += np.frombuffer(p, dtype=np.float32)
    return pd.DataFrame({"block": [group[0]], "part": [total.astype(np.float32).tobytes()]})


def svd_basis(forms: DataFrame, idf: np.ndarray, rank: int, passes: int) -> np.ndarray:
    """The right singular vectors of the weighted forms, terms by rank, by block power iteration.

    The tasks' products are added up by a tree: no call sees more than about FAN_IN parts of a block, however many tasks there are.
    """
    sc = forms.sparkSession.sparkContext
    rank = min(rank, len(idf))
    q = np.linalg.qr(np.random.default_rng(10).normal(size=(len(idf), rank)))[0].astype(np.float32)
    weights, tasks = sc.broadcast(idf), forms.rdd.getNumPartitions()
    for _ in range(passes):
        shared = sc.broadcast(q)
        parts, left = forms.mapInPandas(_power_step(weights, shared), "block int, part binary"), tasks
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            slot = F.pmod(F.spark_partition_id() if left * FAN_IN >= tasks else F.xxhash64("part"), F.lit(left)).alias("slot")
            parts = parts.select("block", "part", slot).groupBy("block", "slot").applyInPandas(_sum_parts, "block int, part binary")
        summed = parts.groupBy("block").applyInPandas(_sum_parts, "block int, part binary").toArrow()
        product = np.zeros((len(idf), rank), dtype=np.float32)
        for block, part in zip(summed["block"].to_pylist(), summed["part"], strict=True):
            at = block * BLOCK
            product[at : at + BLOCK] = np.frombuffer(part.as_buffer(), dtype=np.float32).reshape(-1, rank)
        q = np.linalg.qr(product)[0]
        shared.unpersist()
    return q


def refined_centroids(y: np.ndarray, weight: np.ndarray, labelled: np.ndarray, centroids: int = CENTROIDS, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of embedded forms and each one's share of every subject (the last column: no subject).

    Seeds are taken farthest first until all forms are near one, then refined as spherical means. ``labelled`` holds, per form, the
    weight of its sentences from documents of each subject.
    """
    at, best, seeds = int(weight.argmax()), np.full(len(y), -1.0), []
    for _ in range(min(centroids, len(y))):
        seeds.append(at)
        best = np.maximum(best, y @ y[at])
        at = int(best.argmin())
        if best[at] > 0.9:
            break
    c = y[seeds]
    for _ in range(rounds):
        near = _nearest(y, c)
        moved = np.zeros_like(c)
        np.add.at(moved, near, y * weight[:, None])
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        c = np.where(length > 0, moved / np.maximum(length, 1e-12), c)
    near = _nearest(y, c)
    share = np.zeros((len(c), labelled.shape[1]))
    np.add.at(share, near, labelled)
    total = np.bincount(near, weight, minlength=len(c))
    share /= np.maximum(total, 1e-12)[:, None]
    pure = share.max(axis=1) >= PURE
    votes = np.zeros((len(c), labelled.shape[1] + 1))
    votes[np.arange(len(c)), np.where(pure, share.argmax(axis=1), labelled.shape[1])] = np.where(total > 0, 1, 0)
    return c, votes


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(y[i : i + 5000] @ c.T).argmax(axis=1) for i in range(0, len(y), 5000)]) if len(y) else np.zeros(0, int)


def _sharpened(x: np.ndarray) -> np.ndarray:
    """``x ** SHARP`` by squaring."""
    out, power, n = None, x, SHARP
    while n:
        if n & 1:
            out = power if out is None else out * power
        n >>= 1
        if n:
            power = power * power
    return out


def _assign(forms: list[bytes], model: dict) -> np.ndarray:
    """The subject of each form, or the number of subjects for none."""
    none = model["votes"].shape[1] - 1
    out = np.full(len(forms), none)
    for at in range(0, len(forms), 5000):
        y = Space(forms[at : at + 5000], model["idf"]).embedded(model["basis"])
        near = np.maximum(y @ model["centroids"].T, 0)
        top = near.max(axis=1)
        with np.errstate(under="ignore"):
            vote = _sharpened(near / np.maximum(top, 1e-12)[:, None]) @ model["votes"]
        out[at : at + 5000] = np.where(top > 0.2, vote.argmax(axis=1), none)
    return out


def _classify(model, names: list[str], share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, done = model.value, {}
        for batch in batches:
            numbers = batch["doc_id"].tolist()
            rows, per_doc = _forms_of(batch["words"].tolist(), batch["ends"].tolist(), m["known"])
            docs = np.repeat(np.arange(len(numbers)), per_doc)
            new = list(dict.fromkeys(f for f in rows if f not in done))
            done.update(zip(new, _assign(new, m).tolist(), strict=True))
            at = docs
            subject = np.array([done[f] for f in rows], dtype=np.int64)
            if len(done) > FLUSH:
                done.clear()
            if not len(rows):
                continue
            table = np.zeros((len(numbers), len(names) + 1), dtype=np.int64)
            np.add.at(table, (at, subject), 1)
            total = table.sum(axis=1)
            d, s = np.nonzero((table[:, :-1] > 0) & (table[:, :-1] >= share * total[:, None]))
            found = [(numbers[i], names[j], int(table[i, j]), int(total[i])) for i, j in zip(d, s, strict=True)]
            yield pd.DataFrame(found, columns=["doc_id", "subject", "sentences", "of_sentences"])

    return run


def subjects_of(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, rank: int = RANK, share: float = SHARE,
    labelled_docs: int = LABELLED_DOCS, labelled_chars: int = LABELLED_CHARS,
) -> DataFrame:
    """``(doc_id, subject, sentences, of_sentences)``: each subject that at least ``share`` of a document's sentences are about.

    Null and empty texts and rows without an id have no subject; a repeated document gives its rows as often; labels of subjects that aren't
    in ``subjects`` (such as "none") count as no subject. The vocabulary, its weights and the SVD cover all
    documents; the centroids are fitted on labelled documents within the two bounds.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    schema = "doc_id bigint, subject string, sentences bigint, of_sentences bigint"
    described = subjects.where("subject is not null").select("subject", "about").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(described) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects and descriptions")
    names = sorted({r["subject"] for r in described})
    docs = cut(numbered(documents.where("text is not null and doc_id is not null")))

    # the labelled sample: whole documents, chosen by a hash of their id
    by_doc = cut(labels.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("own")))
    size = docs.select("doc_id", "chars").join(by_doc.select("doc_id"), "doc_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()
    part = min(1.0, labelled_docs / max(1, size["n"]), labelled_chars / max(1, size["chars"] or 1))
    chosen_docs = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))
    sample = docs.join(F.broadcast(chosen_docs), "doc_id")  # about labelled_docs rows

    counts = cut(docs.select("words", "ends").mapInPandas(_count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")))
    n = counts.where("term = 0").agg(F.sum("n")).first()[0] or 0
    if not n or not names:
        return spark.createDataFrame([], schema)
    memo: dict[str, int] = {}
    told = [(_numbers(r["about"], memo), r["subject"]) for r in described if r["about"]]
    of_sample = sample.select("words").mapInPandas(_distinct_words, "term bigint").distinct()
    own = of_sample.unionByName(spark.createDataFrame([(w,) for (ws, _), _ in told for w in ws], "term bigint")).distinct()
    often = counts.where((F.col("n") >= max(2.0, n * TERM_SHARE)) & (F.col("term") != 0))
    rare = counts.where((F.col("n") >= 2) & (F.col("n") < n * TERM_SHARE)).join(F.broadcast(own), "term")  # at most the sample's words
    chosen = often.unionByName(rare.select("term", "n")).toArrow()
    order = np.argsort(chosen["term"].to_numpy())
    known, idf = chosen["term"].to_numpy()[order], np.log(n / chosen["n"].to_numpy()[order].astype(np.float64))
    if not len(known):
        return spark.createDataFrame([], schema)
    vocabulary = sc.broadcast(known)

    forms = cut(docs.select("words", "ends").mapInPandas(_forms(vocabulary), "form binary, n bigint").groupBy("form").agg(F.sum("n").alias("n")))
    basis = svd_basis(forms, idf, rank, POWER)

    def labelled_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, per_doc = _forms_of(batch["words"].tolist(), batch["ends"].tolist(), vocabulary.value)
            weights = np.repeat(1 / np.maximum(1, per_doc) ** 0.5, per_doc)
            of = np.repeat(["\x00".join(o) for o in batch["own"]], per_doc) if len(batch) else []
            yield pd.DataFrame({"form": found, "own": of, "w": weights})

    fitted = (
        sample.select("words", "ends", "own").mapInPandas(labelled_forms, "form binary, own string, w double")
        .groupBy("form", "own").agg(F.sum("w").alias("w")).toArrow()
    )
    at = {s: i for i, s in enumerate(names)}
    seen: dict[bytes, np.ndarray] = {}
    rows = list(zip(fitted["form"].to_pylist(), fitted["own"].to_pylist(), fitted["w"].to_pylist(), strict=True))
    for (words, _), subject in told:
        # a description is one sentence
        whole = np.array(words, dtype=np.uint32).tobytes(), np.array([len(words)], dtype=np.int32).tobytes()
        rows.append((_forms_of([whole[0]], [whole[1]], known)[0][0], subject, 1.0))
    for form, of, w in rows:
        if not form:
            continue
        row = seen.setdefault(form, np.zeros(len(names) + 1, dtype=np.float32))
        row[-1] += w
        for s in of.split("\x00"):
            if s in at:
                row[at[s]] += w
    keys = sorted(seen)
    if not keys:
        return spark.createDataFrame([], schema)
    mass = np.array([seen[k] for k in keys])
    y = Space(keys, idf).embedded(basis)
    c, votes = refined_centroids(y, mass[:, -1], mass[:, :-1])
    model = sc.broadcast({"known": known, "idf": idf, "basis": basis, "centroids": c.astype(np.float32), "votes": votes.astype(np.float32)})
    return docs.select("doc_id", "words", "ends").mapInPandas(_classify(model, names, share), schema)


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [np.frombuffer(w, dtype=np.uint32) for w in batch["words"]]
        yield pd.DataFrame({"term": np.unique(np.concatenate(words)).astype(np.int64) if words else np.zeros(0, dtype=np.int64)})
