"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

The items are the documents of the index, a passage's distinct words the query. Contributions are divided
by the score an item gives itself, so a score is the share of the item that a passage covers and one
threshold serves all items. Block-max WAND retrieves every item at or above it: postings are cut into
blocks of items whose largest contributions bound what a block can reach, and a traversal skips lists by
their upper bounds. What is retrieved is verified: question and answer must each overlap the passage.

Document frequencies, their number, mean and greatest length are counted once over all items, in the
cluster. An index too large for a task is cut by items, and each part uses these common statistics, so hits
and scores are the same for any number of parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat, takewhile
from math import fsum
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import cut, seeded

K1, B = 1.2, 0.75
BLOCK = 4
#: Postings of one index, which every task holds (24 bytes each, and the items' texts); each part is one pass over the documents.
MAX_POSTINGS = 4_000_000
#: Ids of items that are broadcast to the hits (40 bytes each); more are joined by shuffle.
MAX_BROADCAST_ITEMS = 200_000
#: Passages of one document searched at a time.
PASSAGES = 512
#: Passages overlap by half and hold at least this many words; longer items make them longer.
LEAST_PASSAGE = 128
THRESHOLD, OVERLAP, GRAM = 0.6, 0.7, 3
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
HIT = "passage int, score double, question_overlap double, answer_overlap double"
NAMES = [c.split()[0] for c in HIT.split(", ")]


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; one sentence alone is a question."""
    parts = [w for s in SENTENCE.split(text.strip()) if (w := normal_words(s))]
    if len(parts) < 2:
        return [w for p in parts for w in p], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Distinct word trigrams; of fewer words, the whole sequence."""
    if len(words) < GRAM:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(GRAM))))


class Corpus(NamedTuple):
    """Statistics of all items, whatever part of them an index holds."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        counted = [w for t in texts if (w := normal_words(t))]
        lengths = [len(w) for w in counted]
        return cls(len(counted), sum(lengths) / max(len(counted), 1), max(lengths, default=0), dict(Counter(x for w in counted for x in set(w))))


class Index:
    """Inverted lists of (key, text) items with block maxima, as sorted arrays."""

    def __init__(self, items: list[tuple[object, str]], corpus: Corpus):
        kept = [(i, w, question_answer(t)) for i, t in sorted(items) if (w := normal_words(t))]
        self.ids = [k[0] for k in kept]
        self.parts = [tuple(grams(p) for p in k[2]) for k in kept]
        self.longest = corpus.longest
        self.terms: dict[str, int] = {}
        term, doc, share = [], [], []
        for d, (_, words, _) in enumerate(kept):
            norm = K1 * (1 - B + B * len(words) / corpus.mean)
            raw = {w: np.log(1 + (corpus.n - corpus.df[w] + 0.5) / (corpus.df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in Counter(words).items()}
            own = sum(raw.values())
            for w, x in raw.items():
                term.append(self.terms.setdefault(w, len(self.terms)))
                doc.append(d)
                share.append(x / own)
        order = np.argsort(np.array(term, np.int64), kind="stable")  # by term, then item
        term, self.doc, self.share = np.array(term, np.int64)[order], np.array(doc, np.int64)[order], np.array(share)[order]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.top = np.maximum.reduceat(self.share, self.start[:-1]) if len(term) else np.empty(0)
        self.blocks = -(-len(kept) // BLOCK)
        #: largest contribution of a term in each block that has it
        key = term * max(self.blocks, 1) + self.doc // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.block = (key % max(self.blocks, 1))[first]
        self.block_max = np.maximum.reduceat(self.share, first) if len(key) else np.empty(0)
        self.block_start = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.lists: dict[int, tuple[list[int], list[float]]] = {}

    def postings(self, term: int) -> tuple[list[int], list[float]]:
        """Items and contributions of a term, as lists once a traversal asks for them."""
        found = self.lists.get(term)
        if found is None:
            here = slice(self.start[term], self.start[term + 1])
            found = self.lists[term] = (self.doc[here].tolist(), self.share[here].tolist())
        return found

    def live(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Sorted keys passage * blocks + block of all that may hold an item at the threshold.

        ``passage`` and ``term`` are distinct pairs in order of passage, of ``n`` passages. The terms of least
        upper bounds, together under an eighth of the threshold, cannot carry an item there alone: only the lists
        of the others are opened, and what is left out is added to the bound.
        """
        top = self.top[term]
        order = np.lexsort((top, passage))
        sums = np.cumsum(top[order])
        begins = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.empty(0, np.int64)
        base = np.zeros(n)
        base[passage[begins]] = sums[begins] - top[order][begins]
        low = sums - base[passage[order]] < threshold / 8
        spare = np.bincount(passage[order][low], top[order][low], n)
        essential = order[~low]
        t, p = term[essential], passage[essential]
        size = self.block_start[t + 1] - self.block_start[t]
        at = np.repeat(self.block_start[t] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        key = np.repeat(p, size) * self.blocks + self.block[at]
        if n * self.blocks <= 8 * len(key):
            reach = np.bincount(key, self.block_max[at], n * self.blocks)
            found = np.flatnonzero(reach)
            reach = reach[found]
        else:
            found, where = np.unique(key, return_inverse=True)
            reach = np.bincount(where, self.block_max[at], len(found))
        return found[reach + spare[found // max(self.blocks, 1)] >= threshold - 1e-6]

    def search(self, terms: list[int], threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold, by block-max WAND; ``blocks`` are the sorted ones that may hold any."""
        slack = threshold - 1e-6
        lists = [(*self.postings(t), float(self.top[t])) for t in terms]
        at = [0] * len(lists)
        out = []
        end = len(self.ids)
        head = [docs[0] for docs, _, _ in lists]

        def skip(k: int, to: int) -> None:
            docs = lists[k][0]
            at[k] = bisect_left(docs, to, at[k])
            head[k] = docs[at[k]] if at[k] < len(docs) else end

        order = list(range(len(lists)))
        while True:
            order.sort(key=head.__getitem__)
            total, pivot = 0.0, end
            for k in order:
                if head[k] == end:
                    break
                total += lists[k][2]
                if total >= slack:
                    pivot = head[k]
                    break
            if pivot == end:
                return out
            if blocks is not None:  # to the next block that may reach the threshold
                b = bisect_left(blocks, pivot // BLOCK)
                if b == len(blocks):
                    return out
                if blocks[b] > pivot // BLOCK:
                    for k in order:
                        skip(k, blocks[b] * BLOCK)
                    continue
            if head[order[0]] == pivot:
                here = takewhile(lambda k: head[k] == pivot, order)  # noqa: B023
                score = fsum(lists[k][1][at[k]] for k in here)  # the same in any order of the lists
                if score >= slack:
                    out.append((pivot, score))
                for k in order:
                    if head[k] > pivot:
                        break
                    skip(k, pivot + 1)
            else:
                for k in order:
                    if head[k] >= pivot:
                        break
                    skip(k, pivot)

    def hits(self, text: str | None, threshold: float, overlap: float) -> list[tuple]:
        """(key, passage, score, question overlap, answer overlap) of the best passage of each item found."""
        if not text or not self.ids:
            return []
        words = normal_words(text)
        if not words:
            return []
        stride = max(LEAST_PASSAGE // 2, self.longest)
        n = max(1, -(-len(words) // stride) - 1)  # passage p holds words p*stride to (p+2)*stride
        term = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        best: dict[int, tuple] = {}
        for first in range(0, n, PASSAGES):
            last = min(first + PASSAGES, n)
            mine = term[first * stride : (last + 1) * stride]
            where = np.flatnonzero(mine >= 0)
            half = where // stride
            late = half > 0  # a word is in the passage that starts with its half, and in the one before
            early = half < last - first
            pairs = np.unique(np.concatenate([half[early] * len(self.terms) + mine[where[early]], (half[late] - 1) * len(self.terms) + mine[where[late]]]))
            passage, kinds = pairs // len(self.terms), pairs % len(self.terms)
            live = self.live(passage, kinds, last - first, threshold)
            if not len(live):
                continue
            at, block = live // self.blocks, live % self.blocks
            for p in np.unique(at):
                mine_terms = kinds[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")].tolist()
                found = self.search(mine_terms, threshold, block[np.searchsorted(at, p) : np.searchsorted(at, p, "right")].tolist())
                if not found:
                    continue
                q = first + int(p)
                small = words[q * stride : (q + 2) * stride]
                have = grams(small)
                for doc, score in found:
                    asked, answered = (self._overlap(part, have, small) for part in self.parts[doc])
                    if asked >= overlap and answered >= overlap and (doc not in best or score > best[doc][2] + 1e-9):
                        best[doc] = (self.ids[doc], q, min(1.0, float(score)), asked, answered)
        return [best[d] for d in sorted(best)]

    @staticmethod
    def _overlap(part: set, have: set, words: list[str]) -> float:
        if not part:
            return 1.0
        size = len(next(iter(part)))
        if size < GRAM:
            have = set(zip(*(words[i:] for i in range(size))))
        return len(part & have) / len(part)


def parsed_items(items: DataFrame) -> DataFrame:
    """(key, text, words, terms) of the distinct texts that have a word: digest, text, length, distinct words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counted = [normal_words(t) for t in frame["text"]]
            yield frame.assign(words=np.array([len(w) for w in counted], np.int64), terms=[sorted(set(w)) for w in counted])

    texts = items.where("text IS NOT NULL").select("text").distinct().select(F.sha2("text", 256).alias("key"), "text")
    return texts.mapInPandas(run, "key string, text string, words long, terms array<string>").where("words > 0")


def indexes(items: DataFrame, most: int) -> Iterator[Index]:
    """The index of all items, in parts of about ``most`` postings each; statistics are those of all items."""
    parsed = cut(parsed_items(items))
    n, words, longest, postings = parsed.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if not n:
        return
    df = cut(parsed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n_parts = -(-postings // most)
    for part in range(n_parts):
        mine = parsed.where(F.pmod(seeded(3, F.col("key")), F.lit(n_parts)) == part)
        here = mine.select(F.explode("terms").alias("term")).distinct().join(df, "term")
        corpus = Corpus(n, words / n, longest, {r["term"]: r["df"] for r in here.collect()})  # at most ``most`` terms, in the mean
        yield Index([(r["key"], r["text"]) for r in mine.select("key", "text").collect()], corpus)


def contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = MAX_POSTINGS) -> DataFrame:
    """(id, item_id, passage, score, question_overlap, answer_overlap): every item found in every row.

    ``items`` has (item_id, text). Rows without a hit, null and empty texts give no row; a repeated row
    gives its hits again. Items of null or empty text are never found; of equal items each is reported, and
    counts once in the statistics. ``passage`` numbers the half-overlapping passages of the text. The whole
    text is searched, in time and memory in proportion to its length. An empty table on either side gives an
    empty result. Other columns of either table are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    found = None
    for index in indexes(items, most):

        def run(frames: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [(i, *h) for i, t in zip(frame["id"], frame["t"]) for h in index.hits(t, threshold, overlap)]
                yield pd.DataFrame(out, columns=["id", "key", *NAMES])

        more = slim.mapInPandas(run, f"id {kind}, key string, {HIT}")
        found = more if found is None else found.union(more)
    named = items.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), F.col("item_id").cast("long").alias("item_id"))
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"id {kind}, key string, {HIT}")
    if named.limit(MAX_BROADCAST_ITEMS + 1).count() <= MAX_BROADCAST_ITEMS:
        named = F.broadcast(named)
    return found.join(named, "key").select(F.col("id").alias(id_col), "item_id", *NAMES)
