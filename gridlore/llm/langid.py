"""Language identification by nearest centroid.

A text's letters become character bigrams and trigrams, hashed into a vector of sublinear term frequency
times inverse document frequency, of unit length. Each language has several centroids, found by spherical
k-means among its training texts; the nearest by cosine names the language, and a text further from its
centroid than nearly all of the training texts were is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import carried, quoted, seeded

BITS = 14
DIMENSIONS = 1 << BITS
CENTROIDS = 3
#: Bound of the sample that the centroids are fitted on: texts of a language, and of all; every language has CENTROIDS at least.
TEXTS_PER_LANGUAGE, TEXTS = 300, 30_000
#: Share of training texts that lie beyond the rejection distance, and how much further it is drawn.
REJECT_QUANTILE, REJECT_SLACK = 0.005, 0.8
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed letter bigrams and trigrams of the whole text; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    wide = code > 0xFFFF
    if wide.any():
        letter = letter.copy()
        letter[wide] = [chr(c).isalpha() for c in code[wide]]
    if not letter.any():
        return None
    spaced = np.where(letter, code, np.uint32(32))
    keep = letter | np.r_[False, letter[:-1]]  # runs of other characters count as one space
    c = np.concatenate([[32], spaced[keep], [32]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BITS)
    mix = lambda x: ((x ^ (x >> np.uint32(13))) * np.uint32(0x2C1B3C6D)) >> shift
    return np.bincount(np.concatenate([mix(two), mix(three)]), minlength=DIMENSIONS)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine of each language

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values of the unit vector."""
        at = np.flatnonzero(counts)
        v = (1 + np.log(counts[at])).astype(np.float32) * self.idf[at]
        norm = float(np.sqrt(v @ v))
        return at, v / norm if norm > 0 else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0 to 1, and whether the distance speaks against it."""
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        at, v = self.vector(counts)
        cosine = self.centroids[:, at] @ v
        k = int(np.argmax(cosine))
        best = float(min(max(cosine[k], 0.0), 1.0))
        return self.languages[self.owner[k]], best, bool(best < self.floors[self.owner[k]])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starts; fewer centroids than ``k`` where texts are few or alike."""
    centre = x.mean(axis=0)
    starts = [int(np.argmax(x @ centre))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)) and near.min() < 0.999:
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts].copy()
    for _ in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[mine == j].sum(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[sizes > 0]


def train(samples: list[tuple[str, np.ndarray]], df: np.ndarray | None = None, n: int = 0) -> Model:
    """Fits the centroids on (language, counts) samples; ``df`` of ``n`` texts, else of the samples, weighs the n-grams."""
    languages = sorted({s[0] for s in samples})
    if not samples:
        return Model([], np.empty(0, int), np.empty((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.empty(0))
    if df is None:
        n, df = len(samples), np.sum([c > 0 for _, c in samples], axis=0)
    model = Model(languages, np.empty(0, int), np.empty(0), np.log((1 + n) / (1 + df)).astype(np.float32) + 1, np.zeros(len(languages)))
    owner, all_centroids = [], []
    for i, lang in enumerate(languages):
        mine = [c for s, c in samples if s == lang]
        x = np.zeros((len(mine), DIMENSIONS), np.float32)
        for row, c in zip(x, mine):
            at, v = model.vector(c)
            row[at] = v
        found = cluster(x, CENTROIDS)
        model.floors[i] = REJECT_SLACK * float(np.quantile((x @ found.T).max(axis=1), REJECT_QUANTILE))
        owner += [i] * len(found)
        all_centroids.append(found)
    model.owner, model.centroids = np.array(owner), np.concatenate(all_centroids).astype(np.float32)
    return model


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows (t) each n-gram occurs, and how many rows have a letter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for frame in frames:
            for t in frame["t"]:
                c = gram_counts(t) if t else None
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": df[at]})

    df = np.zeros(DIMENSIONS + 1, np.int64)
    for r in texts.select("t").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIMENSIONS + 1 rows at most
        df[r["at"]] = r["n"]
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, *, text_col: str, lang_col: str, id_col: str, per_language: int = TEXTS_PER_LANGUAGE, most: int = TEXTS) -> Model:
    """Fits on all languages that occur; document frequencies are those of all training rows.

    The centroids are fitted on at most ``per_language`` texts of each language and about ``most`` in all,
    the first by a hash of the id among distinct rows whose language and id are not null. Executors turn
    them into counts, of bounded size, before the driver sees them. A centroid takes 64 kB.
    """
    rows = docs.select(docs[quoted(id_col)].alias("key"), docs[quoted(lang_col)].alias("lang"), docs[quoted(text_col)].alias("t"))
    usable = rows.where("lang IS NOT NULL AND key IS NOT NULL")
    n_languages = usable.select(F.count_distinct("lang")).first()[0]
    each = max(CENTROIDS, min(per_language, most // max(n_languages, 1)))
    order = Window.partitionBy("lang").orderBy(seeded(9, F.col("key")), "key", "sum")
    summed = usable.select("key", "lang", seeded(8, F.col("t")).alias("sum"))
    few = summed.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).drop("k")
    chosen = usable.withColumn("sum", seeded(8, F.col("t"))).join(F.broadcast(few), ["key", "lang", "sum"])
    texts = chosen.groupBy("key", "lang", "sum").agg(F.min("t").alias("t"))  # one of rows that repeat

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, key, text in zip(frame["lang"], frame["key"], frame["t"]):
                c = gram_counts(text) if text else None
                if c is not None:
                    at = np.flatnonzero(c)
                    out.append((lang, str(key), at.astype(np.int32).tobytes(), c[at].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "key", "at", "n"])

    samples = []
    for r in sorted(texts.select("lang", "key", "t").mapInPandas(count, "lang string, key string, at binary, n binary").collect()):
        c = np.zeros(DIMENSIONS, np.int32)
        c[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
        samples.append((r["lang"], c))
    return train(samples, *document_frequencies(usable))


def identify(docs: DataFrame, model: Model, *, text_col: str, carry: list[str]) -> DataFrame:
    """carry columns, lang_pred, score and rejected of every row of ``docs``, from its whole text alone.

    Null texts, empty ones and texts without a letter, and all texts where nothing was learned: ``und``, 0,
    rejected. Long texts are counted whole, in time in proportion; repeated rows are predicted alike; of
    tied centroids the first language by name wins. An empty table gives an empty result. A carried column
    named like an added one gives way to it, other names do no harm.
    """
    inner, back = carried(docs, carry, ["lang_pred", "score", "rejected"])
    kept = docs.select(*inner, docs[quoted(text_col)].alias("t"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema if f.name != "t") + "lang_pred string, score double, rejected boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [model.predict(t) for t in frame.pop("t")]
            yield frame.assign(lang_pred=[s[0] for s in said], score=[s[1] for s in said], rejected=[s[2] for s in said])

    return kept.mapInPandas(run, schema).select(*back, "lang_pred", "score", "rejected")
