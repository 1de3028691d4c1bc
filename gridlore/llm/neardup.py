"""Near-duplicate components: bottom-k sketches of one hash, inverted lists, exact Jaccard.

1. Every document becomes its set of shingles under one 64-bit hash function; the k least hashes are its
   sketch. Equal sets (a 128-bit digest of the whole set) collapse to one representative with a number of
   its own; document ids only name the result.
2. Inverted lists of the retained hashes generate overlaps. Two sets at the threshold share at least
   ``overlap_floor`` retained hashes, so it is enough that each representative enters the lists of its
   rarest hashes (prefix filtering); a hash that no other representative retains needs no list.
3. Lists are not expanded into pairs. Each is tied to one pivot, and the ties' components are families:
   any two sets that may be linked lie in one family. Each member is compared with its family's centre on
   whole sets. Jaccard distance is a metric, so a member linked with the centre can be linked only with
   members within twice the distance of the threshold: those in between are compared with the linked
   ones, and centre and linked ones are done. The members not linked go on to the next round, with
   families of their own, which fall apart where only the centre held them together.
4. What is left after the rounds is compared within its families in pairs of blocks. A task holds two
   blocks, of bounded size, and returns a spanning forest of the links found, not the links. The
   union-sketch estimate filters; what passes is compared on whole sets. Components of the links are the
   result.

The loss of step 2 is a tail of a binomial law: five and a half standard deviations, under one in ten
million for a pair exactly at the threshold and vanishing above it. Sets no larger than the sketch are
exact. Links themselves are always confirmed on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import cut, hot_join, quoted, seeded, text_key
from gridlore.llm.graph import components

SKETCH = 64
SIGMAS = 5.5
#: Rounds with a new centre for each family, before families are compared in blocks.
ROUNDS = 1
#: Hashes of a block's sets and MEMBER for each of them: 4 MB and 1024 members at most; a task of step 4 holds two blocks.
BLOCK, MEMBER = 1 << 19, 512
#: Hashes of the sets that are compared with a centre in one part, and MEMBER for each of them.
PART = 1 << 17
#: Representatives whose text digests are broadcast to find their texts (16 bytes each).
MAX_BROADCAST_REPS = 1_000_000
#: Words whose hashes a worker remembers.
MEMORY = 200_000


class _Hashes(dict):
    """xxh64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z.

    A text of fewer words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b"\x20".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    x = h[:n] * _M1
    for i in range(1, width):
        x ^= x >> _S29
        x = (x + h[i : n + i]) * _M1
    x ^= x >> _S32
    x *= _M2
    x ^= x >> _S32
    return np.unique(x)


def overlap_floor(size: int, percent: int, k: int = SKETCH) -> int:
    """Retained hashes that two linked sets share at least, for a sketch of ``size`` hashes."""
    t = percent / 100
    usual = math.floor(k * t - SIGMAS * math.sqrt(k * t * (1 - t)))
    return max(1, min(usual, -(-percent * size // 100)))


def linked(inter: int | np.ndarray, a: int, b: int | np.ndarray, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def union_estimate(one: np.ndarray, many: np.ndarray, sizes: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """Of the k least hashes of each union of ``one`` with a row of ``many``, the share that both retain.

    Rows of ``many`` are sketches padded with the largest hash; ``sizes`` are their true lengths.
    """
    at = np.searchsorted(one, many)
    both = (one[np.minimum(at, len(one) - 1)] == many) & (np.arange(many.shape[1]) < sizes[:, None])
    before = np.cumsum(both, axis=1) - both
    rank = at + np.arange(many.shape[1]) - before
    union = len(one) + sizes - both.sum(axis=1)
    return (both & (rank < k)).sum(axis=1) / np.minimum(union, k)


def estimate_floor(percent: int, k: int = SKETCH) -> float:
    t = percent / 100
    return t - SIGMAS * math.sqrt(t * (1 - t) / k)


def _pad(sets: list[np.ndarray], k: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([min(len(s), k) for s in sets], np.int64)
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        out[i, : sizes[i]] = s[:k]
    return out, sizes


class Lists:
    """Inverted lists over sets: how many values each of them shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), sizes)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.owner, self.many = owner[order], len(sets)
        self.values, self.start = np.unique(values[order], return_index=True)
        self.size = np.diff(np.r_[self.start, len(values)])

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, s)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == s)] if len(self.values) else at[:0]
        size = self.size[at]
        places = np.repeat(self.start[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(at) else at
        return np.bincount(self.owner[places], minlength=self.many)


#: Candidates of a set that are compared one by one; more are counted at once over inverted lists.
FEW = 24


def link_blocks(rows: list[np.ndarray], others: list[np.ndarray], row_ids: list, other_ids: list, percent: int, tied: list[bool] | None = None) -> Iterator[tuple]:
    """A spanning forest of the links between ``rows`` and ``others``, each verified on whole sets.

    Inverted lists of retained hashes count the overlaps of a row with all others; where enough is shared,
    the union-sketch estimate filters few candidates, and whole sets decide. ``tied`` marks others that are
    known to be linked with each other. What is already connected is not compared again.
    """
    sketches, kept = _pad(others)
    sizes = np.array([len(s) for s in others])
    floor = estimate_floor(percent)
    ids, where = np.unique(np.array([*row_ids, *other_ids]), return_inverse=True)
    row_at, other_at = where[: len(rows)], where[len(rows) :]
    label = np.arange(len(ids))
    if tied is not None and any(tied):
        label[other_at[np.array(tied, bool)]] = len(ids)
    retained, full = Lists([s[:SKETCH] for s in others]), None
    for k, (s, a) in enumerate(zip(rows, row_ids)):
        n = len(s)
        fits = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
        near = fits & (label[other_at] != label[row_at[k]])
        if not near.any():
            continue
        near = np.flatnonzero(near & (retained.overlaps(s[:SKETCH]) >= overlap_floor(min(n, SKETCH), percent)))
        if len(near) > FEW:
            full = full or Lists(others)
            hits = near[linked(full.overlaps(s)[near], n, sizes[near], percent)]
        else:
            estimate = union_estimate(s[:SKETCH], sketches[near], kept[near])
            hits = (j for j in near[estimate >= floor] if linked(np.isin(others[j], s, assume_unique=True).sum(), n, sizes[j], percent))
        for j in hits:
            mine, its = label[row_at[k]], label[other_at[j]]
            if mine != its:
                label[label == its] = mine
                yield a, other_ids[j]


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def sketch(docs: DataFrame, *, text_col: str, id_col: str, width: int) -> DataFrame:
    """(id, t1, t2, n, d1, d2, sketch) of every row: digest of its text, set size, digest of the set, its least hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, width) for t in frame.pop("t")]
            digests = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
            yield frame.assign(
                n=np.array([len(s) for s in sets], np.int64),
                d1=np.array([d >> 64 for d in digests], np.uint64).view(np.int64),
                d2=np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64),
                sketch=[s[:SKETCH].view(np.int64) for s in sets],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[quoted(text_col)]
    return docs.select(docs[quoted(id_col)].alias("id"), *text_key(text), text.alias("t")).mapInPandas(run, f"id {kind}, t1 long, t2 long, n long, d1 long, d2 long, sketch array<long>")


def list_entries(reps: DataFrame, percent: int) -> DataFrame:
    """(rep, n, score, v): the lists v that each representative of ``reps`` (rep, n, sketch) enters; ``score`` counts whom it meets.

    A value's list enters through its count, never as a collected group.
    """
    # entries a sketch of each size may leave out, as one small literal
    skips = F.array(*[F.lit(overlap_floor(max(s, 1), percent)) for s in range(SKETCH + 1)])
    values = reps.select("rep", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("rep", "n", "s").agg(F.collect_list(F.struct("df", "v")).alias("vs"))  # at most SKETCH values
    prefix = F.col("s") - F.get(skips, F.col("s").cast("int")) + 1 - (F.col("s") - F.size("vs"))
    score = F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    chosen = held.withColumn("p", prefix.cast("int")).where("p > 0").select("rep", "n", score.alias("score"), F.slice(F.array_sort("vs"), 1, F.greatest(F.col("p"), F.lit(0))).alias("vs"))
    return cut(chosen.select("rep", "n", "score", F.explode("vs.v").alias("v")))


def families(entries: DataFrame) -> DataFrame:
    """(rep, n, fam, centre, k): representatives that share a list with another, by family, and the parts that it is dealt out in."""
    pivots = entries.groupBy("v").agg(F.max(F.struct("score", "rep")).alias("top"), F.count("*").alias("m")).where("m > 1").select("v", F.col("top.rep").alias("pivot"))
    ties = entries.join(pivots, "v").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).where("a <> b").distinct()
    rooted = components(ties)
    named = rooted.select(F.col("node").alias("rep"), F.col("root").alias("fam")).union(rooted.select(F.col("root").alias("rep"), F.col("root").alias("fam")).distinct())
    scores = entries.groupBy("rep").agg(F.first("n").alias("n"), F.first("score").alias("score"))
    member = cut(named.join(scores, "rep"))
    centre = member.groupBy("fam").agg(F.max(F.struct("score", "rep")).alias("top"), F.ceil(F.sum(F.col("n") + MEMBER) / PART).cast("int").alias("k")).select("fam", F.col("top.rep").alias("centre"), "k")
    return cut(member.select("rep", "n", "fam").join(centre, "fam"))


def whole_sets(docs: DataFrame, classes: DataFrame, *, text_col: str, width: int) -> DataFrame:
    """(rep, n, set) of the representatives in ``classes`` (rep, n, t1, t2), from one text each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="t").assign(set=[shingle_set(t, width).tobytes() for t in frame["t"]])

    if classes.limit(MAX_BROADCAST_REPS + 1).count() <= MAX_BROADCAST_REPS:
        classes = F.broadcast(classes)
    text = docs[quoted(text_col)]
    texts = docs.select(*text_key(text), text.alias("t")).join(classes, ["t1", "t2"])
    once = texts.groupBy("rep", "n").agg(F.min("t").alias("t"))  # a text that repeats is met once
    return cut(once.mapInPandas(run, "rep long, n long, set binary"))


def centred(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(rep, fam, n, ring) of all members but the centres: 0 linked with the centre, 1 within twice that distance, 2 beyond.

    A family's members are dealt out in parts, each behind a copy of the centre's set, and pass
    through a task as a stream.
    """
    part = F.pmod(seeded(2, F.col("rep")), F.col("k")).cast("int")
    parts = F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(part))
    dealt = sets.select("rep", "set").join(members, "rep").select("fam", F.explode(parts).alias("part"), (F.col("rep") != F.col("centre")).alias("row"), "rep", "n", "set")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, middle = None, np.empty(0, np.uint64)
        for frame in frames:
            out = []
            for fam, part, row, rep, n, raw in zip(*(frame[c] for c in ("fam", "part", "row", "rep", "n", "set"))):
                if not row:
                    key, middle = (fam, part), _unpack(raw)
                elif key == (fam, part):
                    out.append((rep, fam, n, ring(middle, _unpack(raw), percent)))
                else:
                    raise ValueError(f"no centre before the members of {fam}")
            yield pd.DataFrame(out, columns=["rep", "fam", "n", "ring"])

    return cut(dealt.repartition("fam", "part").sortWithinPartitions("fam", "part", "row").mapInPandas(run, "rep long, fam long, n long, ring int"))


def ring(a: np.ndarray, b: np.ndarray, percent: int) -> int:
    """0 if two sets are linked, 1 if both may be linked with a third, else 2, by their exact similarity."""
    if len(a) and len(b) and 100 * min(len(a), len(b)) >= (2 * percent - 100) * max(len(a), len(b)):
        at = np.searchsorted(a, b)
        inter = int((a[np.minimum(at, len(a) - 1)] == b).sum())
        if linked(inter, len(a), len(b), percent):
            return 0
        if 100 * inter >= (2 * percent - 100) * (len(a) + len(b) - inter):
            return 1
    return 2


def in_blocks(sets: DataFrame, sides: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) links that span what all links would between the rows and the others of each family.

    ``sides`` has (rep, fam, n, row, other): on which sides a member stands. The others of a member that is no
    row are known to be linked with each other. Each pair of blocks of a family is one group.
    """
    sums = sides.groupBy("fam").agg(*[F.ceil(F.sum(F.when(F.col(c), F.col("n") + MEMBER)) / block).cast("int").alias(k) for c, k in (("row", "bi"), ("other", "bj"))])
    open_ = sums.where("bi > 0 AND bj > 0")
    placed = sides.join(open_, "fam")
    mine = lambda n, seed: F.pmod(seeded(seed, F.col("rep")), F.col(n)).cast("int")
    # a member stands in its block of others against every block of rows, and the other way round
    as_other = F.transform(F.sequence(F.lit(0), F.col("bi") - 1), lambda i: F.struct(i.alias("i"), mine("bj", 2).alias("j"), F.lit(False).alias("as_row")))
    as_row = F.transform(F.sequence(F.lit(0), F.col("bj") - 1), lambda j: F.struct(mine("bi", 1).alias("i"), j.alias("j"), F.lit(True).alias("as_row")))
    cells = F.explode(F.when(~F.col("row"), as_other).when(~F.col("other"), as_row).otherwise(F.concat(as_other, as_row))).alias("cell")
    dealt = placed.select("rep", "fam", "row", cells).select("rep", "fam", (~F.col("row")).alias("tied"), "cell.*").join(sets.select("rep", "set"), "rep")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        a, b = frame[frame["as_row"]], frame[~frame["as_row"]]
        out = link_blocks([_unpack(x) for x in a["set"]], [_unpack(x) for x in b["set"]], a["rep"].tolist(), b["rep"].tolist(), percent, b["tied"].tolist()) if len(a) and len(b) else []
        return pd.DataFrame([(x, y) for x, y in out if x != y], columns=["a", "b"])

    # dealt by all three, or a family's blocks would stay together in the task of the family
    return dealt.repartition("fam", "i", "j").groupBy("fam", "i", "j").applyInPandas(compare, "a long, b long")


def links(docs: DataFrame, classes: DataFrame, *, text_col: str, width: int, percent: int, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) links that span the same components as all links between ``classes`` (rep, n, t1, t2, sketch)."""
    found = docs.sparkSession.createDataFrame([], "a long, b long")
    entries = list_entries(classes.select("rep", "n", "sketch"), percent)
    members = families(entries)
    sets = whole_sets(docs, classes.select("rep", "n", "t1", "t2").join(members.select("rep"), "rep"), text_col=text_col, width=width)
    for _ in range(rounds):
        near = centred(sets, members, percent)
        centre = members.select("rep", "centre")
        found = found.union(near.where("ring = 0").select("rep").join(centre, "rep").select(F.col("rep").alias("a"), F.col("centre").alias("b")))
        # a family without a row or without another is no pair of blocks
        sides = near.where("ring < 2").select("rep", "fam", "n", (F.col("ring") == 1).alias("row"), (F.col("ring") == 0).alias("other"))
        found = found.union(in_blocks(sets, sides, percent, block))
        entries = cut(entries.join(near.where("ring > 0").select("rep"), "rep", "left_semi"))
        members = families(entries)
        if members.isEmpty():
            return found
    sides = members.select("rep", "fam", "n", F.lit(True).alias("row"), F.lit(True).alias("other"))
    return found.union(in_blocks(sets, sides, percent, block))


def linked_rows(docs: DataFrame, *, text_col: str, id_col: str, width: int, percent: int) -> DataFrame:
    """(id, t1, t2, n, root) of every row: its id, digest of its text, set size and number of its component (null for an empty set)."""
    all_rows = cut(sketch(docs, text_col=text_col, id_col=id_col, width=width))
    grouped = all_rows.where("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.min(F.struct("t1", "t2")).alias("t"), F.first("sketch").alias("sketch"))
    # numbered once and kept
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "n", "t.t1", "t.t2", "sketch"))
    merged = components(links(docs, classes, text_col=text_col, width=width, percent=percent))
    named = classes.select("d1", "d2", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    counted = named.join(all_rows.groupBy("d1", "d2").agg(F.count("*").alias("m")), ["d1", "d2"]).select(F.struct("d1", "d2").alias("d"), "root", "m")
    filled = all_rows.where("n > 0").select("id", "t1", "t2", "n", F.struct("d1", "d2").alias("d"))
    without = all_rows.where("n = 0").select("id", "t1", "t2", "n", F.lit(None).cast("long").alias("root"))
    return hot_join(filled, counted, "d").select("id", "t1", "t2", "n", "root").union(without)


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``; ``id`` keeps its column's name.

    Rows are linked where 100 * intersection >= percent * union of their shingle sets. ``component_id`` is the
    least id of the row's component. Null and empty texts and texts without a word have an empty set and
    stand alone. Links are between texts, not ids: rows that repeat an id have each the component of their
    own text, and a row of null id takes part in its component, with a null component where no row of it has
    an id; ``kept`` is true where id and component are equal, both null included. Long texts are compared
    whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    found = cut(linked_rows(docs, text_col=text_col, id_col=id_col, width=width, percent=percent))
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("low"), F.count("*").alias("m"))
    out = hot_join(found.where("root IS NOT NULL"), least, "root").select("id", "n", "low")
    out = out.union(found.where("root IS NULL").select("id", "n", F.col("id").alias("low")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("id").eqNullSafe(F.col("low")).alias("kept"))
