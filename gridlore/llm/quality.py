"""Quality rules as a learned decision list.

Each text is measured once. Sequential covering learns from labelled statistics which documents to
reject: a rule is a conjunction of thresholds, grown condition by condition on one part of the labelled
rows by information gain, pruned from its end on the other part, and kept only while it is precise there;
the rows it covers leave, and the next rule is learned. The list becomes one ordered Spark conditional
expression over the measured columns, so applying it is plain code generation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import SEPARATOR_CHARS, carried, quoted, seeded

#: Bound of the labelled sample the list is fitted on.
SAMPLE_ROWS = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: White space that str.split() honours and the word definition does not.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_upper_words long, n_marks long, n_digits long, n_distinct long, n_open_lines long"
COUNTS = [c.split()[0] for c in f"{BASE}, {MORE}".split(", ")]


def split_words(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words covered by windows of eight words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    code = ids
    for step in (1, 2, 4):  # exact: a pair of codes gets a code of its own
        code = np.unique(code[:-step] * (int(code.max()) + 1) + code[step:], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; all zero for null."""
    if not text:
        return (0,) * len(COUNTS)
    words = split_words(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATOR_CHARS)]
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    ends = sum(1 for x in lines if x.rstrip(SEPARATOR_CHARS)[-1] not in ".!?:;\"')")
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        text.count("!") + text.count("?"),
        sum(map(text.count, "0123456789")),
        len(set(words)),
        ends,
    )


def measured(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and COUNTS of every row; a carried column named like a count gives way to it."""
    inner, back = carried(docs, carry, COUNTS)
    kept = docs.select(*inner)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + f", {BASE}, {MORE}"
    names = [c for c in dict.fromkeys(carry) if c.lower() not in COUNTS]
    again = text_col in names  # a carried text is sent once
    text = f"c{names.index(text_col)}" if again else "t"
    if not again:
        kept = docs.select(*inner, docs[quoted(text_col)].alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text] if again else frame.pop(text)
            counts = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            for i, c in enumerate(COUNTS):
                frame[c] = counts[:, i]
            yield frame

    return kept.mapInPandas(run, schema.removeprefix(", ")).select(*back, *COUNTS)


def per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: The statistics that conditions speak of, as expressions over COUNTS.
STATISTICS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper_words", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_word": ("n_digits", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "open_line_share": ("n_open_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.statistic]
        return v > self.threshold if self.above else v <= self.threshold

    def expression(self) -> Column:
        v = per(*STATISTICS[self.statistic])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(v: np.ndarray, most: int = 48) -> np.ndarray:
    """Midpoints between neighbouring values, evenly thinned by rank."""
    u = np.unique(v)
    if len(u) < 2:
        return u[:0]
    mid = (u[:-1] + u[1:]) / 2
    return mid if len(mid) <= most else mid[np.linspace(0, len(mid) - 1, most).astype(int)]


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of largest FOIL gain until no good row is covered."""
    rule: Rule = ()
    here = np.ones(len(bad), bool)
    while len(rule) < most and (here & ~bad).any():
        p, n = int((here & bad).sum()), int((here & ~bad).sum())
        before, best, found = math.log2(p / (p + n)), 1e-9, None
        for name in x:
            v, b = x[name][here], bad[here]
            for t in _cuts(v):
                over = v > t
                pa, na = int((over & b).sum()), int((over & ~b).sum())
                for above, q, m in ((True, pa, na), (False, p - pa, n - na)):
                    gain = q * (math.log2(q / (q + m)) - before) if q else 0.0
                    if gain > best:
                        best, found = gain, Condition(name, above, float(t))
        if found is None:
            break
        rule += (found,)
        here &= found.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule with the best (bad - good) / covered on rows that did not grow it."""

    def value(r: Rule) -> float:
        c = covers(r, x, len(bad))
        return ((c & bad).sum() - (c & ~bad).sum()) / max(c.sum(), 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=value, default=rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, conditions: int = 3, rules: int = 12, precision: float = 0.98, least: int = 4) -> list[Rule]:
    """The decision list of rejections; empty where nothing precise can be learned.

    A rule must cover ``least`` bad rows and be ``precision`` precise over all labelled rows still
    uncovered as well as on the pruning part alone. Every third row prunes.
    """
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 0
    while len(out) < rules and (left & bad & ~third).any():
        g, p = left & ~third, left & third
        sub = lambda m: {k: v[m] for k, v in x.items()}
        rule = prune(grow(sub(g), bad[g], conditions), sub(p), bad[p])
        if not rule:
            break
        hit = covers(rule, x, len(bad)) & left
        held = hit & third
        if (hit & bad).sum() < max(least, 1) or (hit & bad).sum() < precision * hit.sum() or (held & bad).sum() < precision * held.sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str, id_col: str, label_id_col: str = "doc_id", sample: int = SAMPLE_ROWS, base: Column | None = None) -> list[Rule]:
    """Learns the list from at most ``sample`` labelled rows, taken by a hash of the id.

    Labels of null id or null quality are ignored; an id labelled twice alike counts once. Of several
    documents with a labelled id the one of least counts stands for it. Rows that ``base`` rejects are left
    out, as the list never judges them. No usable label: an empty list.
    """
    usable = labels.where(F.col(label_id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(label_id_col).alias("id"), "quality").distinct()
    few = usable.orderBy(seeded(5, F.col("id")), "id", "quality").limit(sample)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = measured(texts.join(F.broadcast(few), "id"), "text", ["id", "quality"])
    one = rows.groupBy("id", "quality").agg(F.min(F.struct(*COUNTS)).alias("s")).select("id", "quality", "s.*")
    frame = (one.where(~base) if base is not None else one).toPandas()  # at most ``sample`` rows
    frame = frame.sort_values(["id", "quality"], ignore_index=True)
    x = {k: (frame[a] / np.maximum(frame[b], 1)).to_numpy(float) for k, (a, b) in STATISTICS.items()}
    return learn(x, (frame["quality"] == 0).to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """True where the list keeps a row: the first rule that fits rejects, else it stays."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = rule[0].expression()
        for c in rule[1:]:
            test = test & c.expression()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def base_rule(least_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """carry columns (default the id), COUNTS, base_failed and kept of every row of ``docs``.

    ``labels`` has (doc_id, quality). Null and empty texts have zero counts and fail the base rule; a long
    text is measured whole, in time in proportion to it; repeated rows and ties are judged alike, each by
    its own text. An empty table gives an empty result, empty labels an empty list. A carried column named
    like an added one gives way to it, other names do no harm.
    """
    rules = fit(docs, labels, text_col=text_col, id_col=id_col, base=base_rule())
    inner = [c for c in (carry or [id_col]) if c.lower() not in ("base_failed", "kept")]
    rows = measured(docs, text_col, inner)
    return rows.withColumn("base_failed", base_rule()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
