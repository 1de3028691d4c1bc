"""Language-model scoring by masked pseudo-likelihood.

Every token of a document is masked in turn and predicted from the tokens on both its sides; the sum of
the conditional log-probabilities scores the document. Tokens are words, and the vocabulary is open. The
predictor has two levels, as in a hierarchical softmax. A small window network (embeddings of the left and
the right token, a tanh layer, a softmax) gives the class of the masked word: the commonest words of the
corpus are a class each, the others share classes by their last two letters. Within a class the words of
the vocabulary have the share that they have in the corpus; what is left of the class is for all other
words, which are spelled out letter by letter. The probabilities of all words there can be add up to 1.

What is learned from is counted over the whole corpus: words with their documents, (left, token, right)
triples of classes, letter trigrams of words beyond the vocabulary. The word table stays in the cluster and
grows with the corpus; from it comes how many words of a document no other document has. There are a fixed
number of classes, so the triples are a bounded table, and the network is trained on it with numpy, in steps
that grow with the contexts found. As a context is a pair of classes, a worker compiles the network once into
a table of log-probabilities and scores by lookup.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import carried, cut, hot_join, quoted, text_key

#: Classes: one boundary, then common words, then shared classes of all other words.
CLASSES, SHARED = 256, 32
#: Most words of the vocabulary, a dictionary of which every worker holds (about 100 bytes each); all others are spelled.
VOCABULARY = 1 << 17
EMBEDDING, HIDDEN = 24, 64
#: Contexts in a training batch, least number of batches, and draws for each context that the corpus has.
BATCH, LEAST_STEPS, DRAWS = 2048, 240, 16
#: Distinct words or triples that a task gathers before it passes their counts on.
FLUSH = 250_000
#: Ends a word and stands before it; no word has this byte. Letters that a word may have; weight of the shorter context.
END, BACKOFF, LONGEST = 32, 4.0, 300
LETTERS = np.array([b for b in range(256) if b not in b" \t\n\r\x0b\x0c"])
_TABLE: dict[int, tuple[np.ndarray, Spelling]] = {}


def suffix_class(x, y):
    """The shared class of words whose last two bytes are x and y; END before a word of one byte."""
    return CLASSES - SHARED + (x * 131 + y * 7 + x // 8) % SHARED


def shared_class(word: bytes) -> int:
    return suffix_class(word[-2] if len(word) > 1 else END, word[-1])


class Vocabulary(dict):
    """Number of each word: 0 is the boundary, then the vocabulary, commonest first, then a number for each shared class.

    Words beyond the vocabulary are remembered up to a bound.
    """

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, counts
        super().__init__(zip(words, range(1, len(words) + 1)))
        alone = CLASSES - SHARED - 1
        #: class of each number
        self.cls = np.array([0, *range(1, min(alone, len(words)) + 1), *map(shared_class, words[alone:]), *range(CLASSES - SHARED, CLASSES)], np.int64)

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.words) + FLUSH:
            self.clear()
            self.update(zip(self.words, range(1, len(self.words) + 1)))
        out = self[word] = len(self.words) + 1 + shared_class(word) - (CLASSES - SHARED)
        return out

    def __reduce__(self):
        return Vocabulary, (self.words, self.counts)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def classes(self, text: str | None) -> np.ndarray:
        return self.cls[self.numbers(split(text))]

    def beyond(self, words: list[bytes], numbers: np.ndarray) -> list[bytes]:
        """The words that are spelled, in order."""
        return [words[i] for i in np.flatnonzero(numbers > len(self.words))]


def split(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n, df, o1, o2) over all documents: occurrences, documents, and digest of the text of the only document that has it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        df: Counter = Counter()
        owner: dict[bytes, int] = {}

        def gathered() -> pd.DataFrame:
            words = list(n)
            times = np.fromiter(map(df.__getitem__, words), np.int64, len(words))
            of = np.fromiter(map(owner.__getitem__, words), np.int64, len(words))
            one = times == 1  # else the digest says nothing
            out = pd.DataFrame({"word": words, "n": list(n.values()), "df": times, "o1": np.where(one, np.array(t1, np.int64)[of], 0), "o2": np.where(one, np.array(t2, np.int64)[of], 0)})
            for x in (n, df, owner, t1, t2):
                x.clear()
            return out

        t1: list[int] = []
        t2: list[int] = []
        for frame in frames:
            for a, b, t in zip(frame["t1"].tolist(), frame["t2"].tolist(), frame["t"]):
                words = split(t)
                distinct = set(words)
                n.update(words)
                df.update(distinct)
                owner.update(dict.fromkeys(distinct, len(t1)))
                t1.append(a)
                t2.append(b)
                if len(n) >= FLUSH:
                    yield gathered()
        if n:
            yield gathered()

    text = docs[quoted(text_col)]
    found = docs.select(*text_key(text), text.alias("t")).mapInPandas(run, "word binary, n long, df long, o1 long, o2 long")
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "df")], *[F.max(c).alias(c) for c in ("o1", "o2")])


def vocabulary(counted: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The commonest words of word_counts(), those met twice or more; words of about the same count enter or stay out together."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counted.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()  # a thousand rows at most
    least, room = None, most
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["m"]
        if room < 0:
            break
        least = r["least"]
    if least is None:
        return Vocabulary([], [])
    found = counted.where(F.col("n") >= least).select("word", "n").toArrow()  # at most ``most`` rows
    rows = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist()), key=lambda r: (-r[0], r[1]))
    return Vocabulary([w for _, w in rows], [n for n, _ in rows])


def novel_words(counted: DataFrame) -> DataFrame:
    """(t1, t2, n_novel): how many words the only row of a text has that no other row has."""
    return counted.where("df = 1").groupBy(F.col("o1").alias("t1"), F.col("o2").alias("t2")).agg(F.count("*").alias("n_novel"))


def triple_counts(docs: DataFrame, text_col: str, words: Vocabulary) -> DataFrame:
    """(code, n) over all documents; code = (left * CLASSES + right) * CLASSES + token."""
    return all_counts(docs, text_col, words).where("code >= 0")


def all_counts(docs: DataFrame, text_col: str, words: Vocabulary) -> DataFrame:
    """triple_counts, and as code -1 - trigram the letter trigrams of all words beyond the vocabulary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[np.ndarray] = []
        letters: list[np.ndarray] = []
        size = spelled = 0

        def gathered(codes: list[np.ndarray]) -> pd.DataFrame:
            code, n = np.unique(np.concatenate(codes or [np.empty(0, np.int64)]), return_counts=True)
            codes.clear()
            return pd.DataFrame({"code": code.astype(np.int64), "n": n.astype(np.int64)})

        for frame in frames:
            for t in frame["t"]:
                tokens = split(t)
                if tokens:
                    numbers = words.numbers(tokens)
                    waiting.append(coded(words.cls[numbers]))
                    size += len(tokens)
                    rare = trigrams(words.beyond(tokens, numbers))[0]
                    letters.append(rare)
                    spelled += len(rare)
                if spelled >= 16 * FLUSH:
                    yield gathered(letters).eval("code = -1 - code")
                    spelled = 0
                if size >= 16 * FLUSH:
                    yield gathered(waiting)
                    size = 0
        yield gathered(letters).eval("code = -1 - code")
        yield gathered(waiting)

    return docs.select(docs[quoted(text_col)].alias("t")).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def coded(c: np.ndarray) -> np.ndarray:
    sides = np.concatenate([[0], c, [0]])
    return (sides[:-2] * CLASSES + sides[2:]) * CLASSES + c


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams of all words, each from before its first letter to its end; and where each word starts among them."""
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    b = np.frombuffer(b"  " + b"  ".join(words) + b" ", np.uint8)
    code = (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the end
    return code[(b[1:-1] != END) | (b[2:] != END)], np.cumsum(length) - length


class Spelling:
    """log P(letters of a word), each letter from the two before it."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n
        self.p: np.ndarray | None = None

    def __reduce__(self):
        return Spelling, (self.code, self.n)

    def compiled(self) -> Spelling:
        """With its table of log-probabilities."""
        p = np.zeros((256, 256, 256), np.float32)
        p.reshape(-1)[self.code] = self.n
        two, can = p.sum(axis=0, dtype=np.float64), np.r_[LETTERS, END]
        one = np.zeros(256)
        one[can] = two.sum(axis=0)[can] + 1
        one[END] += len(LETTERS) / 4  # where nothing is known, words are short
        two = (two + BACKOFF * one / one.sum()) / (two.sum(axis=1, keepdims=True) + BACKOFF)
        seen = p.sum(axis=2, keepdims=True) + np.float32(BACKOFF)
        p += (BACKOFF * two).astype(np.float32)
        p /= seen
        p[END, END, END] = 0  # a word has a letter
        p[END, END] /= p[END, END].sum()
        with np.errstate(divide="ignore"):
            self.p = np.log(p, out=p).reshape(-1)
        return self

    def each(self, words: list[bytes]) -> np.ndarray:
        code, start = trigrams(words)
        return np.add.reduceat(self.p[code].astype(np.float64), start) if words else np.empty(0)

    def endings(self) -> np.ndarray:
        """Probability of every pair of last bytes, END first for words of one byte: what a walk of up to LONGEST letters meets."""
        p = np.exp(self.p.reshape(256, 256, 256).transpose(1, 0, 2), order="C")  # by second, first and next byte
        end = np.ascontiguousarray(p[:, :, END])
        p[:, :, END] = 0
        now, out = np.zeros((256, 256), np.float32), np.zeros((256, 256))
        now[END, END] = 1.0
        for _ in range(LONGEST):
            out += now * end
            now = np.matmul(now[:, None, :], p)[:, 0, :].T  # by next, then second byte
            if now.sum() < 1e-7:
                break
        return out.T


def word_shares(words: Vocabulary, totals: np.ndarray, spelling: Spelling) -> np.ndarray:
    """log P(word | class) of every number of the vocabulary; of words beyond, what is added to their spelling.

    ``totals`` has the tokens of each class. One occurrence more than was counted is for words beyond the
    vocabulary, whose spellings share it, and theirs, without the spellings of the vocabulary.
    """
    n, cls = np.array([0, *words.counts, *[0] * SHARED], float), words.cls
    shared = cls >= CLASSES - SHARED
    more = totals + (np.arange(CLASSES) >= CLASSES - SHARED)
    out = np.where(shared, np.log(np.maximum(n, 1) / np.maximum(more[cls], 1)), 0.0)
    x, y = np.divmod(np.arange(1 << 16), 256)
    mass = np.bincount(suffix_class(x, y), spelling.endings().reshape(-1), CLASSES)
    if words.words:
        mass -= np.bincount([shared_class(w) for w in words.words], np.exp(spelling.each(words.words)), CLASSES)
    known = np.bincount(cls[1 : len(words.words) + 1], n[1 : len(words.words) + 1], CLASSES)
    out[-SHARED:] = np.log(((more - known) / np.maximum(more, 1))[-SHARED:]) - np.log(np.maximum(mass, 1e-9)[-SHARED:])
    return out


class Network:
    """log P(token | left, right): two embeddings, a tanh layer, a softmax."""

    def __init__(self, seed: int = 17):
        r = np.random.default_rng(seed)
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "left": draw(CLASSES, EMBEDDING, scale=0.3), "right": draw(CLASSES, EMBEDDING, scale=0.3),
            "w1": draw(2 * EMBEDDING, HIDDEN, scale=(2 * EMBEDDING) ** -0.5), "b1": np.zeros(HIDDEN, np.float32),
            "w2": draw(HIDDEN, CLASSES, scale=HIDDEN**-0.5), "b2": np.zeros(CLASSES, np.float32),
        }

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer and log-probabilities of contexts left * CLASSES + right."""
        p = self.p
        x = np.concatenate([p["left"][context // CLASSES], p["right"][context % CLASSES]], axis=1)
        h = np.tanh(x @ p["w1"] + p["b1"])
        z = h @ p["w2"] + p["b2"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def gradients(self, context: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the counts (contexts x tokens), and its gradients."""
        p = self.p
        x, h, z = self.forward(context)
        total = float(counts.sum())
        loss = -float((counts * z).sum()) / total
        dz = (np.exp(z) * counts.sum(axis=1, keepdims=True) - counts) / total
        dh = (dz @ p["w2"].T) * (1 - h * h)
        dx = dh @ p["w1"].T
        g = {"w2": h.T @ dz, "b2": dz.sum(axis=0), "w1": x.T @ dh, "b1": dh.sum(axis=0), "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"])}
        np.add.at(g["left"], context // CLASSES, dx[:, :EMBEDDING])
        np.add.at(g["right"], context % CLASSES, dx[:, EMBEDDING:])
        return loss, g

    def train(self, code: np.ndarray, n: np.ndarray, *, steps: int = 240, batch: int = 2048, rate: float = 0.02, seed: int = 23) -> list[float]:
        """Adam over batches of contexts drawn by how often they occur; returns the losses."""
        if not len(code):
            return []
        order = np.argsort(code)
        code, n = code[order], n[order].astype(np.float32)
        context, token = (code // CLASSES).astype(np.int32), (code % CLASSES).astype(np.int16)
        del code, order
        seen, first = np.unique(context, return_index=True)
        ends = np.r_[first[1:], len(context)]
        weight = np.add.reduceat(n, first).astype(np.float64)
        cumulative = np.cumsum(weight) / weight.sum()
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick, times = np.unique(np.minimum(np.searchsorted(cumulative, r.random(batch)), len(seen) - 1), return_counts=True)
            counts = np.zeros((len(pick), CLASSES), np.float32)
            for row, (k, c) in enumerate(zip(pick, times)):
                span = slice(first[k], ends[k])
                counts[row, token[span]] = n[span] * (c / weight[k])
            loss, g = self.gradients(seen[pick], counts)
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def table(self) -> np.ndarray:
        """Log-probability of every triple code."""
        out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
        for start in range(0, len(out), 4096):
            out[start : start + 4096] = self.forward(np.arange(start, start + 4096))[2]
        return out.reshape(-1)


def steps_for(code: np.ndarray) -> int:
    """Training steps that grow with the contexts found."""
    return max(LEAST_STEPS, -(-DRAWS * len(np.unique(code // CLASSES)) // BATCH))


class Model:
    """Vocabulary, network, spelling and the words' shares of their classes."""

    def __init__(self, words: Vocabulary, net: Network, spelling: Spelling, shares: np.ndarray):
        self.words, self.net, self.spelling, self.shares = words, net, spelling, shares
        self.key = xxhash.xxh64_intdigest(b"".join(net.p[k].tobytes() for k in sorted(net.p)) + spelling.code.tobytes() + spelling.n.tobytes() + shares.tobytes())

    def tables(self) -> tuple[np.ndarray, Spelling]:
        """Of classes by context, and of spellings; compiled once a worker."""
        if self.key not in _TABLE:
            _TABLE.clear()
            _TABLE[self.key] = self.net.table(), self.spelling.compiled()
        return _TABLE[self.key]

    def score(self, text: str | None) -> tuple[int, float, float]:
        """Tokens, log-likelihood of the words, and of their classes alone."""
        tokens = split(text)
        if not tokens:
            return 0, 0.0, 0.0
        table, spelling = self.tables()
        numbers = self.words.numbers(tokens)
        of_class = float(table[coded(self.words.cls[numbers])].sum(dtype=np.float64))
        spelled = spelling.each(self.words.beyond(tokens, numbers)).sum()
        return len(tokens), of_class + float(self.shares[numbers].sum() + spelled), of_class


def fit(docs: DataFrame, *, text_col: str, counted: DataFrame | None = None) -> Model:
    """The model of all documents; ``counted`` may give their word_counts().

    The driver holds at most CLASSES ** 3 counts, those of letter trigrams, and VOCABULARY words.
    """
    words = vocabulary(cut(word_counts(docs, text_col)) if counted is None else counted)
    counts = all_counts(docs, text_col, words).toArrow()  # columns of numbers, not a row object for each cell
    code, n = counts["code"].to_numpy(), counts["n"].to_numpy()
    del counts
    net = Network()
    letter = code < 0
    spelling = Spelling(-1 - code[letter], n[letter])
    code, n = code[~letter], n[~letter]
    totals = np.bincount(code % CLASSES, n, CLASSES) if len(code) else np.zeros(CLASSES)
    net.train(code, n, steps=steps_for(code), batch=BATCH)
    del code, n
    shares = word_shares(words, totals, spelling.compiled())
    return Model(words, net, Spelling(spelling.code, spelling.n), shares)


ADDED = ["n_tokens", "log_likelihood", "mean_log_likelihood", "class_log_likelihood", "n_novel"]


def score(docs: DataFrame, *, text_col: str, carry: list[str]) -> DataFrame:
    """carry columns and ADDED of every row of ``docs``, under a model of all of them.

    Tokens; sum and mean of the words' log-likelihood; sum of that of their classes; and the distinct words
    that no other row has. A null text or one without a word has no token, sums 0 and a null mean. Long
    texts are scored whole, in time and memory in proportion; repeated rows score alike, and have no word of
    their own. An empty table gives an empty result. A carried column named like an added one gives way
    to it, other names do no harm.
    """
    counted = cut(word_counts(docs, text_col))
    model = fit(docs, text_col=text_col, counted=counted)
    inner, back = carried(docs, carry, ADDED)
    text = docs[quoted(text_col)]
    kept = docs.select(*inner, *text_key(text), text.alias("t"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema if f.name != "t") + "n_tokens long, log_likelihood double, mean_log_likelihood double, class_log_likelihood double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, word, of_class = np.array([model.score(t) for t in frame.pop("t")], float).reshape(-1, 3).T
            mean = np.divide(word, n, out=np.full(len(n), np.nan), where=n > 0)
            yield frame.assign(n_tokens=n.astype(np.int64), log_likelihood=word, mean_log_likelihood=pd.Series(mean, index=frame.index).astype(object).where(n > 0, None), class_log_likelihood=of_class)

    scored = cut(kept.mapInPandas(run, schema).withColumn("d", F.struct("t1", "t2")))
    texts = scored.groupBy("t1", "t2").agg(F.count("*").alias("m")).join(novel_words(counted), ["t1", "t2"], "left")
    novel = texts.select(F.struct("t1", "t2").alias("d"), "m", F.coalesce("n_novel", F.lit(0)).cast("long").alias("n_novel"))
    return hot_join(scored, novel, "d").select(*back, *ADDED)
