"""Toxicity of obfuscated text: noisy-channel restoration, then scoring.

Method.  Letters hidden by look-alike characters (``1d10t``, ``st*pid``), by
spacing (``i d i o t``) or by repetition (``stuuupid``) are restored by Viterbi
decoding: each character of a suspicious stretch opens its possible letters (a
lattice; fixed channel costs), and a character trigram model, counted over all
documents, picks the likeliest reading; a look-alike may also stand for itself
and end a word there.  A stretch is a run of letters and look-alikes in any order
with a letter in it, or three and more of them set apart, which are joined if the
joined reading is likelier than single characters (four letters: always).  Other
text has one reading and passes unchanged.  The restored text is scored by logistic regression over those
hashed words and word beginnings whose log-odds differ clearly (``MIN_Z``)
between the classes.

The trigram counts come from every text (summed per task, then by Spark; the
table has a fixed size).  Only the classifier is fitted on a bounded sample:
``MAX_PER_CLASS`` labelled documents of each class in the order of a hash, its
intercept moved to the class shares among all labelled rows.

Defined cases: null or empty text scores the intercept alone; without labels
every score is 0.5; a label that is null does not count; several labels of one
id count as their largest; repeated rows get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindex.llm.common import cuts, utf8
from spindex.llm.words import mix, word_bounds, word_hashes
from spindex.session import materialize

MAX_PER_CLASS = 3000
FEATURE_BITS = 18
PREFIXES = (4, 6)   # bytes of a word's beginning
MIN_Z = 3.0         # log-odds of a feature over their standard error
MIN_DOCS = 4        # sample documents with the feature
THRESHOLD = 0.7
BATCH_BYTES = 1 << 20
CACHE = 50_000      # restored stretches remembered per worker

# What a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz"}
_SWAP, _WILD, _DROP = 1.0, 2.5, 0.3   # channel costs: look-alike, wild card, dropped repetition
# a sign that stands for itself (not one or two before a letter); a mark or three equal signs before or behind a word, or set apart
_KEEP, _EDGE = 5.0, 0.3

_SIGN = r"[0-9@$!|+(€*]"
_LETTER = r"[^\W\d_]"
_ITEM = r"(?:[^\W_]|[@$!|+(€*])"
_SPACED = rf"(?:{_ITEM}[ ._*-]){{2,}}{_ITEM}"
_SUSPECT = re.compile(
    rf"(?<!\w){_SPACED}(?!\w)"
    rf"|(?<![\w@$!|+(€*])(?:{_LETTER}++{_SIGN}|{_SIGN}++{_LETTER})(?:{_LETTER}|{_SIGN})*+(?!\w)"
    rf"|(?<![\w@$!|+(€*]){_LETTER}*?({_LETTER})\1\1{_LETTER}*+(?!\w)")
_HINT = re.compile(rf"{_SIGN}{_LETTER}|{_LETTER}{_SIGN}|[ ._*-]{_ITEM}[ ._*-]|({_LETTER})\1\1")
_EDGES = rf"(?:[!|+(*]|({_SIGN})\1\1+)+"
_FRONT, _BACK = re.compile(_EDGES), re.compile(_EDGES + "$")
_FORCED = re.compile(rf"(?<!{_SIGN}){_SIGN}{{1,2}}(?={_LETTER})")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 28  # 0: outside a word; 1..26: a..z; 27: any other letter


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


_BYTE = np.zeros(256, np.int64)
_BYTE[128:] = 27
for _i, _c in enumerate(_LETTERS):
    _BYTE[ord(_c)] = _BYTE[ord(_c.upper())] = _i + 1


def trigram_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts; ``_N ** 3`` numbers, whatever the input's size."""

    def count(batches):
        total = np.zeros(_N ** 3, np.int64)
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            for a, b in cuts(offsets, BATCH_BYTES):
                c = np.r_[0, 0, _BYTE[buf[offsets[a]:offsets[b]]]]
                total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = texts.select(text_col).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_N ** 3)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(_N, _N, _N)


class CharModel:
    """Smoothed trigram model: ``cost[a, b, c]``, the negative log probability of c after a b."""

    def __init__(self, counts: np.ndarray):
        pairs = counts.sum(2, keepdims=True)
        after = counts.sum(0)
        bigram = (after + 0.5) / (after.sum(1, keepdims=True) + 0.5 * _N)
        self.cost = -np.log((counts + 2.0 * bigram[None]) / (pairs + 2.0))
        self.costs = self.cost.tolist()  # read one by one
        self.cache: dict[str, str] = {}

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """Per position the readings ``(letters, cost)``; a repeated letter is one position."""
        s = stretch.lower()
        spaced = re.fullmatch(_SPACED, s)
        if spaced:
            s = s[::2]
        first, last = (m.end() if (m := _FRONT.match(s)) else 0), (m.start() if (m := _BACK.search(s)) else len(s))
        forced = {i for m in _FORCED.finditer(s) for i in range(*m.span())}
        out, i = [], 0
        while i < len(s):
            c, j = s[i], i + 1
            if c in LOOKALIKES:
                out.append([(x, _WILD if c == "*" else _SWAP) for x in LOOKALIKES[c]])
                if not spaced and not first <= i < last:
                    out[-1].append((c, _EDGE))
                elif not spaced and i not in forced:
                    out[-1].append((c, _KEEP))
            else:
                while j < len(s) and s[j] == c:
                    j += 1
                n = j - i
                out.append([(c * n, 0.0)] if n < 3 else [(c, _DROP), (c * 2, _DROP)])
            i = j
        return out

    def decode(self, stretch: str) -> str:
        """The likeliest reading of a suspicious stretch."""
        got = self.cache.get(stretch)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            cost, got = self._viterbi(self.lattice(stretch))
            if re.fullmatch(_SPACED, stretch):
                items = stretch[::2].lower()
                if not (len(items) > 3 and items.isalpha()) and cost >= self._alone(items):
                    got = stretch
            elif got == stretch.lower():
                got = stretch
            if len(stretch) <= 64:
                self.cache[stretch] = got
        return got

    def _alone(self, items: str) -> float:
        """Cost of characters set apart, each read as itself."""
        return sum(_EDGE if c in LOOKALIKES else self.costs[0][0][_code(c)] + self.costs[0][_code(c)][0] for c in items)

    def _viterbi(self, lattice) -> tuple[float, str]:
        lattice = [[(x, c, None if x in LOOKALIKES else [_code(y) for y in x]) for x, c in readings] for readings in lattice]
        # any one path bounds the cost: what lies above it is not followed
        bound = self._paths([readings[-1:] for readings in lattice], float("inf"))[0]
        cost, path = self._paths(lattice, bound)
        parts = []
        while path:
            parts.append(path[0])
            path = path[1]
        return cost, "".join(reversed(parts))

    def _paths(self, lattice, bound: float):
        costs = self.costs
        best = {(0, 0): (0.0, None)}  # last two codes -> cost, linked reading
        for readings in lattice:
            nxt: dict = {}
            for (a, b), (cost, path) in best.items():
                for letters, channel, codes in readings:
                    p, q, total = a, b, cost + channel
                    if codes is None:  # itself: no part of a word
                        total += costs[a][b][0] if b else 0.0
                        p = q = 0
                    else:
                        for k in codes:
                            total += costs[p][q][k]
                            p, q = q, k
                    if total <= bound and ((p, q) not in nxt or total < nxt[p, q][0]):
                        nxt[p, q] = (total, (letters, path))
            best = nxt
        ends = [(cost + (costs[a][b][0] if b else 0.0), path) for (a, b), (cost, path) in best.items()]
        return min(ends, key=lambda e: e[0])

    def restore(self, text: str) -> str:
        """The text with its suspicious stretches restored (lower case there), all else as it was."""
        if not _HINT.search(text):
            return text

        def read(m: re.Match) -> str:
            s = m.group()
            return self.decode(s) if any(map(str.isalpha, s)) else s

        return _SUSPECT.sub(read, text)


def features(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct feature numbers of each (lower-cased) row: its words and their beginnings."""
    words, at = word_hashes(buf, offsets)
    shift = np.uint64(64 - FEATURE_BITS)
    parts = [words, *_beginnings(buf, offsets)]
    parts = np.stack([(mix(h + np.uint64(77 * k)) >> shift).astype(np.int32) for k, h in enumerate(parts)], 1)
    return [np.unique(parts[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _beginnings(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first bytes of each word, for each length of ``PREFIXES`` (a shorter word: all of it)."""
    out = []
    if not len(buf):
        return [np.zeros(0, np.uint64) for _ in PREFIXES]
    start, stop = word_bounds(buf, offsets)
    h = np.zeros(len(start), np.uint64)
    for k in range(max(PREFIXES)):
        p = np.minimum(start + k, len(buf) - 1)
        h = np.where(start + k < stop, mix(h * np.uint64(31) + buf[p].astype(np.uint64) + np.uint64(1)), h)
        if k + 1 in PREFIXES:
            out.append(h)
    return out


def restored_column(model: CharModel, spark: SparkSession, text: Column) -> Column:
    """The restored text (null: empty)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def restored(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.restore(t) if t else "" for t in texts.to_pylist()], pa.string())

    return restored(text)


def _features_column(text: Column) -> Column:
    @F.arrow_udf("binary")
    def numbers(texts: pa.Array) -> pa.Array:
        buf, offsets = utf8(texts)
        return pa.array([x.tobytes() for x in features(buf, offsets)], pa.binary())

    return numbers(F.lower(text))


class Classifier:
    """Logistic regression over binary features."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.array([self.weights[f].sum() for f in features(buf, offsets)], np.float64) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_regression(rows: list[np.ndarray], labels: np.ndarray, share: float, steps: int = 400, l2: float = 1e-5) -> Classifier:
    """Gradient steps scaled per feature (Adagrad); ``share``: toxic share among all labelled rows."""
    weights, bias = np.zeros(1 << FEATURE_BITS), 0.0
    if not len(rows) or labels.min() == labels.max():
        p = min(max(share, 1e-3), 1 - 1e-3) if len(rows) else 0.5
        return Classifier(weights.astype(np.float32), float(np.log(p / (1 - p))))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n1, n = labels.sum(), len(labels)
    have1, have = np.bincount(flat, labels[owner], len(weights)), np.bincount(flat, minlength=len(weights))
    cells = [have1 + 0.5, n1 - have1 + 0.5, have - have1 + 0.5, n - n1 - have + have1 + 0.5]
    z = np.log(cells[0] * cells[2 + 1] / (cells[1] * cells[2])) / np.sqrt(sum(1 / c for c in cells))
    clear = (np.abs(z) >= MIN_Z) & (have >= MIN_DOCS)
    owner, flat = owner[clear[flat]], flat[clear[flat]]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    seen, sb = np.full(len(weights), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, weights[flat], len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.bincount(flat, g[owner], len(weights)) + l2 * weights
        seen += grad * grad
        sb += g.sum() ** 2
        weights -= 0.2 * grad / np.sqrt(seen)
        bias -= 0.2 * g.sum() / np.sqrt(sb)
    # trained on balanced classes: put the real shares into the intercept
    share = min(max(share, 1e-4), 1 - 1e-4)
    return Classifier(weights.astype(np.float32), float(bias + np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Classifier:
    """Fit on a bounded sample of the labelled documents: of each class those with the smallest hashes.

    A bound on the hash, from the class's size, leaves about half as many rows again as are wanted
    before any is ranked, so no task gets a class.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = F.lit(False)
    for y, n in shares.items():
        most = min(int((1.5 * (max_per_class + 100) / n * 2 - 1) * (1 << 63)), (1 << 63) - 1)
        few = few | ((F.col("y") == y) & (F.xxhash64("__id") <= F.lit(most)))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("__id"), "__id"))
    chosen = known.where(few).withColumn("r", rank).where(F.col("r") <= max_per_class)
    chosen = materialize(chosen.select("__id", "y"), "toxicity-sample")  # its known size lets the join leave the texts where they are
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(chosen, "__id")
    numbers = _features_column(restored_column(model, docs.sparkSession, F.col("__text")))
    rows = text.select("y", numbers.alias("f")).toLocalIterator()
    rows = [(r["y"], np.frombuffer(bytes(r["f"]), np.int32)) for r in rows]
    y = np.array([a for a, _ in rows], np.float64)
    total = sum(shares.values())
    return fit_regression([b for _, b in rows], y, shares.get(1, 0) / total if total else 0.5)


def score_column(classifier: Classifier, spark: SparkSession, restored: Column) -> Column:
    shared = spark.sparkContext.broadcast(classifier)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        buf, offsets = utf8(texts)
        out = [shared.value.score(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in cuts(offsets, BATCH_BYTES)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scored(F.lower(restored))


def score(docs: DataFrame, model: CharModel, classifier: Classifier, text_col: str = "text", out: str = "toxicity",
          threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``out``: the score of the restored text and the prediction."""
    spark = docs.sparkSession
    value = score_column(classifier, spark, restored_column(model, spark, F.col(text_col)))
    return docs.withColumn(out, value).withColumn(out, F.struct(
        F.col(out).alias("score"), (F.col(out) >= threshold).cast("int").alias("predicted")))
