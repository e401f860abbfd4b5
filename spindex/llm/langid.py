"""Language identification by cross-parsing entropy.

Method.  For each language a suffix automaton is built over labelled text.  A
text is cross-parsed with it: from the current byte follow the automaton as far
as it goes (the longest match that starts there), count one phrase, go on after
it.  A language that a text resembles gives long matches and few phrases.  The
phrases are normalised to the cross-entropy estimate

    phrases * log2(bytes of that language's labelled text) / bytes of the text

and the language with the smallest value wins (ties: the smaller name).

The parse only ever goes forward from the root, so the automaton's transitions
are laid out as one integer table with the restart folded in, and the blocks
of an Arrow batch (``BLOCK`` bytes of a text each; every byte of every text is
parsed) advance through it side by side in numpy.

Only the labelled text is bounded: ``max_train_bytes`` per language, whole
documents in the order of a hash of their text.  It is read on the driver,
which builds one automaton per label.

Defined cases: null text, or text without a letter: ``und`` with score 0; an
empty training set: every text is ``und``; repeated rows give repeated equal
rows; text in a script never seen in training costs one phrase per byte in
every language.  Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm.common import cuts, utf8
from spindex.session import materialize

UND = "und"
MAX_TRAIN_BYTES = 40_000   # labelled text per language
MAX_TRAIN_DOCS = 200       # rows per language looked at to fill it
BLOCK = 512                # bytes parsed in one go
BATCH_BYTES = 1 << 20      # text in numpy arrays at a time

# Bytes that separate words count as one symbol, the space.
_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLD[_b] = 32


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data`` (state 0 is the root)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


class CrossParser:
    """The parse table of one language: entry ``[state, byte class]`` holds the next state's
    row start plus the number of phrases that ended at this byte (0 to 2)."""

    def __init__(self, data: bytes, classes: np.ndarray, n_classes: int):
        step = suffix_automaton(data)
        width = -(-n_classes // 4) * 4  # so that two bits of a row start are free
        table = np.full((len(step), width), -1, np.int64)
        for s, to in enumerate(step):
            for c, t in to.items():
                table[s, classes[c]] = t
        root = np.where(table[0] < 0, 0, table[0])
        stuck = table < 0
        # a byte that cannot follow ends the phrase and starts the next; one that the root does not
        # know either is a phrase of its own, counted when it is read
        unknown = table[0] < 0
        table = np.where(stuck, root[None, :], table) * width + stuck + (stuck & unknown[None, :])
        table[0] = np.where(unknown, 1, table[0])
        self.table = table.astype(np.int32).ravel()
        self.bits = float(np.log2(max(2, len(data))))

    def phrases(self, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of blocks, given as a (longest, blocks) array of byte classes, longest block first."""
        n = len(lengths)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        live = np.searchsorted(-lengths, -np.arange(columns.shape[0]), "left")  # blocks longer than t
        for t in range(columns.shape[0]):
            k = live[t]
            to = self.table[state[:k] + columns[t, :k]]
            ended = to & 3
            count[:k] += ended
            state[:k] = to - ended
        return count + (state != 0)  # the open phrase at the end


class Model:
    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()) or b" ", np.uint8))
        classes = np.zeros(256, np.uint8)  # class 0: a byte never seen
        classes[seen] = np.arange(1, len(seen) + 1)
        self.codes = classes[_FOLD]
        self.parsers = [CrossParser(samples[x], classes, len(seen) + 1) for x in self.langs]

    def costs(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Cross-entropy estimate (bits per byte) of each text (rows) in each language."""
        size = np.diff(offsets)
        n = len(size)
        out = np.zeros((n, len(self.langs)))
        blocks = -(-size // BLOCK)
        if not blocks.sum():
            return out
        codes = self.codes[buf]
        first = np.cumsum(blocks) - blocks
        padded = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
        for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (first * BLOCK).tolist()):
            padded[k:k + b - a] = codes[a:b]
        row = np.repeat(np.arange(n), blocks)
        length = np.minimum(BLOCK, size[row] - (np.arange(len(row)) - first[row]) * BLOCK)
        order = np.argsort(-length, kind="stable")
        row, length = row[order], length[order]
        columns = np.ascontiguousarray(padded.reshape(-1, BLOCK)[order].T)[:length[0]]
        for j, parser in enumerate(self.parsers):
            total = np.bincount(row, parser.phrases(columns, length), n)
            out[:, j] = total * parser.bits / np.maximum(size, 1)
        return out


def training_text(labelled: DataFrame, text_col: str, lang_col: str, max_bytes: int, max_docs: int) -> dict[str, bytes]:
    """A bounded sample per language, gathered on the driver: at most ``max_docs`` whole documents
    each, of at most ``max_bytes`` together (the last one that reaches over is cut)."""
    docs = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    docs = docs.withColumn("h", F.md5("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = docs.select("l", "h").distinct().withColumn("r", rank).where(F.col("r") <= max_docs)
    chosen = materialize(chosen, "langid-sample")  # its known size lets the join leave the texts where they are
    rows = docs.join(chosen, ["l", "h"]).groupBy("l", "r") \
        .agg(F.min(F.substring(F.lower("t"), 1, max_bytes)).alias("t")).orderBy("l", "r").toLocalIterator()
    out: dict[str, bytearray] = {}
    for r in rows:
        have = out.setdefault(r["l"], bytearray())
        if len(have) < max_bytes:
            have += b" " + r["t"].encode()
            del have[max_bytes:]
    return {lang: bytes(_FOLD[np.frombuffer(bytes(x), np.uint8)]) for lang, x in out.items()}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        max_bytes: int = MAX_TRAIN_BYTES, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    return Model(training_text(labelled, text_col, lang_col, max_bytes, max_docs))


def predict_column(model: Model, spark, text: Column) -> Column:
    """A struct column ``(lang_pred, score, match_length)``.

    ``score``: 1 minus the winner's cost over the runner-up's, mapped to 0..1 as
    ``runner_up / (winner + runner_up)``; ``match_length``: mean bytes per phrase
    under the winner (0 for ``und``).
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by max_train_bytes per language

    @F.arrow_udf("struct<lang_pred:string,score:double,match_length:double>")
    def predicted(texts: pa.Array, lowered: pa.Array) -> pa.Array:
        m = shared.value
        buf, offsets = utf8(lowered)
        has = np.fromiter((x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()), bool, len(texts))
        lang = np.full(len(texts), UND, object)
        score, match = np.zeros(len(texts)), np.zeros(len(texts))
        if m.langs:
            bits = np.array([p.bits for p in m.parsers])
            for a, b in cuts(offsets, BATCH_BYTES):
                cost = m.costs(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                best = np.argmin(cost, 1)
                low = cost[np.arange(b - a), best]
                cost[np.arange(b - a), best] = np.inf
                second = cost.min(1) if len(m.langs) > 1 else low
                ok = has[a:b] & (low > 0)
                lang[a:b][ok] = np.array(m.langs, object)[best[ok]]
                score[a:b][ok] = second[ok] / (second[ok] + low[ok])
                match[a:b][ok] = bits[best[ok]] / low[ok]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(match)], ["lang_pred", "score", "match_length"])

    return predicted(text, F.lower(text))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: predicted language, score, mean match length."""
    return docs.withColumn(out, predict_column(model, docs.sparkSession, F.col(text_col)))
