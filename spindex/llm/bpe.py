"""BPE encoding and decoding: a bounded-lookahead streaming transducer.

Method.  A BPE token boundary at some byte can only be undone by a merge of
higher priority that starts at the token's right edge, and that merge in turn
only by one of still higher priority further right.  Walking the merge list in
order gives the longest such chain in bytes: the *sufficient lookahead*.  A
pre-token is therefore read through a window of ``window`` bytes plus that
lookahead; tokens that end before the lookahead zone are stable and emitted,
and reading goes on at the last emitted boundary (no merge crosses it, so the
rest encodes alike on its own).  Memory per pre-token is constant however long
it is.  Pre-tokens that fit a lookahead are merged together in numpy arrays, one
merge step for all of an Arrow batch at a time; the windows of longer ones are
merged by a heap of pairs, in time about linear in their bytes.

Decoding maps ids back to byte-level tokens; ``RestoreText`` is the incremental
byte-to-text machine (a UTF-8 state machine fed token by token, holding back an
unfinished character), ``decoded`` the library's ``decode`` string.

Defined cases: a null text is an empty one (no ids, empty strings); added
tokens inside a text become their ids, as the library does by default; extra
columns are kept, the result columns are appended under the names asked for.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 16_384        # bytes of a long pre-token settled per step, beside the lookahead
CACHE_CHUNKS = 150_000  # chunks remembered per worker before the memory is emptied
_NONE = np.uint32(0xFFFFFFFF)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _char_class(first: str) -> str:
    """All characters of a Unicode major category, as ranges inside a regex class."""
    category = unicodedata.category
    of = np.array([category(chr(cp))[0] == first for cp in range(0x323B0)] + [False])  # none assigned beyond
    edge = np.flatnonzero(np.diff(np.r_[False, of].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())


class PairTable:
    """Rank of a symbol pair, by two hash probes over numpy arrays."""

    BITS = 19

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        rng = np.random.default_rng(5)
        while True:
            self.mult = [np.uint32(x | 1) for x in rng.integers(1 << 20, 1 << 32, 2, dtype=np.uint64)]
            self.slots = [np.full(1 << self.BITS, np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(2)]
            rest = np.arange(len(keys))
            for mult, slots in zip(self.mult, self.slots):
                at = self._slot(keys[rest], mult)
                _, first = np.unique(at, return_index=True)
                chosen = rest[first]
                slots[at[first]] = (keys[chosen].astype(np.uint64) << np.uint64(32)) | values[chosen].astype(np.uint64)
                rest = np.setdiff1d(rest, chosen)
            if not len(rest):
                return

    def _slot(self, keys, mult):
        return (keys * mult) >> np.uint32(32 - self.BITS)

    def get(self, keys: np.ndarray) -> np.ndarray:
        got = self.slots[0][self._slot(keys, self.mult[0])]
        out = np.where((got >> np.uint64(32)).astype(np.uint32) == keys, got.astype(np.uint32), _NONE)
        missed = np.flatnonzero(out == _NONE)
        got = self.slots[1][self._slot(keys[missed], self.mult[1])]
        hit = (got >> np.uint64(32)).astype(np.uint32) == keys[missed]
        out[missed[hit]] = got[hit].astype(np.uint32)
        return out


def sufficient_lookahead(merges: list[tuple[str, str]], width) -> int:
    """Bytes beyond a token's end that can still change its boundary.

    ``reach[x]``: the farthest that a merge with left part ``x`` (and whatever
    may disturb that merge's right part) looks past the end of ``x``, over the
    merges read so far, all of higher priority than the present one.
    """
    parts: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}

    def right_edge(token: str):
        while True:
            yield token
            if token not in parts:
                return
            token = parts[token][1]

    for left, right in merges:
        need = width(right) + max(reach.get(x, 0) for x in right_edge(right))
        reach[left] = max(reach.get(left, 0), need)
        parts[left + right] = (left, right)
    return max([1, *reach.values()])


class WordBpe:
    """A BPE model with an end-of-word mark, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        width = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        self.lookahead = sufficient_lookahead(merges, width)
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.uint32)
        self.final = np.array([self.vocab[s + self.suffix] for s in symbols], np.uint32)
        keys = np.array([(self.vocab[a] << 16) | self.vocab[b] for a, b in merges], np.uint32)
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids is not supported")
        self.pairs = PairTable(keys, np.arange(len(merges), dtype=np.uint32))
        self.product = np.array([self.vocab[a + b] for a, b in merges], np.uint32)
        self.ranks = {key: rank for rank, key in enumerate(keys.tolist())}
        self.products = self.product.tolist()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.width = np.zeros(size, np.int64)
        self.strings = [""] * size
        self.raw = [b""] * size
        back = {s: b for b, s in enumerate(symbols)}
        for token, i in self.vocab.items():
            self.width[i] = width(token)
            self.strings[i] = token
            ended = bool(self.suffix) and token.endswith(self.suffix)
            body = token[:-len(self.suffix)] if ended else token
            self.raw[i] = bytes(back[c] for c in body) + (b" " if ended else b"")
        for token, i in self.added.items():
            self.strings[i], self.raw[i] = token, token.encode()
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        letters, numbers = _char_class("L"), _char_class("N")
        tails = "'s|'t|'re|'ve|'m|'ll|'d"
        self.wide = re.compile(f"[{letters}]+|{tails}|[{numbers}]|[^{white}{letters}{numbers}]+")
        self.ascii = re.compile(f"[a-z]+|{tails}|[0-9]|[^\\t-\\r a-z0-9]+")
        self.separators = re.compile("[\x1c-\x1f]")  # str.split() cuts there, the model does not
        self.cache: dict[str, bytes] = {}

    # --- pre-tokens -------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """Lower-cased stretches between white space; no token reaches over white space."""
        if not text.isascii():
            # lower-casing goes character by character: no final-sigma rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [text] if self.separators.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if chunk.isascii():
            return self.ascii.findall(chunk)
        return self.wide.findall(chunk)

    # --- merging ----------------------------------------------------------------

    def _merge(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all pieces (``sym[start[i]:start[i + 1]]``) to the end; same layout back."""
        n = len(start) - 1
        done_sym: list[np.ndarray] = []
        done_piece: list[np.ndarray] = []
        piece = np.repeat(np.arange(n), np.diff(start))
        while len(sym):
            key = (sym[:-1] << np.uint32(16)) | sym[1:]
            rank = np.full(len(sym), _NONE)
            rank[:-1] = self.pairs.get(key)
            last = np.ones(len(sym), bool)
            last[:-1] = piece[:-1] != piece[1:]
            rank[last] = _NONE
            first = np.flatnonzero(np.r_[True, last[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            best_here = np.repeat(best, size)
            live = best_here != _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_piece.append(piece[~live])
                sym, piece, rank, best_here = sym[live], piece[live], rank[live], best_here[live]
                if not len(sym):
                    break
            hit = rank == best_here
            twin = hit[1:] & hit[:-1]
            if twin.any():  # overlapping hits of one pair (aaa): from the left, every other one
                at = np.flatnonzero(hit)
                run = np.r_[True, np.diff(at) != 1]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - begin) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.product[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, piece = sym[keep], piece[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return sym[order], np.r_[0, np.cumsum(np.bincount(piece, minlength=n))]

    def encode_words(self, words: list[str], window: int = WINDOW) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each pre-token; long ones window by window."""
        raw = [w.encode() for w in words]
        short = [i for i, x in enumerate(raw) if len(x) <= 64 + self.lookahead]
        out = [b""] * len(raw)
        if short:
            for i, ids in zip(short, self._settle([raw[i] for i in short])):
                out[i] = ids
        if len(short) < len(raw):
            chosen = set(short)
            for i, x in enumerate(raw):
                if i not in chosen:
                    out[i] = self._stream(x, window)
        return out

    def _settle(self, bufs: list[bytes]) -> list[bytes]:
        """Ids of whole pre-tokens."""
        flat = np.frombuffer(b"".join(bufs), np.uint8)
        start = np.r_[0, np.cumsum(np.fromiter(map(len, bufs), np.int64, len(bufs)))]
        sym = self.inner[flat]
        sym[start[1:] - 1] = self.final[flat[start[1:] - 1]]
        sym, at = self._merge(sym, start)
        data, at = sym.tobytes(), at.tolist()
        return [data[4 * a:4 * b] for a, b in zip(at, at[1:])]

    def _stream(self, raw: bytes, window: int) -> bytes:
        """Ids of one long pre-token: what ends before the lookahead zone of a window is stable."""
        parts, pos = [], 0
        while True:
            buf = np.frombuffer(raw, np.uint8, min(len(raw) - pos, window + self.lookahead), pos)
            sym = self.inner[buf]
            last = pos + len(buf) == len(raw)
            if last:
                sym[-1] = self.final[buf[-1]]
            ids = self._merge_heap(sym.tolist())
            if last:
                return b"".join([*parts, ids.tobytes()])
            end = np.cumsum(self.width[ids])
            n = int(np.searchsorted(end, max(window, int(end[0])), "right"))
            parts.append(ids[:n].tobytes())
            pos += int(end[n - 1])

    def _merge_heap(self, sym: list[int]) -> np.ndarray:
        """Merge one piece to the end: the pair of least rank first, of equal ones the leftmost."""
        ranks, product = self.ranks, self.products
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = []
        for i in range(len(sym) - 1):
            rank = ranks.get((sym[i] << 16) | sym[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        n = len(sym)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or ranks.get((sym[i] << 16) | sym[j]) != rank:
                continue  # one of the pair was merged meanwhile
            sym[i], sym[j] = product[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((sym[i] << 16) | sym[k])
                if found is not None:
                    heapq.heappush(heap, (found, i))
            if before[i] >= 0:
                found = ranks.get((sym[before[i]] << 16) | sym[i])
                if found is not None:
                    heapq.heappush(heap, (found, before[i]))
        return np.array([x for x in sym if x >= 0], np.uint32)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        lists = [self.chunks(t) for t in texts]
        new = set().union(*lists).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = set().union(*lists)
        fresh = list(new)
        for k in range(0, len(fresh), 20_000):
            part = fresh[k:k + 20_000]
            words = [self.words(c) for c in part]
            distinct = list({w for ws in words for w in ws})
            ids = dict(zip(distinct, self.encode_words(distinct)))
            for c, ws in zip(part, words):
                self.cache[c] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))
        out = [b"".join(map(self.cache.__getitem__, ws)) for ws in lists]
        for c in fresh:
            if len(c) > 4096:  # used once, not remembered
                del self.cache[c]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if self.split_added is None or not any(self.split_added.search(t) for t in texts):
            return self._encode_plain(texts)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for k, part in enumerate(self.split_added.split(t)):
                if part:
                    pieces.append((part, k % 2))
                    owner.append(i)
        plain = iter(self._encode_plain([p for p, special in pieces if not special]))
        out = [b""] * len(texts)
        for i, (p, special) in zip(owner, pieces):
            out[i] += np.uint32(self.added[p]).tobytes() if special else next(plain)
        return out

    # --- decoding ---------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The library's ``decode``: with no decoder in the file, tokens joined by a space."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))

    def restore(self, ids: np.ndarray) -> str:
        machine = RestoreText(self)
        return machine.feed(ids) + machine.end()


class RestoreText:
    """Byte-to-text machine: feed ids in any portions, get the text that is settled.

    State: the UTF-8 decoder's unfinished character (at most three bytes).
    Bytes that are not UTF-8 become U+FFFD.
    """

    def __init__(self, model: WordBpe):
        self.raw = model.raw
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.utf8.decode(b"".join(map(self.raw.__getitem__, ids.tolist())))

    def end(self) -> str:
        return self.utf8.decode(b"", True)


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The model of a worker process, read once."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode_column(text: Column, path: str) -> Column:
    """A struct column ``(ids BINARY, n_tokens BIGINT)``; ids as little-endian uint32."""

    @F.arrow_udf("struct<ids:binary,n_tokens:bigint>")
    def encoded(texts: pa.Array) -> pa.Array:
        ids = model(path).encode(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["ids", "n_tokens"])

    return encoded(text)


def round_trip_column(text: Column, path: str) -> Column:
    """A struct column ``(ids, n_tokens, decoded, restored)``."""

    @F.arrow_udf("struct<ids:binary,n_tokens:bigint,decoded:string,restored:string>")
    def coded(texts: pa.Array) -> pa.Array:
        m = model(path)
        ids = m.encode(texts.to_pylist())
        nums = [np.frombuffer(x, "<u4") for x in ids]
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([len(x) for x in nums], pa.int64()),
             pa.array([m.decode(x) for x in nums], pa.string()), pa.array([m.restore(x) for x in nums], pa.string())],
            ["ids", "n_tokens", "decoded", "restored"])

    return coded(text)


def round_trip_digests(text: Column, path: str) -> Column:
    """A struct column ``(ids, n_tokens, decoded_sha256, restored_sha256)``: the decoded texts stay in the worker."""

    @F.arrow_udf("struct<ids:binary,n_tokens:bigint,decoded_sha256:string,restored_sha256:string>")
    def coded(texts: pa.Array) -> pa.Array:
        m = model(path)
        ids = m.encode(texts.to_pylist())
        nums = [np.frombuffer(x, "<u4") for x in ids]
        digests = [pa.array([hashlib.sha256(f(x).encode()).hexdigest() for x in nums], pa.string()) for f in (m.decode, m.restore)]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(x) for x in nums], pa.int64()), *digests],
                                          ["ids", "n_tokens", "decoded_sha256", "restored_sha256"])

    return coded(text)


def encode_decode(df: DataFrame, path: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """``df`` with a struct column ``out`` of ids, count, library decode and restored text."""
    return df.withColumn(out, round_trip_column(F.col(text_col), path))
