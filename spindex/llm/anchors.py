"""Vector code compression: exact k-means codebooks per part through metric trees.

Method.  Vectors become integers floor(4096 x) and are cut into 8 equal parts.  For
every part position the points of a block get an anchors hierarchy: the block is
split by about sqrt(n) anchors, each new anchor being the point farthest from its
owner and stealing only points that the triangle inequality does not rule out; the
anchors are merged bottom-up, closest balls first, into the top of the tree, and
each anchor's points are split the same way below (middle-out).  Every ball caches
its pivot, radius, count and integer sum.

A round walks the trees from the roots with a list of candidate entries per ball.
An entry leaves the list, for the ball and all below it, when some other entry is
nearer for every point of the ball: |p-c|^2 - |p-c'|^2 > 2 r |c-c'| for pivot p and
radius r.  A ball with one entry left is wholly owned and gives its cached sum and
count without a look at its points; leaf balls compare their points with the
entries left.  Pivots and radii are floats, with a slack above their rounding
error, so they only rule out; all comparisons that decide, sums and errors are
exact integers.  The result equals the plain rounds', ties to the lower index.

Spark deals the work: blocks of rows are made inside the tasks that read them (no
shuffle) and their trees are written once; each round maps over the blocks with the
codebook (16 entries) and adds up sums per (part, entry, component), 16 numbers per
component of a vector whatever the number of rows.

Result of ``compress``: ``Compressed(codebooks, rows)``; the rows have the ``keep``
columns, ``code`` and ``error``.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped, and so are rows of another length than the row of the smallest id has, or
with a component whose integer does not fit 63 bits; null ids come after all others
and rows with equal ids go by vector; a length that is no multiple of the parts is
filled up with zeros; empty vectors have the code of entry 0 and no error; fewer
rows than entries give smaller codebooks; equal entries: the lower index has all
points; an error that does not fit a long is null; an empty table gives no rows;
other columns, whatever their names, are left out unless kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindex.session import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LEAF = 32
BLOCK_ROWS = 4096
BLOCK_COMPONENTS = 1 << 20  # a block holds so many numbers at most, or one row
EXACT = float(1 << 52)  # floats hold all integers up to here
WIDEST = 2.0 ** 63


def usable(vector: Column) -> Column:
    """All components are finite and their integers fit 63 bits."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < WIDEST))
    return vector.isNotNull() & F.coalesce(fits, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE x), exactly: floats if all squares of differences stay exact, else Python integers."""
    scaled = vectors * SCALE  # a power of two: exact
    whole = np.floor(scaled)
    top = np.abs(whole).max(initial=0)
    if max(1, vectors.shape[-1]) * (2 * top + 2) ** 2 < EXACT:
        return whole + 0.0  # no negative zero
    return np.array([int(x) for x in whole.ravel()], dtype=object).reshape(whole.shape)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries (exact for what ``integers`` returns)."""
    if len(points) and points.shape[1] == 0:
        return np.zeros((len(points), len(entries)), points.dtype)
    apart = points[:, None, :] - entries[None, :, :]
    return (apart * apart).sum(axis=2)


# --- trees --------------------------------------------------------------------------

@dataclass
class Tree:
    order: np.ndarray   # the block's row numbers, so that each ball is one stretch
    start: np.ndarray   # stretch of a ball
    end: np.ndarray
    left: np.ndarray    # children, -1 for a leaf ball
    right: np.ndarray
    pivot: np.ndarray   # float centre
    radius: np.ndarray  # at least the distance of any point
    total: np.ndarray   # integer sum of the points


def grow_anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Split points into balls around up to ``most`` anchors: row numbers per anchor."""
    owner = np.zeros(len(points), np.int64)
    dist = np.sqrt(((points - points[0]) ** 2).sum(1))
    anchors = [points[0]]
    while len(anchors) < most:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        new, me = points[far], len(anchors)
        between = np.sqrt(((np.stack(anchors) - new) ** 2).sum(1))
        # a point nearer to its owner than half way to the new anchor stays
        may = np.flatnonzero(dist >= between[owner] / 2 * (1 - 1e-9))
        to_new = np.sqrt(((points[may] - new) ** 2).sum(1))
        moves = to_new < dist[may]
        owner[may[moves]], dist[may[moves]] = me, to_new[moves]
        anchors.append(new)
    return [x for x in (np.flatnonzero(owner == a) for a in range(len(anchors))) if len(x)]


def merge_order(centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Agglomerate balls, the smallest common ball first: pairs of numbers, ball k + i being the i-th pair."""
    k = len(centres)
    centres, radii, sizes = centres.copy(), radii.copy(), sizes.astype(float)
    number = np.arange(k)

    def to_all(i):
        apart = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        return np.maximum((apart + radii + radii[i]) / 2, np.maximum(radii, radii[i]))

    common = np.stack([to_all(i) for i in range(k)])
    np.fill_diagonal(common, np.inf)
    out = []
    for step in range(k - 1):
        i, j = divmod(int(common.argmin()), k)
        out.append((int(number[i]), int(number[j])))
        radius = common[i, j]
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / (sizes[i] + sizes[j])
        radii[i], sizes[i], number[i] = radius, sizes[i] + sizes[j], k + step
        common[j, :] = common[:, j] = np.inf
        gone = np.isinf(common[i])
        row = to_all(i)
        row[gone] = np.inf
        row[i] = np.inf
        common[i, :] = common[:, i] = row
    return out


def build_tree(points: np.ndarray) -> Tree:
    """The anchors hierarchy of one part of a block; ``points`` as ``integers`` returns them."""
    near = points.astype(float)
    order = np.arange(len(points))
    start, end, left, right = [0], [len(points)], [-1], [-1]
    open_balls = [0]
    while open_balls:
        ball = open_balls.pop()
        a, b = start[ball], end[ball]
        rows = order[a:b]
        if len(rows) <= LEAF:
            continue
        groups = grow_anchors(near[rows], int(np.ceil(np.sqrt(len(rows)))))
        if len(groups) < 2:
            continue  # copies of one point
        inside = [near[rows[g]] for g in groups]
        centres = np.stack([x.mean(0) for x in inside])
        radii = np.array([np.sqrt(((x - c) ** 2).sum(1).max()) for x, c in zip(inside, centres)])
        merges = merge_order(centres, radii, np.array([len(g) for g in groups]))
        # number the merged balls from the top, laying their rows side by side
        k, at, pending = len(groups), a, [(len(groups) + len(merges) - 1, ball)]
        laid = []
        while pending:
            number, node = pending.pop()
            start[node] = at
            if number < k:
                laid.append(rows[groups[number]])
                at += len(groups[number])
                open_balls.append(node)
                continue
            for child in reversed(merges[number - k]):
                start.append(0), end.append(0), left.append(-1), right.append(-1)
                pending.append((child, len(start) - 1))
            left[node], right[node] = len(start) - 1, len(start) - 2
        order[a:b] = np.concatenate(laid)
        _close(ball, start, end, left, right, {n: len(groups[n]) for n in range(k)}, merges, k)
    order = np.asarray(order)
    sorted_points, sorted_near = points[order], near[order]
    n, d = len(start), points.shape[1]
    pivot, radius, total = np.zeros((n, d)), np.zeros(n), np.zeros((n, d), points.dtype)
    for i in range(n):
        stretch = sorted_near[start[i]:end[i]]
        if len(stretch):
            pivot[i] = stretch.mean(0)
            radius[i] = np.sqrt(((stretch - pivot[i]) ** 2).sum(1).max())
            total[i] = sorted_points[start[i]:end[i]].sum(0)
    return Tree(order, np.array(start), np.array(end), np.array(left), np.array(right), pivot, radius, total)


def _close(ball, start, end, left, right, sizes, merges, k) -> None:
    """Set the ends of the balls under ``ball``: the next ball's start in the order they were laid."""
    stack = [(k + len(merges) - 1, ball)]
    weight = dict(sizes)
    for i, (x, y) in enumerate(merges):
        weight[k + i] = weight[x] + weight[y]
    while stack:
        number, node = stack.pop()
        end[node] = start[node] + weight[number]
        if number >= k:
            x, y = merges[number - k]
            stack += [(x, left[node]), (y, right[node])]


# --- assignment -----------------------------------------------------------------------

def first_of_equals(entries: np.ndarray) -> np.ndarray:
    """Entries that no lower index equals (the others never win a tie)."""
    seen, out = set(), np.ones(len(entries), bool)
    for i, e in enumerate(map(tuple, entries.tolist())):
        out[i] = e not in seen
        seen.add(e)
    return out


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of every point (row order of the block), sums and counts per entry, points compared one by one."""
    k, d = len(entries), points.shape[1]
    code = np.zeros(len(points), np.uint8)
    sums, counts = np.zeros((k, d), object), np.zeros(k, np.int64)
    near = entries.astype(float)
    largest = max(np.abs(near).max(initial=0), np.abs(tree.pivot).max(initial=0) + tree.radius.max(initial=0), 1.0)
    slack = 1e-9 * d * (2 * largest) ** 2  # rounding errors are below a millionth of this
    between = np.sqrt(squares(near, near))
    balls, listed = np.array([0]), first_of_equals(entries)[None, :]
    compared = 0
    while len(balls):
        away = np.where(listed, squares(tree.pivot[balls], near), np.inf)
        best = away.argmin(1)
        lead = away - away[np.arange(len(balls)), best][:, None]
        listed = listed & ~(lead > 2 * tree.radius[balls][:, None] * between[best] * (1 + 1e-9) + slack)
        owned = listed.sum(1) == 1
        for ball, entry in zip(balls[owned], best[owned]):
            a, b = tree.start[ball], tree.end[ball]
            code[tree.order[a:b]] = entry
            sums[entry] += tree.total[ball]
            counts[entry] += b - a
        leaf = ~owned & (tree.left[balls] < 0)
        if leaf.any():
            stretch = [np.arange(tree.start[x], tree.end[x]) for x in balls[leaf]]
            rows = tree.order[np.concatenate(stretch)]
            lists = np.repeat(listed[leaf], [len(s) for s in stretch], axis=0)
            exact = squares(points[rows], entries)
            far = exact.max(initial=0) + 1
            found = np.where(lists, exact, far).argmin(1)
            code[rows] = found
            compared += len(rows)
            for entry in np.unique(found):
                mine = rows[found == entry]
                sums[entry] += points[mine].sum(0)
                counts[entry] += len(mine)
        inner = ~owned & ~leaf
        balls, listed = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]]), np.concatenate([listed[inner]] * 2)
    return code, sums, counts, compared


# --- Spark ------------------------------------------------------------------------------

@dataclass
class Compressed:
    codebooks: list[list[list[int]]]  # part -> entry -> components
    rows: DataFrame


def codebook_text(codebooks: list[list[list[int]]]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(x) for part in codebooks for entry in part for x in entry)


def _padded(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Filled up with zeros to a multiple of the parts."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % parts)))


def _blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """``(kept, v)`` rows -> blocks ``(kept array, packed)``, made inside the tasks that read the rows."""
    most = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(length, 1)))
    schema = T.StructType([T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType)), T.StructField("packed", T.BinaryType())])

    def pack(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        flat = table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"]
        vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), length)
        points = integers(_padded(vectors, parts))
        cut = np.split(points, parts, axis=1)
        packed = pickle.dumps([(_small(x), build_tree(x)) for x in cut], protocol=pickle.HIGHEST_PROTOCOL)
        kept = table["kept"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([packed], pa.binary())], ["kept", "packed"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                take = min(most - n, len(batch))
                held.append(batch.slice(0, take))
                n, batch = n + take, batch.slice(take)
                if n == most:
                    yield pack(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    return rows.mapInArrow(blocks, schema)


def _small(points: np.ndarray) -> np.ndarray:
    """A narrow copy for storage."""
    fits = points.dtype != object and np.abs(points).max(initial=0) < 1 << 31
    return points.astype(np.int32) if fits else points


def _unpack(packed: bytes) -> Iterator[tuple[np.ndarray, Tree]]:
    for points, tree in pickle.loads(packed):
        yield (points.astype(float) if points.dtype == np.int32 else points), tree


def _entries(codebook: list[list[int]], points: np.ndarray) -> np.ndarray:
    """A part's entries in the arithmetic of the points: floats while all squares stay exact."""
    whole = np.array(codebook, dtype=object).reshape(len(codebook), points.shape[1])
    top = max([abs(x) for x in whole.ravel()], default=0)
    if points.dtype != object and max(1, points.shape[1]) * (2 * max(top, np.abs(points).max(initial=0)) + 2) ** 2 < EXACT:
        return whole.astype(float)
    return whole


def _sums(blocks: DataFrame, codebooks: list[list[list[int]]]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """One round: (part, entry, position) -> sum and count of the points that the entry has."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [[[0, np.zeros(len(entry), object)] for entry in part] for part in codebooks]
        for batch in batches:
            for packed in batch["packed"]:
                for part, (points, tree) in enumerate(_unpack(packed.as_py())):
                    entries = _entries(codebooks[part], points)
                    points = points if entries.dtype != object else _whole(points)
                    _, sums, counts, _ = assign(tree, points, entries)
                    for e in np.flatnonzero(counts):
                        acc[part][e][0] += int(counts[e])
                        acc[part][e][1] = acc[part][e][1] + _whole(sums[e])
        out = [(part, e, i, int(x), n) for part, book in enumerate(acc) for e, (n, s) in enumerate(book) if n for i, x in enumerate(s)]
        names = ["part", "entry", "at", "total", "n"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(r[i]) if i == 3 else r[i] for r in out], types[i]) for i in range(5)], names)

    schema = "part INT, entry INT, at INT, total DECIMAL(38,0), n BIGINT"
    rows = blocks.select("packed").mapInArrow(total, schema).groupBy("part", "entry", "at") \
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {(r["part"], r["entry"], r["at"]): (int(r["total"]), r["n"]) for r in rows.collect()}


def _whole(points: np.ndarray) -> np.ndarray:
    """As Python integers."""
    return np.array([int(x) for x in points.ravel()], dtype=object).reshape(points.shape)


def _codes(blocks: DataFrame, codebooks: list[list[list[int]]], kept: T.DataType) -> DataFrame:
    """The last assignment: ``kept, code, error`` per row."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = batch["kept"].slice(i, 1).flatten()
                found, errors = [], 0
                for part, (points, tree) in enumerate(_unpack(batch["packed"][i].as_py())):
                    entries = _entries(codebooks[part], points)
                    points = points if entries.dtype != object else _whole(points)
                    mine = assign(tree, points, entries)[0]
                    apart = points - entries[mine]
                    errors = errors + _whole((apart * apart).sum(axis=1) if points.shape[1] else np.zeros(len(points)))
                    found.append(mine)
                codes = np.stack(found, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([row.tobytes().hex() for row in codes], pa.string()),
                     pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], ["kept", "code", "error"])

    schema = T.StructType([T.StructField("kept", kept), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.mapInArrow(code, schema).select("kept.*", "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Fit the codebooks on all rows and encode them all."""
    keep = [id_col] if keep is None else keep
    rows = vectors.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")))
    lead = rows.select("id", F.size("v").alias("length")).orderBy(F.col("id").asc_nulls_last(), "v").first()
    length = lead["length"] if lead else 0
    rows = rows.where(F.size("v") == length)
    first = [r["v"] for r in rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    start = _whole(integers(_padded(np.array(first, float).reshape(len(first), length), parts)))
    codebooks = [part.tolist() for part in np.split(start, parts, axis=1)]
    blocks = materialize(_blocks(rows.select("kept", "v"), length, parts), "anchor-blocks")
    for _ in range(rounds):
        sums = _sums(blocks, codebooks)
        for part, book in enumerate(codebooks):
            for e, entry in enumerate(book):
                book[e] = [sums[part, e, i][0] // sums[part, e, i][1] if (part, e, i) in sums else x for i, x in enumerate(entry)]
    return Compressed(codebooks, _codes(blocks, codebooks, rows.schema["kept"].dataType))
