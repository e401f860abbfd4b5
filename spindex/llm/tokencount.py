"""Token counts by a separator scan over flat, unindexed token files.

Method.  A token file is a flat run of token ids; documents follow each other
with an end-of-document id after each, and nothing says where they begin.  The
file is read in blocks of any size, cut without regard to documents.  Each
block is searched for the separator in one numpy comparison; it yields the
counts of the documents that lie inside it, the tokens before its first and
after its last separator, and its number of separators.  A prefix scan over
the block summaries (within groups of ``GROUP`` blocks, then over the groups)
gives each block the number of documents before it and the tokens carried into
it, so documents that reach over blocks are stitched together.

``write_tokens`` makes such files from documents (one file per input
partition), kept as block rows ``(file, block, data)`` in the shared folder.

Defined cases: an empty file or table has no documents; a last document without
a separator counts if it has tokens; adjacent separators enclose documents of
no tokens; a document without text has none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm.common import utf8
from spindex.session import materialize

BLOCK_TOKENS = 1 << 14  # 32 KB a row: readers hold thousands of rows at a time
GROUP = 512
DTYPE = "<u2"

# Fixed values of the public byte-level vocabulary: 1 ends a document, a byte b has id b + 3.
EOD = 1
BYTE_OFFSET = 3


def byte_tokens(buf: np.ndarray) -> np.ndarray:
    return buf.astype(DTYPE) + np.uint16(BYTE_OFFSET)


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encode: Callable = byte_tokens,
                 eod: int = EOD, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of the documents, as rows ``(file, block, data, ids)``.

    ``encode`` turns the UTF-8 bytes of a text into ids other than ``eod``.  ``ids`` are the documents
    whose separators lie in the block; the scan does not read that column.
    """

    def write(batches):
        file, block = TaskContext.get().partitionId(), 0
        held, size, ids = [], 0, []
        ends: list[int] = []  # where separators lie, from the start of what is held
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                held.append(np.append(encode(buf[a:b]).astype(dtype), np.array([eod], dtype)))
                size += len(held[-1])
                ids.append(doc)
                ends.append(size - 1)
                if size < block_tokens:
                    continue
                flat, at, whole = np.concatenate(held), np.array(ends), size // block_tokens * block_tokens
                for lo in range(0, whole, block_tokens):
                    m, n = np.searchsorted(at, [lo, lo + block_tokens])
                    yield _block(file, block, flat[lo:lo + block_tokens], ids[m:n])
                    block += 1
                n = int(np.searchsorted(at, whole))
                held, size = [flat[whole:].copy()], size - whole
                ids, ends = ids[n:], [e - whole for e in ends[n:]]
        if size:
            yield _block(file, block, np.concatenate(held), ids)

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(write, "file int, block bigint, data binary, ids array<bigint>")
    return materialize(rows, "token-files")


def _block(file: int, block: int, data: np.ndarray, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()),
         pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])


def read_binary_files(spark, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Block rows of raw binary token files (each below 2 GB, the limit of a binary value)."""
    width = np.dtype(dtype).itemsize * block_tokens

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                for k, a in enumerate(range(0, len(data), width)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array(
                        [data[a:a + width].to_pybytes()], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        cut, "file string, block bigint, data binary")


def count_tokens(blocks: DataFrame, eod: int = EOD, dtype: str = DTYPE, group: int = GROUP) -> DataFrame:
    """``(file, nth, n_tokens)``: the documents of each file in order, with their token counts."""

    @F.arrow_udf("struct<seps:bigint,head:bigint,tail:bigint,inner:array<int>>")
    def scanned(data: pa.Array) -> pa.Array:
        seps, head, tail, inner = [], [], [], []
        for d in data:
            ids = np.frombuffer(d.as_buffer(), dtype)
            at = np.flatnonzero(ids == eod)
            seps.append(len(at))
            head.append(int(at[0]) if len(at) else len(ids))
            tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            inner.append((np.diff(at) - 1).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(seps, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()),
             pa.array(inner, pa.list_(pa.int32()))], ["seps", "head", "tail", "inner"])

    scan = blocks.select("file", "block", scanned(F.col("data")).alias("s")) \
        .select("file", "block", F.floor(F.col("block") / group).alias("part"), "s.*")
    scan = materialize(scan, "token-scan")
    # prefix scan: (documents before, tokens since the last separator before), first over parts of a file
    parts = scan.groupBy("file", "part").agg(
        F.sum("seps").alias("p_seps"),
        F.max(F.when(F.col("seps") > 0, F.col("block"))).alias("p_last"),
        F.collect_list(F.struct("block", "seps", "tail")).alias("p_blocks"))  # at most `group` entries
    open_tokens = F.expr("aggregate(p_blocks, 0L, (acc, b) -> acc + IF(p_last IS NULL OR b.block >= p_last, b.tail, 0L))")
    parts = parts.select("file", "part", "p_seps", F.col("p_last").isNotNull().alias("p_cut"), open_tokens.alias("p_open"))
    before = _carry(parts, ["file"], "part", "p_seps", "p_cut", "p_open").select(
        "file", "part", F.col("docs").alias("part_docs"), F.col("carry").alias("part_carry"))
    cut = scan.withColumn("cut", F.col("seps") > 0)
    within = _carry(cut, ["file", "part"], "block", "seps", "cut", "tail", no_cut="fresh")
    joined = within.join(before, ["file", "part"])
    carry = F.col("carry") + F.when(F.col("fresh"), F.col("part_carry")).otherwise(F.lit(0))
    at = joined.select("file", "block", (F.col("docs") + F.col("part_docs")).alias("docs"), carry.alias("carry"),
                       "seps", "head", "tail", "inner")
    ended = at.where("seps > 0").select("file", "docs", F.posexplode(
        F.concat(F.array((F.col("carry") + F.col("head")).cast("bigint")), F.col("inner").cast("array<bigint>"))).alias("i", "n_tokens"))
    ended = ended.select("file", (F.col("docs") + F.col("i")).alias("nth"), "n_tokens")
    # what follows the last separator of a file
    rest = scan.groupBy("file").agg(F.max("block").alias("block")).join(at, ["file", "block"]) \
        .select("file", (F.col("docs") + F.col("seps")).alias("nth"),
                (F.col("tail") + F.when(F.col("seps") > 0, F.lit(0)).otherwise(F.col("carry"))).alias("n_tokens"))
    return ended.union(rest.where("n_tokens > 0"))


def _carry(df: DataFrame, by: list[str], order: str, seps: str, cut: str, open_: str, no_cut: str | None = None) -> DataFrame:
    """Exclusive prefix scan along ``order``: documents ended before, and tokens since the last cut."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.coalesce(F.sum(F.col(cut).cast("bigint")).over(w), F.lit(0))
    out = df.withColumn("docs", F.coalesce(F.sum(seps).over(w), F.lit(0))).withColumn("__run", cuts)
    # rows of one run: the cutting row (which opens the next run) adds its tail there
    opened = F.col("__run") + F.col(cut).cast("bigint")
    total = F.sum(open_).over(Window.partitionBy(*by, "__opened").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__opened", opened).withColumn("__total", total)
    last = F.lag("__total").over(Window.partitionBy(*by).orderBy(order))
    out = out.withColumn("carry", F.coalesce(last, F.lit(0)))
    if no_cut:
        out = out.withColumn(no_cut, F.col("__run") == 0)
    return out.drop("__run", "__opened", "__total")


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, n_tokens)`` of documents, by way of flat token files and their scan."""
    files = write_tokens(docs, id_col, text_col, **options)
    counts = count_tokens(files.select("file", "block", "data"))
    named = files.select("file", "block", F.size("ids").alias("n"), "ids")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))) \
        .select("file", "before", F.posexplode("ids").alias("i", "id"))
    named = named.select("file", (F.col("before") + F.col("i")).alias("nth"), "id")
    return named.join(counts, ["file", "nth"]).select(F.col("id").alias(id_col), "n_tokens")
