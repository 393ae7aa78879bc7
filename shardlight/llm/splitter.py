"""Splitting oversized texts at natural boundaries.

A text longer than ``limit`` characters becomes pieces of at most ``limit``, consecutive ones overlapping by ``overlap``. A piece
ends, within the last ``reach`` characters it may have, at the last paragraph break; failing that, at the last end
of a sentence; then at white space; then where no word or number is cut; else at the limit.

Texts are worked on in ranges with a halo, so no task needs a whole text. A worker classes the boundaries of its range and works
out, for every place at which a piece may begin there, where the first piece beyond the range will begin and how many pieces
come before it: a table of ``limit`` entries. Tables compose, so those of a text are stitched by a segmented scan: runs of ``width`` tables
become one table each until one run is left, and the way back gives every range its entry, its piece number and, as a prefix sum
of lengths, its start. No task sees more than ``width`` tables of a text. Each range then emits its pieces by offset. Texts of a single range need
no stitching. :func:`file_ranges` reads ranges of giant files by byte offset in the same form.

Null, empty and short texts give no pieces. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardlight.runtime import WHITESPACE, shuffle_width, stored

#: Marks that can end a sentence.
TERMINATORS = ".!?。！？।؟"


@dataclass(frozen=True)
class SplitOptions:
    limit: int = 512
    overlap: int = 50
    reach: int = 100
    range_chars: int = 65_536

    def __post_init__(self):
        if not 0 <= self.overlap < self.limit - self.reach:
            raise ValueError("the overlap must be less than limit minus reach, or pieces don't advance")


# -- one range ------------------------------------------------------------------------------------------------------
def _classes(points: np.ndarray) -> np.ndarray:
    """Per character: 1 white space, 2 line feed, 4 terminator, 8 letter or number, 16 wide script terminator."""
    distinct, inverse = np.unique(points, return_inverse=True)
    bits = np.zeros(len(distinct), np.uint8)
    for i, p in enumerate(distinct.tolist()):
        c = chr(p)
        bits[i] = (
            (1 if c in WHITESPACE else 0) | (2 if c == "\n" else 0) | (4 if c in TERMINATORS else 0)
            | (8 if unicodedata.category(c)[0] in "LN" else 0) | (16 if c in "。！？।" else 0)
        )
    return bits[inverse]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cut_after(text: str, opts: SplitOptions) -> np.ndarray:
    """For each start s with more than ``limit`` characters after it, the end of the piece that begins at s."""
    kind = _classes(_points(text))
    n = len(kind)
    before, at = kind[:-1], kind[1:]  # of the cut between characters e-1 and e, at index e-1
    ends = np.arange(1, n)
    space_before = (before & 1) > 0
    paragraph = ((before & 2) > 0) & (np.r_[np.uint8(0), before[:-1]] & 2 > 0)
    sentence = ((before & 4) > 0) & (((at & 1) > 0) | ((before & 16) > 0))
    blank = space_before | ((at & 1) > 0)
    whole = ~(((before & 8) > 0) & ((at & 8) > 0))
    starts = np.arange(max(0, n - opts.limit))
    limit_index = starts + opts.limit - 1  # index of the cut at s + limit
    result = starts + opts.limit
    open_ = np.ones(len(starts), bool)
    for level in (paragraph, sentence, blank, whole):
        last = np.maximum.accumulate(np.where(level, ends, 0)) if n > 1 else np.zeros(0, np.int64)
        best = last[np.minimum(limit_index, len(last) - 1)] if len(last) else np.zeros(len(starts), np.int64)
        good = open_ & (best > starts + opts.limit - opts.reach)
        result[good] = best[good]
        open_ &= ~good
    return result


def walk(text: str, final: bool, size: int, entries: np.ndarray, opts: SplitOptions) -> tuple[np.ndarray, np.ndarray, list]:
    """Follows pieces from each entry offset while they begin within the first ``size`` characters.

    ``text`` is the range with its halo; ``final`` says that the text ends with it. Returns where the first piece
    beyond begins (relative to the range; -1 if the text ended), the number of pieces, and the pieces of the first entry.
    """
    ends = cut_after(text, opts)
    n = len(text)
    at, count = entries.astype(np.int64).copy(), np.zeros(len(entries), np.int64)
    pieces: list[tuple[int, int]] = []
    while True:
        go = (at >= 0) & (at < size)
        if not go.any():
            return at, count, pieces
        s = at[go]
        stop = np.where(s < len(ends), ends[np.minimum(s, max(0, len(ends) - 1))] if len(ends) else n, n)
        if go[0]:
            pieces.append((int(at[0]), int(stop[0])))
        count[go] += 1
        at[go] = np.where((stop >= n) & final & (n - s <= opts.limit), -1, stop - opts.overlap)


# -- a table of texts ---------------------------------------------------------------------------------------------------
_RANGE = "key string, range_no long, start long, size long, final boolean, body string"


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RANGE.split(", ")]
    )


def text_ranges(df: DataFrame, key: str, text: str, opts: SplitOptions) -> DataFrame:
    """Ranges of the texts above the limit: (key, range_no, start, size, final, body with halo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r, lo in enumerate(range(0, len(t), opts.range_chars)):
                    hi = min(len(t), lo + opts.range_chars)
                    stop = min(len(t), hi + opts.limit + 1)
                    rows.append((k, r, lo, hi - lo, stop == len(t), t[lo:stop]))
                    held += stop - lo
                    if held > 8_000_000:
                        yield _range_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _range_batch(rows)

    long = df.where(F.length(text) > opts.limit).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return long.mapInArrow(run, _RANGE)


def file_ranges(spark: SparkSession, paths: list[str], opts: SplitOptions, range_bytes: int = 1 << 24) -> DataFrame:
    """Ranges of giant UTF-8 files (``key`` is the path), each read once, by byte offset, and written to the shared folder.

    A range owns the characters whose first byte lies in it; bytes that continue a character belong to the range before.
    ``range_bytes`` must exceed four times the limit. Empty files have no ranges. Starts are left to the stitching.
    """
    if range_bytes <= 4 * (opts.limit + 2):
        raise ValueError("range_bytes must exceed four times the limit")
    uri = lambda path: path if "://" in path else "file://" + path.removeprefix("file:")

    def size_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(uri(path))
                sizes.append(system.get_file_info(inner).size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "total"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, total, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = r * range_bytes, min(total, (r + 1) * range_bytes)
                system, inner = fs.FileSystem.from_uri(uri(path))
                with system.open_input_file(inner) as f:
                    raw = f.read_at(min(total, hi + 4 * (opts.limit + 2)) - lo, lo)
                skip = 0
                while r and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
                    skip += 1
                own = hi - lo
                while own < len(raw) and raw[own] & 0xC0 == 0x80:
                    own += 1
                mine = raw[skip:own].decode("utf-8", "replace")
                halo = raw[own:].decode("utf-8", "ignore")[: opts.limit + 1]
                final = lo + own + len(halo.encode()) >= total
                yield _range_batch([(path, r, -1, len(mine), final, mine + halo)])

    files = spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(size_of, "path string, total long").where("total > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / range_bytes)))
    wanted = files.select("path", "total", number.alias("range_no")).repartition(shuffle_width(files), "path", "range_no")
    return stored(wanted.mapInArrow(read, _RANGE), "ranges")


PIECE = "key string, piece_no long, start_idx long, end_idx long"


def pieces(ranges: DataFrame, opts: SplitOptions, width: int = 64) -> DataFrame:
    """(key, piece_no, start_idx, end_idx) of the texts whose ranges are given."""
    alone = (F.col("range_no") == 0) & F.col("final") & (F.col("size") == F.length("body"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, starts, ends = [], [], [], []
            for k, start, size, final, body, entry, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = walk(body, final, size, np.array([entry]), opts)[2]
                keys += [k] * len(found)
                numbers += range(first, first + len(found))
                starts += [start + a for a, _ in found]
                ends += [start + b for _, b in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array(v, pa.int64()) for v in (numbers, starts, ends))],
                names=["key", "piece_no", "start_idx", "end_idx"],
            )

    columns = ["key", "start", "size", "final", "body"]
    zero = F.lit(0).cast("long")
    single = ranges.where(alone).withColumn("start", zero).select(*columns, zero.alias("entry"), zero.alias("first"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.arange(opts.limit)
        for batch in batches:
            out = []
            for size, final, body in zip(*(c.to_pylist() for c in batch.columns[2:5]), strict=True):
                inside = entries[entries < max(1, size)]
                exit_, count, _ = walk(body, final, size, inside, opts)
                table = np.full((2, opts.limit), -1, np.int64)
                table[0, : len(inside)] = np.where(exit_ >= 0, exit_ - size, -1)
                table[1, : len(inside)] = count
                table[0, len(inside) :] = entries[len(inside) :] - size  # a piece that begins beyond a short range
                table[1, len(inside) :] = 0
                out.append(table.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["key", "range_no", "size", "table"])

    several = ranges.where(~alone)
    made = several.select("key", "range_no", "size", "final", "body").mapInArrow(tables, "key string, range_no long, size long, table binary")
    entered = stitched(stored(made, "tables"), opts, width)
    joined = several.drop("start").join(entered, ["key", "range_no"]).select(*columns, "entry", "first")
    return single.mapInArrow(emit, PIECE).unionByName(joined.mapInArrow(emit, PIECE))


def _composed(blobs: list[bytes], limit: int) -> bytes:
    """The table of several ranges in a row."""
    at, count = np.arange(limit), np.zeros(limit, np.int64)
    for blob in blobs:
        table = np.frombuffer(blob, np.int64).reshape(2, limit)
        on = at >= 0
        count[on] += table[1, at[on]]
        at[on] = table[0, at[on]]
    return np.stack([at, count]).tobytes()


def stitched(made: DataFrame, opts: SplitOptions, width: int = 64) -> DataFrame:
    """(key, range_no, entry, first, start) of every range that a piece begins in: where the first one begins, its number, and the
    place of the range in its text. ``made`` has (key, range_no, size, table)."""
    levels = [made]
    last = made.agg(F.max("range_no")).first()[0]
    if last is None:
        return made.sparkSession.createDataFrame([], "key string, range_no long, entry long, first long, start long")

    def compose(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_no")
        return pd.DataFrame({"key": [group[0]], "range_no": [group[1]], "size": [int(pdf["size"].sum())], "table": [_composed(pdf["table"].tolist(), opts.limit)]})

    while last >= width:
        up = levels[-1].withColumn("_g", F.floor(F.col("range_no") / width)).groupBy("key", "_g").applyInPandas(compose, "key string, range_no long, size long, table binary")
        levels.append(stored(up, "tables"))
        last //= width

    def walk_run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_no")
        at, first, start, rows = int(pdf["entry"].iat[0]), int(pdf["first"].iat[0]), int(pdf["start"].iat[0]), []
        for number, size, blob in zip(pdf["range_no"].tolist(), pdf["size"].tolist(), pdf["table"].tolist(), strict=True):
            if at < 0:
                break
            table = np.frombuffer(blob, np.int64).reshape(2, opts.limit)
            rows.append((group[0], number, at, first, start))
            at, first, start = int(table[0, at]), first + int(table[1, at]), start + size
        return pd.DataFrame(rows, columns=["key", "range_no", "entry", "first", "start"])

    entered = None
    zero = F.lit(0).cast("long")
    for level in reversed(levels):
        run = level.withColumn("_g", F.floor(F.col("range_no") / width))
        if entered is None:
            run = run.withColumns({"entry": zero, "first": zero, "start": zero})
        else:
            run = run.join(entered.withColumnRenamed("range_no", "_g"), ["key", "_g"])
        entered = run.groupBy("key", "_g").applyInPandas(walk_run, "key string, range_no long, entry long, first long, start long")
    return entered


def split_files(spark: SparkSession, paths: list[str], opts: SplitOptions = SplitOptions(), range_bytes: int = 1 << 24) -> DataFrame:
    """Pieces of giant UTF-8 files: (key, piece_no, start_idx, end_idx), key the path. No task reads more than a range."""
    return pieces(file_ranges(spark, paths, opts, range_bytes), opts)


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", opts: SplitOptions = SplitOptions()) -> DataFrame:
    """Pieces of the texts above the limit."""
    return pieces(text_ranges(df, key, text, opts), opts)


# -- checking stored pieces ---------------------------------------------------------------------------------------------------
def _in_range(column: str, first: Column, length: Column) -> Column:
    """Characters of a range text from a 0-based offset; offsets before it are cut off."""
    lo = F.greatest(first, F.lit(0))
    return F.substring(F.col(column), (lo + 1).cast("int"), F.greatest(length - (lo - first), F.lit(0)).cast("int"))


def document_ranges(documents: DataFrame, range_chars: int, halo_left: int, halo_right: int) -> DataFrame:
    """(ext_id, range_no, chars, range_start, body, marks): ranges of the documents, ``body`` with a halo on both sides and
    ``marks`` its boundary table, a letter a character: w in a word or number, b white space or a terminator, o other.

    Of several rows with one ``ext_id`` the first received counts (ties: smallest doc_id).
    """
    docs = documents.where("ext_id IS NOT NULL AND text IS NOT NULL")
    again = docs.groupBy("ext_id").agg(F.min(F.struct("received_at", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = docs.select("ext_id", "doc_id", "received_at").join(again, "ext_id").where(
        F.struct("received_at", "doc_id") != F.col("first")
    ).select("doc_id")
    few = later.count() <= 500_000
    kept = docs.join(F.broadcast(later) if few else later, "doc_id", "left_anti").select("ext_id", "text", F.length("text").alias("chars"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r, lo in enumerate(range(0, max(1, len(t)), range_chars)):
                    start = max(0, lo - halo_left)
                    rows.append((k, r, len(t), start, t[start : lo + range_chars + halo_right]))
                    held += len(rows[-1][4])
                    if held > 8_000_000:
                        yield marked(rows)
                        rows, held = [], 0
            if rows:
                yield marked(rows)

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        ids, numbers, chars, starts, bodies = zip(*rows, strict=True)
        kind = _classes(_points("".join(bodies)))
        # a letter or number, a place where a piece could end, or neither
        marks = np.where(kind & 5, ord("b"), np.where(kind & 8, ord("w"), ord("o"))).astype(np.uint8).tobytes().decode("ascii")
        ends = np.cumsum([len(x) for x in bodies]).tolist()
        own = [marks[e - len(x) : e] for x, e in zip(bodies, ends, strict=True)]
        columns = [pa.array(ids, pa.string()), *(pa.array(v, pa.int64()) for v in (numbers, chars, starts)), pa.array(bodies, pa.string()), pa.array(own, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["ext_id", "range_no", "chars", "range_start", "body", "marks"])

    return kept.select("ext_id", "text").mapInArrow(cut_up, "ext_id string, range_no long, chars long, range_start long, body string, marks string")


def faulty_chunks(documents: DataFrame, chunks: DataFrame, opts: SplitOptions = SplitOptions(), range_chars: int = 4096, block: int = 1 << 20) -> DataFrame:
    """(chunk_id, reason) of stored chunks that aren't pieces of their document as the operator would cut them.

    Only offsets and a hash of the text travel with a chunk; they meet the range of the document in which the chunk begins, so
    neither a giant document nor one with very many chunks gathers in a task. Repeated rows of a chunk_id count once
    (the first created). Chunks of ids that aren't in ``documents`` are no cases. Null offsets or text are faults.
    """
    hashed = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(5), c).alias("b"))
    once = (
        chunks.where("chunk_id IS NOT NULL AND doc_id IS NOT NULL")
        .select("chunk_id", F.struct("created_at", "doc_id", "start_idx", "end_idx", hashed(F.col("text")).alias("h")).alias("r"))
        .groupBy("chunk_id").agg(F.min("r").alias("r"))
        .select("chunk_id", "r.doc_id", "r.start_idx", "r.end_idx", "r.h")
    )
    own = once.withColumn("_b", F.floor(F.coalesce("start_idx", F.lit(0)) / block))
    order = ["start_idx", "end_idx", "chunk_id"]
    w = Window.partitionBy("doc_id", "_b").orderBy(*order)
    placed = own.select(
        "*", F.lag("end_idx").over(w).alias("prev_end"), F.row_number().over(w).alias("_n"), F.lead("chunk_id").over(w).isNull().alias("is_last")
    ).withColumn("is_first", F.col("_n") == 1)
    far = chunks.agg(F.max("start_idx"), F.min("start_idx")).first()
    if far[0] is not None and (far[0] >= block or far[1] < 0):
        # several blocks of offsets: the first row of a block follows the last of the block before
        edges = own.groupBy("doc_id", "_b").agg(F.max(F.struct(*order)).alias("last"))
        e = Window.partitionBy("doc_id").orderBy("_b")
        edges = edges.select("doc_id", "_b", F.lag("last.end_idx").over(e).alias("_p"), F.lag("_b").over(e).alias("_pb"), F.lead("_b").over(e).alias("_nb"))
        placed = placed.join(edges, ["doc_id", "_b"]).withColumn("prev_end", F.when(F.col("is_first"), F.col("_p")).otherwise(F.col("prev_end"))).withColumn(
            "is_first", F.col("is_first") & F.col("_pb").isNull()
        ).withColumn("is_last", F.col("is_last") & F.col("_nb").isNull())
    ranges = document_ranges(documents, range_chars, opts.reach, opts.limit + 1)
    # a chunk that begins outside its document meets the first range
    lengths = F.floor(F.greatest(F.coalesce("start_idx", F.lit(0)), F.lit(0)) / range_chars)
    known = documents.where("ext_id IS NOT NULL AND text IS NOT NULL").groupBy("ext_id").agg(F.max(F.length("text")).alias("_longest"))
    candidates = placed.join(known, F.col("doc_id") == F.col("ext_id")).drop("ext_id").withColumn(
        "range_no", F.when(F.col("start_idx") < F.col("_longest"), lengths).otherwise(F.lit(0)).cast("long")
    )
    met = candidates.join(
        ranges.withColumnRenamed("ext_id", "doc_id"), ["doc_id", "range_no"], "left"
    )
    s, e_, r = F.col("start_idx"), F.col("end_idx"), F.col("range_start")
    own_text = F.btrim(_in_range("body", s - r, e_ - s), F.lit(WHITESPACE))
    cut_word = _in_range("marks", e_ - 1 - r, F.lit(2)) == "ww"
    could = _in_range("marks", e_ - opts.reach - r, F.lit(opts.reach)).contains("b")
    reason = (
        F.when(s.isNull() | e_.isNull(), "no offsets")
        .when(e_ - s > opts.limit, "too long")
        .when(F.col("body").isNull() | (s < 0) | (e_ > F.col("chars")) | (e_ < s), "offsets leave the document")
        .when(F.coalesce(hashed(own_text) != F.col("h"), F.lit(True)), "other text")
        .when(F.col("is_first") & (s != 0), "no start")
        .when(~F.col("is_first") & (s != F.col("prev_end") - opts.overlap), "wrong overlap")
        .when(F.col("is_last") & (e_ != F.col("chars")), "no end")
        .when(~F.col("is_last") & cut_word & could, "cuts a word")
    )
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select("chunk_id", "doc_id", "reason")
