"""Substring deduplication by fixed-block anchors.

A window is ``window`` consecutive words of one text. Every word that lies in a window
whose word sequence also starts earlier (smaller doc_id, or the same doc_id and an
earlier start) is removed; windows are judged on the input.

Method. With blocks of ``window // 2`` words, every occurrence of a window holds one
whole block of the grid 0, b, 2b, ... of its own text. So the grid blocks are the
index, and every rolling window of b words probes it: if a sequence of ``window`` words
occurs twice, each occurrence has a probe that hits a grid block of the other. Hits are
then extended: neighbouring window starts around a hit are compared on 128-bit hashes of their
words, and runs of them are the maximal exact repeats.

Work is dealt twice. Texts are dealt to *batches* by a hash of the row, and stay there;
hashes are dealt from the batches to *parts* by value. A batch sends each distinct hash
once, so a passage that a third of all texts share costs one entry for each batch, not
one for each occurrence, and a part answers with one bit for each entry. Batches and parts
grow with the square root of the input once it is large (``sizes``), so that a message never holds less than
some ``MESSAGE`` entries, whatever the input. A batch is recomputed from its own rows alone, so a
lost executor changes nothing. Rows of equal id and text are judged once and their answer is joined back to
each of them, so no batch gathers the repeats of a row.

Defined cases: a null or empty text has no words and loses none; a null doc_id sorts
after all others; equal rows (same doc_id and start) are not earlier than each other,
so both keep what one of them would keep; an empty table gives an empty table; columns
besides doc_id and text pass through, except that ``kept``, ``n_words``, ``n_removed``
and ``removed`` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sentiscope.llm import common
from sentiscope.llm import words as K
from sentiscope.llm.common import partitions, text_bytes
from sentiscope.session import scratch_path

WINDOW = 20
#: Rolling windows that one part compares, about, at six bytes a word.
PART_BYTES = 12 << 20
#: Entries of a message that batches and parts of a large input are sized for.
MESSAGE = 64
NULL_ID = np.iinfo(np.int64).max

_SENT = "kind int, part long, batch long, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("batch", pa.int64()),
                    *((c, pa.binary()) for c in "abcd")])
PROBE, STARTS, WINDOWS = 0, 1, 2


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array by significance, so that the sorted and the empty ones compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)],
                                schema=_ARROW)


def _grouped(hashes: np.ndarray, parts: int):
    """(order, starts, distinct, part of each distinct): hashes sorted by part, then value."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((hashes, part))
    ordered = hashes[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    return order, starts, ordered[starts], part[order][starts]


def _by_part(part: np.ndarray):
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    return zip(part[edges], edges, np.append(edges[1:], len(part)))


class _Batch:
    """The words of one batch, and what of them the parts get to see."""

    def __init__(self, rows: pa.Table, window: int, parts: int):
        self.window, self.block, self.parts = window, window // 2, parts
        # a batch is read three times; its rows come in any order, and places in it must not change
        order = pa.compute.sort_indices(rows.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows = rows.take(order)
        first, words, self.cuts = [0], [], []
        for piece in K.pieces(rows.combine_chunks(), "text") if rows.num_rows else ():
            f, starts, ends, h, _ = K.words(piece.column("text"))
            words.append(h)
            self.cuts.append((piece, f, starts, ends))
            first.extend(f[1:] + first[-1])
        self.first = np.array(first, dtype=np.int64)
        self.hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)

    def probes(self):
        at = K.inside(self.first, len(self.hashes), self.block)
        h = K.windows(self.hashes, self.block)[at]
        grid = (at - self.first[np.searchsorted(self.first, at, side="right") - 1]) % self.block == 0
        return at, grid, _grouped(h, self.parts)

    def starts_near(self, hit: np.ndarray) -> np.ndarray:
        """Window starts that have a hit probe inside."""
        n = len(self.hashes)
        total = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(np.bincount(hit, minlength=n), out=total[1:])
        at = K.inside(self.first, n, self.window)
        return at[total[at + self.window - self.block + 1] > total[at]]

    def windows(self, at: np.ndarray):
        """Both halves of the hashes of the windows at these starts, with part, doc_id and start of each, sorted."""
        with np.errstate(over="ignore"):
            h, g = np.zeros((2, len(at)), np.uint64)
            for k, (c, d) in enumerate(zip(K.constants(self.window, 4000), K.constants(self.window, 5000))):
                word = self.hashes[at + k]
                h += word * c
                g += K.mix(word) * d
        row = np.searchsorted(self.first, at, side="right") - 1
        ids = self.rows.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()
        place = (at - self.first[row]).astype(np.uint32)
        h = K.mix(h)
        part = (h % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((place, ids[row], g, h, part))
        return h[order], g[order], part[order], ids[row][order], place[order], at[order]


def _heads(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])) if len(h) else np.zeros(0, bool)


def _send_probes(window: int, parts: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        batch = _Batch(rows, window, parts)
        _, grid, (order, starts, distinct, part) = batch.probes()
        count = np.diff(np.append(starts, len(order)))
        anchor = np.logical_or.reduceat(grid[order], starts) if len(starts) else grid
        low = (distinct >> np.uint64(32)).astype(np.uint32)
        return _rows([(PROBE, p, key[0].as_py(), _planes(low[i:j]), np.packbits(anchor[i:j]).tobytes(),
                       np.packbits(count[i:j] > 1).tobytes(), None) for p, i, j in _by_part(part)])
    return send


def _match_probes(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each batch's entries: does the hash occur twice or more, and on a grid?"""
    cols = rows.to_pydict()
    low = [_unplanes(a, np.uint32) for a in cols["a"]]
    size = [len(x) for x in low]
    value = np.concatenate(low)
    anchor = np.concatenate([_bits(x, n) for x, n in zip(cols["b"], size)])
    often = np.concatenate([_bits(x, n) for x, n in zip(cols["c"], size)])
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(starts, len(order)))
    good = ((count > 1) | np.logical_or.reduceat(often[order], starts)) & np.logical_or.reduceat(anchor[order], starts)
    hit = np.empty(len(order), bool)
    hit[order] = np.repeat(good, count)
    cut = np.cumsum(size)[:-1]
    return _rows([(PROBE, p, b, np.packbits(x).tobytes(), None, None, None)
                  for p, b, x in zip(cols["part"], cols["batch"], np.split(hit, cut))])


def _answers(rows: pa.Table, kind: int) -> dict[int, bytes]:
    keep = rows.filter(pa.compute.equal(rows.column("kind"), kind))
    return dict(zip(keep.column("part").to_pylist(), keep.column("a").to_pylist()))


def _marked(part: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    marks = np.zeros(len(part), bool)
    for p, i, j in _by_part(part):
        marks[i:j] = _bits(answers[int(p)], j - i)
    return marks


def _send_windows(window: int, parts: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows([])
        batch = _Batch(rows, window, parts)
        at, _, (order, starts, distinct, part) = batch.probes()
        hit = np.repeat(_marked(part, _answers(answers, PROBE)), np.diff(np.append(starts, len(order))))
        near = batch.starts_near(at[order[hit]])
        mask = np.zeros(len(batch.hashes), bool)
        mask[near] = True
        number = key[0].as_py()
        # the starts go to the batch itself, under a part number of its own
        out = [(STARTS, -1 - number, number, np.packbits(mask).tobytes(), None, None, None)]
        h, g, part, ids, place, _ = batch.windows(near)
        one = np.flatnonzero(_heads(h, g))
        for p, i, j in _by_part(part[one]):
            k = one[i:j]  # the earliest of each sequence in this batch
            out.append((WINDOWS, p, number, _planes(h[k]), _planes(ids[k]), _planes(place[k]), _planes(g[k])))
        return _rows(out)
    return send


def _match_windows(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each batch's sequences: does one start earlier in another batch?"""
    cols = rows.to_pydict()
    if cols["kind"][0] == STARTS:
        return rows.cast(_ARROW)
    h = [_unplanes(x, np.uint64) for x in cols["a"]]
    size = [len(x) for x in h]
    h = np.concatenate(h)
    g = np.concatenate([_unplanes(x, np.uint64) for x in cols["d"]])
    ids = np.concatenate([_unplanes(x, np.int64) for x in cols["b"]])
    place = np.concatenate([_unplanes(x, np.uint32) for x in cols["c"]])
    order = np.lexsort((place, ids, g, h))
    starts = np.flatnonzero(_heads(h[order], g[order]))
    least = order[np.repeat(starts, np.diff(np.append(starts, len(order))))]
    late = np.empty(len(order), bool)
    late[order] = (ids[least] != ids[order]) | (place[least] != place[order])
    return _rows([(WINDOWS, p, b, np.packbits(x).tobytes(), None, None, None)
                  for p, b, x in zip(cols["part"], cols["batch"], np.split(late, np.cumsum(size)[:-1]))])


def _remove(window: int, parts: int, schema: pa.Schema, layout: bool):
    def remove(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        batch = _Batch(rows, window, parts)
        n = len(batch.hashes)
        mask = _bits(next(iter(_answers(answers, STARTS).values())), n)
        h, g, part, ids, place, at = batch.windows(np.flatnonzero(mask))
        cover = np.zeros(n + 1, np.int32)
        if len(h):
            starts = np.flatnonzero(_heads(h, g))
            count = np.diff(np.append(starts, len(h)))
            first = np.repeat(starts, count)
            late = np.repeat(_marked(part[starts], _answers(answers, WINDOWS)), count)
            late |= (ids != ids[first]) | (place != place[first])
            np.add.at(cover, at[late], 1)
            np.add.at(cover, at[late] + window, -1)
        gone = np.cumsum(cover[:n]) > 0
        out, done = [], 0
        for piece, f, starts, ends in batch.cuts:
            mine = gone[done:done + len(starts)]
            done += len(starts)
            out.append(_cut(piece, f, starts, ends, mine, layout, schema))
        return pa.concat_tables(out)
    return remove


def _strings(data: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(keep))[offsets]
    kept = data[keep]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.string())


def _cut(piece: pa.Table, first, starts, ends, gone, layout, schema) -> pa.Table:
    offsets, data = K.flat(piece.column("text"))
    rows = len(offsets) - 1
    n_words = np.diff(first)
    n_gone = np.diff(np.append(0, np.cumsum(gone))[first])
    step = np.zeros(len(data) + 1, np.int8)
    if layout:  # a removed word goes with what separates it from the next
        row_end = offsets[np.repeat(np.arange(rows), n_words) + 1]
        until = np.minimum(np.append(starts[1:], len(data)), row_end) if len(starts) else ends
        step[starts[gone]] += 1
        np.add.at(step, until[gone], -1)
        keep = np.cumsum(step[:-1]) == 0
        text = _strings(data, keep, offsets)
        nulls = pa.compute.is_null(piece.column("text"))
        if isinstance(nulls, pa.ChunkedArray):
            nulls = nulls.combine_chunks()
        text = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), text)
    else:  # the words that stay, with one space between
        stay = np.flatnonzero(~gone)
        row = np.repeat(np.arange(rows), n_words)[stay]
        step[starts[stay]] += 1
        np.add.at(step, ends[stay], -1)
        keep = np.cumsum(step[:-1], dtype=np.int32) > 0
        joint = ends[stay][:-1][row[1:] == row[:-1]] if len(stay) else stay
        data = data.copy()
        data[joint] = 0x20
        keep[joint] = True
        text = _strings(data, keep, offsets)
    row = np.repeat(np.arange(rows), n_words)
    head = gone & ~(np.append(False, gone[:-1]) & np.append(False, row[1:] == row[:-1])) if len(gone) else gone
    tail = gone & ~(np.append(gone[1:], False) & np.append(row[1:] == row[:-1], False)) if len(gone) else gone
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    spans = pa.StructArray.from_arrays([pa.array((a - first[row[a]]).astype(np.int32)),
                                        pa.array((b - first[row[b]] + 1).astype(np.int32))], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[a], np.arange(rows + 1)).astype(np.int32)), spans)
    made = {"kept": text, "n_words": pa.array(n_words.astype(np.int64)),
            "n_removed": pa.array(n_gone.astype(np.int64)), "removed": lists}
    return pa.Table.from_arrays([made[f.name] if f.name in made else piece.column(f.name).cast(f.type)
                                 for f in schema], schema=schema)


def sizes(total: int, least: int) -> tuple[int, int]:
    """(batches, parts) for texts of so many bytes. A batch holds ``UNIT_BYTES``, or more if its entries, dealt to all
    parts, would come to less than ``MESSAGE`` a part; a part compares what three batches hold."""
    batch = max(common.UNIT_BYTES, math.isqrt(2 * MESSAGE * total))
    return max(least, math.ceil(total / batch)), max(least, math.ceil(total / max(PART_BYTES, 3 * batch)))


def _judged(docs: DataFrame, window: int, layout: bool) -> DataFrame:
    """``rest``, ``kept``, ``n_words``, ``n_removed`` and ``removed`` for the rows (``rest doc_id text``) of ``docs``, no two of
    which have the same id and text."""
    batches, parts = sizes(text_bytes(docs), partitions(docs.sparkSession))
    dealt = (docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), "doc_id", "text", "rest")
             .repartition(partitions(docs.sparkSession), "batch"))
    slim = dealt.select("batch", "doc_id", "text")
    hits = (slim.groupBy("batch").applyInArrow(_send_probes(window, parts), _SENT)
            .groupBy("part").applyInArrow(_match_probes, _SENT))
    late = (slim.groupBy("batch").cogroup(hits.groupBy("batch"))
            .applyInArrow(_send_windows(window, parts), _SENT)
            .groupBy("part").applyInArrow(_match_windows, _SENT))
    schema = T.StructType([f for f in dealt.schema if f.name in ("doc_id", "rest")])
    for name, kind in zip(_MADE, _KINDS):
        schema = schema.add(name, kind)
    return (dealt.groupBy("batch").cogroup(late.groupBy("batch"))
            .applyInArrow(_remove(window, parts, to_arrow_schema(schema), layout), schema))


_MADE = ("kept", "n_words", "n_removed", "removed")
_KINDS = (T.StringType(), T.LongType(), T.LongType(),
          T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


def _relaxed(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, so that rows of different making have one type."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_relaxed(kind.elementType))
    return T.MapType(kind.keyType, _relaxed(kind.valueType)) if isinstance(kind, T.MapType) else kind


def remove_repeats(docs: DataFrame, window: int = WINDOW, layout: bool = False) -> DataFrame:
    """The columns of ``docs`` but for its text, and ``kept`` (the words that stay, joined by one space; with
    ``layout``, the text as it was without the removed words), ``n_words``, ``n_removed``
    and ``removed``: the maximal runs of removed words as [start, end) word positions."""
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of four words or more")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text", *_MADE)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    rows = docs.select("doc_id", "text", rest.alias("rest"))
    rows = rows.withColumn("rest", F.col("rest").cast(_relaxed(rows.schema["rest"].dataType)))
    key = F.xxhash64("text")
    path = scratch_path(spark, "repeated-rows")
    rows.groupBy("doc_id", key.alias("h")).count().where("count > 1").select(F.col("doc_id").alias("of"), "h").write.parquet(path)
    repeated = spark.read.parquet(path)
    if repeated.isEmpty():
        out = _judged(rows, window, layout)
    else:
        same = rows.doc_id.eqNullSafe(repeated.of) & (key == repeated.h)
        many = rows.join(repeated, same)
        one = many.groupBy("of", "h").agg(F.first("text").alias("text"))
        named = F.struct(F.lit(True).alias("single"), "rest", F.lit(None).cast("long").alias("h"))
        again = F.struct(F.lit(False).alias("single"), F.lit(None).cast(rows.schema["rest"].dataType).alias("rest"), "h")
        tagged = T.StructType([T.StructField("single", T.BooleanType()), T.StructField("rest", rows.schema["rest"].dataType), T.StructField("h", T.LongType())])
        judged = _judged(rows.join(repeated, same, "left_anti").select("doc_id", "text", named.cast(tagged).alias("rest"))
                         .unionByName(one.select(F.col("of").alias("doc_id"), "text", again.cast(tagged).alias("rest"))), window, layout)
        path = scratch_path(spark, "judged-rows")
        judged.write.parquet(path)
        judged = spark.read.parquet(path)
        answer = judged.where("not rest.single").select(F.col("doc_id").alias("id"), F.col("rest.h").alias("of_h"), *_MADE)
        back = many.select("doc_id", "h", "rest").join(answer, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("of_h")))
        out = (judged.where("rest.single").select("doc_id", F.col("rest.rest").alias("rest"), *_MADE)
               .unionByName(back.select("doc_id", "rest", *_MADE)))
    kept = [F.col(f"rest.`{c}`").alias(c) if c in others else F.col(f"`{c}`")
            for c in docs.columns if c not in (*_MADE, "text")]
    return out.select(*kept, *_MADE)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 20-word window seen earlier, removed."""
    from sentiscope.llm.common import table
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
