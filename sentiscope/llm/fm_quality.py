"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]):
every pair of features interacts through vectors of ``RANK`` numbers, in time linear
in the number of features (the sum-of-squares identity).

Features of a text are its words (bytes, hashed to ``BUCKETS`` weights of tf / norm) and
``STATS``: shares of word-like, upper-case, digit, symbol and line-break bytes, word and
line lengths, and how much of its words and word pairs repeat, each as a few soft
indicators; its length stands for the metadata. Nothing else is an input: not labels,
lang, source or doc_id.

Fitting takes at most ``SAMPLE`` labelled rows, those with the smallest hash of the id
(a documented bound), in one task; the model is ``BUCKETS * (RANK + 1)`` floats whatever
the input. Scoring is one pass over all texts without a shuffle.

Defined cases: an empty or null text has no word features and is scored by its structure
(zeros); a label other than 0 and 1 or null is not learned from; repeated label rows of
a document count once, by the largest label; without rows to learn from every score is
0.5; columns ``score`` and ``predicted`` are replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm import words as K
from sentiscope.llm.common import fold, table

BUCKETS = 1 << 14
RANK = 8
SAMPLE = 6000
EPOCHS = 12
RATE = 0.05
PENALTY = 1e-5
SEED = 7
#: Soft indicator positions of each structure statistic, on its own scale of 0 to 1.
KNOTS = np.linspace(0.0, 1.0, 9)
STATS = ("letters", "upper", "digits", "symbols", "breaks", "word_length", "line_length",
         "same_as_before", "distinct", "pairs_repeated", "length")
N_FEATURES = BUCKETS + len(STATS) * len(KNOTS)

_KIND = np.zeros(256, np.uint8)  # letters 1, upper 2, digits 3, symbols 4, line break 5
_KIND[128:] = 1
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = 4
_KIND[10] = 5


def _share(flags: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(of, 1)


def _distinct(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row as (row, value, count)."""
    order = np.lexsort((values, row))
    r, v = row[order], values[order]
    head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))) if len(r) else np.zeros(0, np.int64)
    return r[head], v[head], np.diff(np.append(head, len(r)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value): the sparse features of text ``i`` are ``first[i]`` to ``first[i + 1]``."""
    offsets, data = K.flat(texts)
    first, starts, ends, h, _ = K.words(texts)
    rows = len(first) - 1
    n, size = np.diff(first), np.diff(offsets)
    row = np.repeat(np.arange(rows), n)
    kind = _KIND[data]
    letters = _share((kind == 1) | (kind == 2), offsets, size)
    upper = _share(kind == 2, offsets, size)
    digits = _share(kind == 3, offsets, size)
    symbols = _share(kind == 4, offsets, size)
    breaks = _share(kind == 5, offsets, size)
    word = _share(ends - starts, first, n)
    line = size / (1 + _share(kind == 5, offsets, np.ones(rows)))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    r, v, c = _distinct(row, h, rows)
    distinct = np.bincount(r, minlength=rows) / np.maximum(n, 1)
    at = K.inside(first, len(h), 2)
    pr, _, pc = _distinct(row[at], K.windows(h, 2)[at] if len(at) else h[:0], rows)
    pairs = 1 - np.bincount(pr, minlength=rows) / np.maximum(np.bincount(pr, pc, minlength=rows), 1)
    stats = np.stack([letters, np.sqrt(upper), np.sqrt(digits), np.sqrt(symbols), np.sqrt(breaks) * 2, word / 16,
                      np.log1p(line) / 10, np.sqrt(_share(same, first, n)), distinct, pairs, np.log1p(size) / 14], 1)
    stats = np.where(size[:, None] > 0, np.clip(stats, 0, 1), 0)
    soft = np.maximum(0, 1 - np.abs(stats[:, :, None] - KNOTS) / (KNOTS[1] - KNOTS[0]))
    bucket = (v % np.uint64(BUCKETS)).astype(np.int64)
    weight = np.log1p(c)
    norm = np.sqrt(np.bincount(r, weight ** 2, minlength=rows))
    weight = weight / np.maximum(norm, 1e-9)[r]
    sr, si = np.nonzero(soft.reshape(rows, -1))
    all_row = np.concatenate([r, sr])
    index = np.concatenate([bucket, BUCKETS + si])
    value = np.concatenate([weight, soft.reshape(rows, -1)[sr, si]])
    order = np.argsort(all_row, kind="stable")
    return (np.searchsorted(all_row[order], np.arange(rows + 1)), index[order].astype(np.int32),
            value[order].astype(np.float32))


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def parts(self, first, index, value):
        rows = len(first) - 1
        has = np.diff(first) > 0
        at = first[:-1][has]

        def total(x):
            out = np.zeros((rows, *x.shape[1:]), np.float32)
            if len(at):
                out[has] = np.add.reduceat(x, at, axis=0)
            return out

        vx = self.vectors[index] * value[:, None]
        s = total(vx)
        pairs = 0.5 * ((s ** 2).sum(1) - total((vx ** 2).sum(1)))
        return self.bias + total(self.weights[index] * value) + pairs, s

    def scores(self, first, index, value) -> np.ndarray:
        z, _ = self.parts(first, index, value)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Logistic loss, Adagrad on mini-batches; both classes weigh the same."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.05, (N_FEATURES, RANK)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        return Machine(0.0, m.weights, np.zeros_like(m.vectors))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    seen_w, seen_v, seen_b = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            size = first[rows + 1] - first[rows]
            f = np.append(0, np.cumsum(size))
            take = np.arange(f[-1]) - np.repeat(f[:-1], size) + np.repeat(first[rows], size)
            i, x = index[take], value[take]
            z, s = m.parts(f, i, x)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * balance[rows] / len(rows)
            seen_b += float(g.sum()) ** 2
            m.bias -= RATE * float(g.sum()) / np.sqrt(seen_b)
            gx = np.repeat(g, size) * x
            gv = gx[:, None] * (np.repeat(s, size, axis=0) - m.vectors[i] * x[:, None])
            order = np.argsort(i, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(i[order]) > 0))
            k = i[order][head]
            gw = np.add.reduceat(gx[order], head) + PENALTY * m.weights[k]
            gv = np.add.reduceat(gv[order], head, axis=0) + PENALTY * m.vectors[k]
            seen_w[k] += gw ** 2
            seen_v[k] += gv ** 2
            m.weights[k] -= (RATE * gw / np.sqrt(seen_w[k])).astype(np.float32)
            m.vectors[k] -= (RATE * gv / np.sqrt(seen_v[k])).astype(np.float32)
    return m


def _described(batches):
    """The features of each text, in place of the text."""
    for batch in batches:
        for piece in K.pieces(batch, most=K.PIECE_BYTES // 2):
            first, index, value = features(piece.column("text"))
            offsets = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                piece.column("rank"), piece.column("label"), pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))], names=["rank", "label", "index", "value"])


def _fit_rows(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("rank").combine_chunks()
    index, value = (rows.column(c).combine_chunks() for c in ("index", "value"))
    first = np.append(0, np.cumsum(pa.compute.list_value_length(index).to_numpy(zero_copy_only=False))).astype(np.int64)
    m = fit(first, index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), rows.column("label").to_numpy())
    flat = np.concatenate([[m.bias], m.weights, m.vectors.ravel()]).astype(np.float32)
    return pa.table({"model": pa.array([flat.tobytes()], pa.binary())})


#: Times the sample that is expected to pass the first cut.
CUT = 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` of the documents that have a 0/1 label, the smallest by a hash of the id.

    Ids are cut by their hash before they are ranked, so the ranking meets some ``CUT`` times the sample whatever the
    number of labels; what the fitting task gathers are the sampled documents' features, not their texts.
    """
    known = (labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
             .withColumn("rank", F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))))
    # ids only: a document table row is looked up first, so that the bound counts rows that exist
    real = known.join(docs.select("doc_id").distinct(), "doc_id")
    n = real.count()
    least = -2 ** 63 + (2 ** 64 - 1) * min(1.0, CUT * sample / max(1, n))  # of the range of a hash
    chosen = real.where(F.col("rank") <= F.lit(min(2 ** 63 - 1, int(least)))).orderBy("rank", "doc_id").limit(sample)
    picked = chosen.select(F.col("doc_id").alias("_id"), "label", "rank")  # at most `sample` rows of 24 bytes
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"), F.first("rank").alias("rank"))
    made = one.select("rank", "label", "text").mapInArrow(_described, "rank long, label double, index array<int>, value array<float>")

    def together(rows: pa.Table) -> pa.Table:
        return _fit_rows(rows)

    row = made.groupBy(F.lit(1).alias("one")).applyInArrow(together, "model binary").first()
    flat = np.frombuffer(row.model, np.float32) if row else np.zeros(1 + N_FEATURES * (RANK + 1), np.float32)
    return Machine(float(flat[0]), flat[1:1 + N_FEATURES], flat[1 + N_FEATURES:].reshape(N_FEATURES, RANK))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def run(batches):
        m = shared.value
        for batch in batches:
            for piece in K.pieces(batch, most=K.PIECE_BYTES // 2):
                p = m.scores(*features(piece.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=[*piece.schema.names, "score", "predicted"])

    from pyspark.sql import types as T
    schema = T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    return labels.where(fold(3) != 1)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")
