"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is
0.8 or more; classes are the connected components of the links. A text of one to four
words has one shingle, itself; a null or empty text has none, is linked to nothing and
is a class of its own.

1. One pass over the texts gives each its set's 128-bit identity, its signature and its band hashes.
   A signature of ``bands * rows`` bins takes each shingle once (one permutation; an
   empty bin borrows from the first occupied bin of a fixed random order). At similarity
   s a pair shares a band with probability 1 - (1 - s**rows)**bands. ``band_counts``
   takes as many bands as the target recall needs at the threshold. Texts with equal sets are one
   *member*.
2. Members that share a band hash meet in its bucket, with one byte of each bin; buckets with the same
   members meet once. A pair is a *candidate* if the sizes of its sets allow the
   threshold and its signatures agree in as many bins as ``agreement`` asks for, which a pair at the threshold
   fails once in some hundred thousand times. Large buckets are dealt to pairs of blocks, and a
   group sends back a spanning forest of its candidates, never pairs. So texts that share a band but not
   their content (a common template) are not joined.
3. Components of candidates are compared on their full sets, in blocks: of a pair of blocks only the candidates
   that share a band, worked out anew from the texts, as products of incidence matrices where they
   are many and one by one where they are few. The tasks send back link
   counts and a spanning forest of the links.

The result has one row per document row: ``doc_id``, ``class_id`` (smallest doc_id of
its class), ``n_links`` (other document rows linked to it, copies included), ``n_texts``
(different sets linked to its own) and ``keep`` (true for one row of each class).

Defined cases: a null or empty text, or one of white space, has no shingles (above); null ids sort last;
repeated rows count as documents of one class, and their text is sent once; of rows with equal id and text
``drop_near_copies`` keeps the smallest by its other columns; an empty table gives an empty one; a very
long text is one set like any other; extra columns are not read, and ``drop_near_copies`` gives
them back whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm import words as K
from sentiscope.llm.common import whole_row
from sentiscope.llm.components import components
from sentiscope.session import scratch_path

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 6
RECALL = 0.9999
BLOCK = 512
#: Standard deviations below the threshold at which signatures still pass.
DEVIATIONS = 4.5
#: Rows of buckets that one call handles, about.
LOT = 4000
#: Share of a pair of blocks that are candidates from which all of it is multiplied.
DENSE = 0.02
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 2048


def band_counts(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` rows that find a pair at the threshold with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the distinct shingles of text ``i`` are ``first[i]`` to ``first[i + 1]``, sorted."""
    first, _, _, h, _ = K.words(texts)
    rows = len(first) - 1
    at = K.inside(first, len(h), width)
    full = K.windows(h, width)[at]
    row = np.searchsorted(first, at, side="right") - 1
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        with np.errstate(over="ignore"):
            one = np.zeros(len(short), np.uint64)
            for k, c in enumerate(K.constants(width - 1, 7000)):
                has = size[short] > k
                one[has] += h[first[short[has]] + k] * c
            one = K.mix(one + size[short].astype(np.uint64))
        row, full = np.append(row, short), np.append(full, one)
    order = np.lexsort((full, row))
    row, full = row[order], full[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (full[1:] != full[:-1])) if len(row) else np.zeros(0, bool)
    return np.searchsorted(row[fresh], np.arange(rows + 1)), full[fresh]


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.uint64)
    has = np.diff(first) > 0
    if has.any():
        out[has] = np.add.reduceat(values, first[:-1][has])
    return out


def signatures(first: np.ndarray, hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of each set, empty bins filled from others; rows without shingles stay empty."""
    rows = len(first) - 1
    none = np.uint64(2 ** 64 - 1)
    out = np.full(rows * bins, none)
    row = np.repeat(np.arange(rows), np.diff(first))
    h = K.mix(hashes)
    cell = row * bins + (h % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((h, cell))
    head = np.append(True, cell[order][1:] != cell[order][:-1]) if len(order) else np.zeros(0, bool)
    out[cell[order][head]] = h[order][head]
    filled = out != none
    todo = np.flatnonzero(~filled & np.repeat(np.diff(first) > 0, bins))
    turn = 0
    while len(todo):
        turn += 1
        donor = (K.mix((todo % bins + turn * bins).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        source = todo - todo % bins + donor
        ok = filled[source]
        out[todo[ok]] = out[source[ok]]
        todo = todo[~ok]
    return out.reshape(rows, bins)


def _bands(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    with np.errstate(over="ignore"):
        cut = signature.reshape(len(signature), bands, rows) * K.constants(rows, 8000)
        return K.mix(cut.sum(axis=2, dtype=np.uint64) + K.constants(bands, 9000))


def agreement(n_a: np.ndarray, n_b: np.ndarray, bins: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The least share of equal bins of a pair at the threshold, for sets of these sizes; small sets fill few bins of their own."""
    spread = np.sqrt(threshold * (1 - threshold) * (1 / bins + 1 / np.maximum(1, np.minimum(n_a, n_b))))
    return threshold - DEVIATIONS * spread


def candidates(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of these rows' pairs the sizes and the signatures (a byte for each bin) allow to be links."""
    a, b = n[left][:, None], n[right][None, :]
    equal = np.zeros((len(left), len(right)), np.int32)
    x, y = sig[left], sig[right]
    for k in range(sig.shape[1]):
        equal += x[:, k, None] == y[None, :, k]
    fits = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6
    return fits & (equal >= agreement(a, b, sig.shape[1], threshold) * sig.shape[1])


def _forest(near: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches in a symmetric matrix of neighbours."""
    label = np.arange(len(near))
    while True:
        best = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _both_ways(part: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    near = np.zeros((size, size), bool)
    near[np.ix_(left, right)] = part
    np.fill_diagonal(near, False)
    return near | near.T


def _meet(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("peer", pa.int64())])

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
        bucket, i, j, block, n, node = (rows.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "n", "node"))
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(n), -1)
        head = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        a, b = [], []
        for at, end in zip(head, np.append(head[1:], len(n))):
            own = slice(at, end)
            left, right = np.flatnonzero(block[own] == i[at]), np.flatnonzero(block[own] == j[at])
            near = _both_ways(candidates(sig[own], n[own], left, right, threshold), left, right, end - at)
            label = _forest(near)
            some = np.flatnonzero(label != np.arange(end - at))
            a.append(node[own][some])
            b.append(node[own][label[some]])
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], schema=schema)
    return meet


def _describe(width: int, bands: int, rows: int):
    def describe(batches):
        for batch in batches:
            for piece in K.pieces(batch, most=K.PIECE_BYTES // 2):
                first, h = shingle_sets(piece.column("text"), width)
                n = np.diff(first)
                with np.errstate(over="ignore"):
                    low, high = (_sum(K.mix(h ^ c), first) for c in K.constants(2, 6000))
                ident = np.ascontiguousarray(np.stack([low, high], 1)).view(np.uint8).ravel()
                sig = signatures(first, h, bands * rows)
                b = _bands(sig, bands)
                length = piece.num_rows
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").cast(pa.int64()), piece.column("th"),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), length, [None, pa.py_buffer(ident)]).cast(pa.binary()),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(length + 1, dtype=np.int32) * bands),
                                             pa.array(b.view(np.int64).ravel())),
                    pa.array([row.tobytes() for row in sig.astype(np.uint8)], pa.binary()),
                ], names=["doc_id", "th", "sid", "n", "bands", "signature"])
    return describe


def _common(first, h, left, right, wanted) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs of sets (0 for the others)."""
    common = np.zeros(wanted.shape, np.float32)
    if wanted.sum() <= DENSE * wanted.size:
        for x, y in zip(*np.nonzero(wanted)):
            a, b = (h[first[r]:first[r + 1]] for r in (left[x], right[y]))
            common[x, y] = np.searchsorted(b, a, side="right").sum() - np.searchsorted(b, a).sum()
        return common
    size = len(first) - 1
    row = np.repeat(np.arange(size), np.diff(first))
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    both = (count > 1)[column]  # a shingle of one row alone is in no intersection
    row, column = row[both], (np.cumsum(count > 1) - 1)[column[both]]
    place, in_left, in_right = np.zeros((2, size), np.int64), np.zeros(size, bool), np.zeros(size, bool)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    in_left[left], in_right[right] = True, True
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, int((count > 1).sum()), COLUMNS):
        cut = slice(*np.searchsorted(column, (c, c + COLUMNS)))
        r, k = row[cut], column[cut] - c
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        a[place[0, r[in_left[r]]], k[in_left[r]]] = 1
        b[place[1, r[in_right[r]]], k[in_right[r]]] = 1
        common += a @ b.T
    return np.where(wanted, common, 0)


def links(first: np.ndarray, h: np.ndarray, block: np.ndarray, i: int, j: int, bands: int, rows: int, threshold: float):
    """(near, compared): the links among sets of block i and block j, and how many pairs their full sets decided."""
    n = np.diff(first)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sig = signatures(first, h, bands * rows)
    keys = _bands(sig, bands)
    wanted = candidates(sig.astype(np.uint8), n, left, right, threshold)
    shared = np.zeros_like(wanted)
    for k in range(bands):
        shared |= keys[left, k][:, None] == keys[right, k][None, :]
    wanted &= shared
    if i == j:
        wanted = np.triu(wanted, 1)
    common = _common(first, h, left, right, wanted)
    link = wanted & (common >= threshold * (n[left][:, None] + n[right][None, :] - common) - 1e-6)
    return _both_ways(link, left, right, len(n)), int(wanted.sum())


def _compare(width: int, bands: int, band_rows: int, threshold: float):
    schema = pa.schema([("sid", pa.string()), ("peer", pa.string()), ("n_links", pa.int64()), ("n_texts", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, h = shingle_sets(rows.column("text"), width)
        near, _ = links(first, h, rows.column("block").to_numpy(), key[1].as_py(), key[2].as_py(), bands, band_rows, threshold)
        back = rows.column("sid")
        return pa.Table.from_arrays([back, back.take(pa.array(_forest(near))), pa.array(near @ rows.column("copies").to_numpy()),
                                     pa.array(near.sum(axis=1).astype(np.int64))], schema=schema)
    return compare


def _blocks(of: DataFrame, size: str) -> DataFrame:
    """Each row once for every pair of blocks that its ``block`` is in: ``i``, ``j``."""
    out = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / BLOCK).cast("int") - 1)))
    return out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _block(size: str, name: str) -> F.Column:
    return F.pmod(F.xxhash64(name, F.lit(1)), F.ceil(F.col(size) / BLOCK).cast("int")).cast("int").alias("block")


def candidate_edges(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node`` and ``peer``: in every bucket a spanning forest of its candidates. ``members``: ``node n bands signature``."""
    probes = members.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    # two buckets with the same members (equal number and sum of hashes) have the same candidates
    members_of = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    buckets = (probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), members_of).where("m > 1")
               .groupBy("m", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "m"))
    path = scratch_path(members.sparkSession, "buckets")
    probes.join(buckets, "bucket").write.parquet(path)
    shared = members.sparkSession.read.parquet(path)
    dealt = _blocks(shared.select("bucket", "node", "m", _block("m", "node")), "m").drop("m")
    lots = F.lit(max(1, math.ceil(shared.count() / LOT)))
    full = dealt.join(members.select("node", "n", "signature"), "node")
    return (full.withColumn("lot", F.pmod(F.xxhash64("bucket", "i", "j"), lots)).groupBy("lot")
            .applyInArrow(_meet(threshold), "node long, peer long").distinct())


def near_classes(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD,
                 rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``th`` (hash of id and text), ``class_id``, ``n_links``, ``n_texts`` and
    ``keep`` for every row of ``docs``."""
    spark = docs.sparkSession
    bands = band_counts(threshold, rows, recall)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("th"), "text")
    path = scratch_path(spark, "signatures")
    (keyed.mapInArrow(_describe(width, bands, rows), "doc_id long, th long, sid binary, n int, bands array<long>, signature binary")
     .withColumn("sid", F.lower(F.hex("sid"))).write.parquet(path))
    sig = spark.read.parquet(path)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    path = scratch_path(spark, "members")
    (sig.where("n > 0").groupBy("sid").agg(F.min(rank).alias("rep"), F.count(F.lit(1)).alias("copies"),
                                           F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
     .withColumn("node", F.xxhash64("sid")).write.parquet(path))
    members = spark.read.parquet(path)

    comp = components(candidate_edges(members, threshold), "node", "peer")
    size = comp.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    inside = (members.select("node", "sid", "copies", "rep").join(comp, "node").join(size, "root")
              .select("root", "sid", "copies", "m", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), _block("m", "sid")))
    texts = (keyed.join(inside, (keyed.th == inside.rep_th) & keyed.doc_id.eqNullSafe(inside.rep_id))
             .groupBy("root", "sid", "copies", "m", "block").agg(F.first("text").alias("text")))  # repeats of a representative's row
    dealt = _blocks(texts, "m").select("root", "i", "j", "sid", "copies", "block", "text")
    path = scratch_path(spark, "links")
    (dealt.groupBy("root", "i", "j").applyInArrow(_compare(width, bands, rows, threshold), "sid string, peer string, n_links long, n_texts long")
     .where("n_texts > 0").write.parquet(path))
    found = spark.read.parquet(path)
    classes = components(found, "sid", "peer")
    counts = found.groupBy("sid").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
    linked = members.select("sid", "rep").join(classes.withColumnRenamed("node", "sid"), "sid")
    head = linked.groupBy("root").agg(F.min("rep").alias("head"))
    known = linked.select("sid", "root").join(head, "root").join(counts, "sid").select("sid", "head", "n_links", "n_texts")
    table = (members.select("sid", "rep", "copies").join(known, "sid", "left")
             .select("sid", F.coalesce("head", "rep").alias("head"),
                     (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts")))
    own = sig.select("doc_id", "th", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return (own.join(table, "sid", "left")
            .select("doc_id", "th", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
                    (F.col("sid").isNull() | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.th") == F.col("th"))))
                    .alias("keep")))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each class; rows without a word all stay."""
    here = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("h"),
                       F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    stay = near_classes(docs, **options).where("keep").select(F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th")).distinct()
    left = here.where("worded").join(stay, (F.col("h") == F.col("keep_th")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    # of rows with equal id and text the smallest by the other columns; maps have no order but their text has
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    order = F.struct(F.lit(0), *[F.to_json(F.struct(f"row.`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`") for f in rest])
    one = left.groupBy("id", "h").agg(F.min_by("row", order).alias("row")).select("row")
    return one.unionByName(here.where("not worded").select("row")).select("row.*")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of near copies of every document (five-word shingles, 0.8)."""
    from sentiscope.llm.common import table
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts")
