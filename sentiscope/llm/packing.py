"""Best-fit packing by a grouping genetic algorithm.

A document is its token ids and an end mark. One longer than a sequence is cut from its end into
whole sequences; what is left at its start is a piece like those of short documents. Whole
pieces are sequences of their own, the others are packed.

* A *field* is a set of about ``FIELD`` pieces, dealt by a hash of the piece's row. Only the
  lengths matter, so a field's problem is its lengths in falling order, and a solution gives each place
  in that order a bin.
* Every field is worked on by ``ISLANDS`` islands, each a row that one task evolves: the first has
  best-fit decreasing and variants of it as its population; a child takes whole well-filled bins of one
  parent into the other, loses the other's bins that hold the same pieces twice, and has the
  displaced pieces best-fitted in falling order. After an epoch the islands of a field send
  their best solution round a ring. A field is done as soon as one of its islands reaches
  the lower bound on the number of bins (Martello and Toth's L2).
* Bins with more than ``LOOSE`` of a sequence free are opened again, and the pieces in them of all
  fields dealt to new, fewer fields, as long as that makes at least half of the pieces final
  and gives fewer sequences.

Texts are read and encoded once, where they lie; what is shuffled are the lengths, places and
checksums of pieces. Everything an epoch leaves is a table in the shared folder and every island
draws from a seed of its own, so lost tasks are repeated alike.

Defined cases: a null or empty text is its end mark alone, one piece of length 1; equal and repeated
rows are packed as often as they occur; very long texts give as many pieces as they need; an
empty table gives an empty one; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm.common import partitions, table, units
from sentiscope.llm.encoders import ByteLevel, kept
from sentiscope.session import scratch_path

CAPACITY = 1024
END = 2
FIELD = 2048
ISLANDS = 4
EPOCHS = 3
POPULATION = 8
CHILDREN = 120
ISLANDS_A_TASK = 64
#: Free share of a bin above which its pieces are dealt again.
LOOSE = 1 / 64
SEED = 12

_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = ("field long, island int, lengths array<int>, population binary, best binary, bins int, low int, waste double")


# ---- pieces --------------------------------------------------------------------------


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of n tokens: the first takes what whole sequences leave."""
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, edges[1:]))


def _encode(file, capacity: int, end: int):
    def encode(batches):
        encoder = kept("packing", file.value, lambda text: ByteLevel(text, special=True))
        row = TaskContext.get().partitionId() << 40
        tail = np.array([end], "<u4")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), tail).astype("<u4", copy=False)
                for n, (a, b) in enumerate(cuts(len(ids), capacity)):
                    out.append((row, doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    row += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with a number of its row, written once: ``row doc_id piece start length ids_crc32``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's copy, 2 MB; tasks get it by broadcast
        shared = spark.sparkContext.broadcast(f.read())
    path = scratch_path(spark, "packing-pieces")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .mapInArrow(_encode(shared, capacity, end), _PIECE).write.parquet(path))
    return spark.read.parquet(path)


# ---- one field: lengths in falling order, a solution gives each its bin --------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: pieces that exclude each other, and what the middle ones need besides."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * np.arange(capacity + 1)))
    half = capacity // 2
    k = np.arange(half + 1)
    above = number[-1] - number[capacity - k + 1]  # longer than capacity - k
    upper = number[capacity - k + 1] - number[half + 1]  # up to that, longer than half
    room = upper * capacity - (total[capacity - k + 1] - total[half + 1])
    middle = total[half + 1] - total[k]
    more = np.maximum(0, -(-(middle - room) // capacity))
    return int(np.max(above + upper + more))


class _Bins:
    """Bins by their free space; the tightest that takes a length is found by the bits of a number. Bins
    too full for any of the lengths to come are not entered."""

    def __init__(self, free: np.ndarray, capacity: int, least: int):
        self.capacity, self.count = capacity, len(free)
        self.by: dict[int, list[int]] = {}
        self.mask = 0
        some = np.flatnonzero(free >= least)
        for b, f in zip(some.tolist(), free[some].tolist()):
            self.by.setdefault(f, []).append(b)
        for f in self.by:
            self.mask |= 1 << f

    def put(self, length: int) -> int:
        fit = self.mask >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self.by[free].pop()
            if not self.by[free]:
                self.mask &= ~(1 << free)
            free -= length
        else:
            b, free = self.count, self.capacity - length
            self.count += 1
        self.by.setdefault(free, []).append(b)
        self.mask |= 1 << free
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, solution: np.ndarray, free: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the places of ``order`` one by one into the fullest bin that takes them."""
    mine = lengths[order]
    put = _Bins(free, capacity, int(mine.min(initial=capacity))).put
    solution[order] = [put(n) for n in mine.tolist()]
    return solution


def _fills(solution: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(solution, weights=lengths).astype(np.int64)


def score(solution: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """(bins, 1 - mean squared fill): fewer bins, then fuller ones."""
    fill = _fills(solution, lengths)
    return len(fill), 1 - float(np.mean((fill / capacity) ** 2))


def _without(solution: np.ndarray, lengths: np.ndarray, gone: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new numbers of the bins that stay, displaced places, free space of those bins)."""
    number = np.cumsum(~gone) - 1
    free = capacity - _fills(solution, lengths)[~gone]
    return number, np.flatnonzero(gone[solution]), free


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``a`` put into ``b``: b's bins with the same pieces go, their other pieces are best-fitted."""
    fill = _fills(a, lengths)
    full = np.argsort(-fill, kind="stable")[:max(1, int(len(fill) * rng.uniform(0.3, 0.95)))]
    share = rng.uniform(0.2, 0.8)
    taken = np.zeros(len(fill), bool)
    taken[full[rng.random(len(full)) < share]] = True
    injected = taken[a]
    gone = np.zeros(int(b.max()) + 1, bool)
    gone[b[injected]] = True
    number, _, free = _without(b, lengths, gone, capacity)
    child = number[b]
    child[injected] = (np.cumsum(taken) - 1)[a[injected]] + len(free)
    displaced = np.flatnonzero(gone[b] & ~injected)
    return best_fit(lengths, displaced, child, np.append(free, capacity - fill[taken]), capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and some others are opened and their pieces best-fitted, longest first."""
    fill = _fills(a, lengths)
    worst = np.argsort(fill, kind="stable")[:max(1, len(fill) // 100)]
    gone = np.zeros(len(fill), bool)
    gone[worst] = True
    gone[rng.integers(0, len(fill), max(3, len(fill) // 20))] = True
    number, displaced, free = _without(a, lengths, gone, capacity)
    return best_fit(lengths, displaced, number[a], free, capacity)


def _fresh(lengths: np.ndarray, capacity: int, rng: np.random.Generator, blur: float) -> np.ndarray:
    """Best fit in falling order of lengths that are blurred by this share of a sequence."""
    order = np.arange(len(lengths))
    if blur:
        order = np.argsort(-(lengths + rng.uniform(-1, 1, len(lengths)) * blur * capacity), kind="stable")
    return best_fit(lengths, order, np.zeros(len(lengths), np.int64), np.zeros(0, np.int64), capacity)


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], seed: int, children: int = CHILDREN,
           size: int = POPULATION) -> list[np.ndarray]:
    """The population after one epoch, best first; ends at once when a solution reaches the bound."""
    rng = np.random.default_rng(seed)
    low = lower_bound(lengths, capacity)
    population = list(population)
    if not population:
        population.append(_fresh(lengths, capacity, rng, 0.0))
        if score(population[0], lengths, capacity)[0] == low:
            return population
    while len(population) < size:
        population.append(_fresh(lengths, capacity, rng, float(rng.choice([0.01, 0.03, 0.1]))))
    ranked = sorted(((score(s, lengths, capacity), n, s) for n, s in enumerate(population)), key=lambda x: x[:2])
    for n in range(len(population), len(population) + children):
        if ranked[0][0][0] <= low:
            break
        one, two = (int(x) for x in rng.integers(0, len(ranked), (2, 2)).min(axis=1))  # each the better of two
        child = crossover(ranked[one][2], ranked[two][2], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        got = score(child, lengths, capacity)
        if got < ranked[-1][0] and got not in [r[0] for r in ranked]:  # equal scores would fill the population with copies
            ranked = sorted([*ranked[:size - 1], (got, n, child)], key=lambda x: x[:2])
    return [s for _, _, s in ranked[:size]]


# ---- islands ---------------------------------------------------------------------------


def _epoch(capacity: int, seed: int):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                n = len(lengths)
                have = np.frombuffer((r["population"] or b"") + (r["migrant"] or b""), "<u2").astype(np.int64).reshape(-1, n)
                # draws hang on the field, the island and the epoch alone
                grown = evolve(lengths, capacity, list(have), zlib.crc32(f"{seed}:{r['field']}:{r['island']}".encode()))
                bins, waste = score(grown[0], lengths, capacity)
                flat = np.concatenate(grown).astype("<u2").tobytes()
                out.append((r["field"], r["island"], r["lengths"], flat, flat[:2 * n], bins, lower_bound(lengths, capacity), waste))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.float64())
            names = ["field", "island", "lengths", "population", "best", "bins", "low", "waste"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 8, kinds)], names=names)
    return run


def solve(problems: DataFrame, fields: int, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS,
          seed: int = SEED) -> DataFrame:
    """``field``, ``best`` (a bin for each place) and ``bins`` of each row of ``problems``: ``field``, ``lengths`` (falling)."""
    # islands are small rows of much work: dealt out by number, not by bytes
    tasks = units(fields * islands, partitions(problems.sparkSession), ISLANDS_A_TASK)
    spark = problems.sparkSession
    state = problems.select("field", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
                            F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    done = []
    for epoch in range(epochs):
        path = scratch_path(spark, f"packing-epoch{epoch}")
        state.repartition(tasks, F.xxhash64("field", "island")).mapInArrow(_epoch(capacity, seed + epoch), _STATE).write.parquet(path)
        grown = spark.read.parquet(path)
        done.append(grown.select("field", "best", "bins", F.struct("bins", "waste", F.lit(-epoch).alias("epoch"), "island").alias("rank")))
        left = grown.groupBy("field").agg(F.min("bins").alias("bins"), F.min("low").alias("low")).where("bins > low").select("field")
        if left.isEmpty():
            break
        elite = grown.select("field", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("migrant"))
        state = (grown.select("field", "island", "lengths", "population").join(left, "field", "left_semi")
                 .join(elite, ["field", "island"]))
    return reduce(DataFrame.unionByName, done).groupBy("field").agg(F.min_by("best", "rank").alias("best"), F.min("bins").alias("bins"))


_PLACED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loose", pa.bool_())])
_PLACED_SQL = _PIECE + ", sequence_id long, offset long, loose boolean"


def _place(capacity: int, level: int):
    def place(key: tuple[pa.Scalar, ...], rows: pa.Table, best: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _PLACED.empty_table()
        rows = rows.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = rows.column("length").to_numpy()
        solution = np.frombuffer(best.column("best")[0].as_buffer(), "<u2").astype(np.int64)
        order = np.argsort(solution, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        head = np.append(True, np.diff(solution[order]) > 0)
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - np.repeat(before[head], np.bincount(solution))
        loose = (capacity - _fills(solution, lengths) > LOOSE * capacity)[solution]
        made = [pa.array((level << 60) + (key[0].as_py() << 16) + solution), pa.array(offset), pa.array(loose)]
        return pa.Table.from_arrays([*(rows.column(f.name) for f in list(_PLACED)[:6]), *made], schema=_PLACED)
    return place


def pack(made: DataFrame, capacity: int = CAPACITY, field: int = FIELD, **options) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    spark = made.sparkSession
    out = [made.where(F.col("length") >= capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, old, opened, level = made.where(F.col("length") < capacity), None, 0, 0
    while (n := todo.count()) and level < 7:
        fields = math.ceil(n / field)
        dealt = todo.withColumn("field", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(fields)).cast("long"))
        problems = dealt.groupBy("field").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), False).alias("lengths"))
        path = scratch_path(spark, f"packing-problems{level}")
        problems.write.parquet(path)
        best = solve(spark.read.parquet(path), fields, capacity, **options)
        path = scratch_path(spark, f"packing-placed{level}")
        (dealt.groupBy("field").cogroup(best.groupBy("field")).applyInArrow(_place(capacity, level), _PLACED_SQL).write.parquet(path))
        placed = spark.read.parquet(path)
        counts = placed.groupBy("sequence_id").agg(F.first("loose").alias("loose")).agg(
            F.count(F.lit(1)).alias("all"), F.count_if("loose").alias("loose")).first()
        if old is not None and counts["all"] >= opened:
            break  # dealing again has not helped
        loose = placed.where("loose").count()
        again = fields > 1 and 2 * loose <= n
        old, todo, opened, level = placed, placed.where("loose"), counts["loose"], level + 1
        out.append(placed.where("not loose") if again else placed)
        if not again:
            old = None
            break
    if old is not None:
        out.append(old.where("loose"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return reduce(DataFrame.unionByName, [d.select(*names) for d in out])


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 1024 tokens."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json"))))
