"""Cross-tokenizer alignment with external spill counting.

A text is encoded by two tokenizers, A and B. Byte offsets where tokens of both end cut it into
groups; every A token of a group is linked to every B token of it. An id pair's count is
the number of documents that hold the pair linked, over the whole table.

1. Documents are read and encoded once, in *batches* of bounded size where they lie. A batch makes
   its pair-document records in order of document and pair, a document's pair once with the number of
   its links; they stay with the batch, packed by zstd. What it sends is its *runs*: its different
   pairs with the number of its documents that hold them, radix-partitioned by a hash of the A id into
   ``DIGITS`` digits, sorted by A then B, in zstd frames.
2. A digit's runs are merged: a heap holds the first key of each run's next frame, frames are opened
   in that order, and all pairs below the smallest key still closed are counted at once. Cuts lie
   between A ids, so a step sees each of its A ids whole and its highest count with it
   (side-major order), and the counts and maxima stream back along the runs as answers, entry by entry.
   More than ``FAN_IN`` runs are merged by groups first and the answers led back through the
   groups in the same way, so that neither a message nor a merge grows with the input.
3. A batch meets its answers and sums them over each document's records.

A pair that a third of all documents hold is one entry for each batch, not one for each document.
All intermediate tables lie in the shared folder; a lost task repeats its batch or digit.

Defined cases: a text that is null or empty, or that a tokenizer does not give back byte for byte
(``space + text``), has no tokens: all its numbers are 0 and its digest is the empty string; a
repeated row is one more document; an id tied for its highest count has several best partners;
an empty table gives an empty one; columns besides doc_id and text are not read. A very long text is
a batch of its own, and a group of many tokens is counted by its different ids.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm import words as K
from sentiscope.llm.common import table
from sentiscope.llm.encoders import ByteLevel, Pieces, kept
from sentiscope.session import scratch_path

BATCH_BYTES = 6 << 20
DIGITS = 256
FAN_IN = 256
FRAME = 4096
#: Entries that are merged at once, about.
POOL = 1 << 17
#: Links of a group over which it is counted by its different ids.
LARGE_GROUP = 64
EXPAND = 1 << 21

_HEAD = struct.Struct("<IIQ")


# ---- packed arrays and runs -----------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as frames: entries, bytes, first key, then zstd of key steps and counts."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for i in range(0, len(keys), FRAME):
        k = keys[i:i + FRAME]
        body = press.compress(_planes(np.diff(k, prepend=k[:1]).astype("<u8")) + _planes(counts[i:i + FRAME].astype("<u8")))
        out += [_HEAD.pack(len(k), len(body), int(k[0])), body]
    return b"".join(out)


class Run:
    """A run that is opened frame by frame."""

    def __init__(self, raw: bytes):
        self._raw, self._at, self._press = raw, 0, zstandard.ZstdDecompressor()
        self.first, self.read = self._peek(), 0

    def _peek(self):
        return _HEAD.unpack_from(self._raw, self._at)[2] if self._at < len(self._raw) else None

    def frame(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(keys, counts, place of the first in the run) of the next frame."""
        n, size, first = _HEAD.unpack_from(self._raw, self._at)
        start = self._at + _HEAD.size
        body = self._press.decompress(self._raw[start:start + size])
        self._at, place = start + size, self.read
        self.read += n
        self.first = self._peek()
        keys = np.cumsum(_unplanes(body, n, "<u8"), dtype=np.uint64) + np.uint64(first)
        return keys, _unplanes(body[8 * n:], n, "<u8").astype(np.int64), place


def merge(runs: list[Run], pool: int = POOL):
    """Yields, in order, (keys, counts, run, place, entry): the different keys of the runs with their summed counts, and for each
    entry of a run the key it belongs to. No A id (upper half of a key) is in two steps."""
    heap = [(r.first, n) for n, r in enumerate(runs) if r.first is not None]
    heapq.heapify(heap)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    held = none
    while heap or len(held[0]):
        opened, size, most = [held], len(held[0]), pool + len(held[0])
        while heap and size < most:
            _, n = heapq.heappop(heap)
            keys, counts, place = runs[n].frame()
            opened.append((keys, counts, np.full(len(keys), n, np.int32), np.arange(place, place + len(keys))))
            size += len(keys)
            if runs[n].first is not None:
                heapq.heappush(heap, (runs[n].first, n))
        keys, counts, run, place = (np.concatenate(x) for x in zip(*opened))
        order = np.argsort(keys, kind="stable")
        keys, counts, run, place = keys[order], counts[order], run[order], place[order]
        cut = int(np.searchsorted(keys, np.uint64(heap[0][0] >> 32 << 32))) if heap else len(keys)
        held = keys[cut:], counts[cut:], run[cut:], place[cut:]
        if cut:
            head = np.append(True, keys[1:cut] != keys[:cut - 1])
            at = np.flatnonzero(head)
            yield keys[at], np.add.reduceat(counts[:cut], at), run[:cut], place[:cut], np.cumsum(head) - 1


def best_of_side(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; the A ids are whole."""
    side = keys >> np.uint64(32)
    at = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    return counts == np.repeat(np.maximum.reduceat(counts, at), np.diff(np.append(at, len(keys))))


def pack_answer(counts: np.ndarray, best: np.ndarray) -> bytes:
    return struct.pack("<Q", len(counts)) + zstandard.ZstdCompressor(level=1).compress(
        _planes(counts.astype("<u8")) + np.packbits(best).tobytes())


def unpack_answer(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<Q", raw)[0]
    body = zstandard.ZstdDecompressor().decompress(raw[8:])
    return _unplanes(body, n, "<u8").astype(np.int64), np.unpackbits(np.frombuffer(body, np.uint8, offset=8 * n), count=n).astype(bool)


def _spread(runs: list[Run], answers) -> list[bytes]:
    """An answer for each run, from the steps' (counts, best) by key."""
    counts = [[] for _ in runs]
    for (run, place, entry), (c, b) in answers:
        order = np.argsort(run, kind="stable")  # places of a run stay in order
        edges = np.searchsorted(run[order], np.arange(len(runs) + 1))
        for n in np.flatnonzero(np.diff(edges)):
            mine = entry[order[edges[n]:edges[n + 1]]]
            counts[n].append((c[mine], b[mine]))
    return [pack_answer(*(np.concatenate(x) for x in zip(*c))) for c in counts]


# ---- one batch of texts ---------------------------------------------------------------------


def _digit_table(vocab: int) -> np.ndarray:
    """The decimal digits of each id as bytes, zeros where there are none."""
    width = len(str(max(1, vocab - 1)))
    ids = np.arange(vocab)
    out = np.zeros((vocab, width + 1), np.uint8)
    for k in range(width):
        has = ids >= 10 ** k if k else np.ones(vocab, bool)
        out[has, width - 1 - k] = 48 + ids[has] // 10 ** k % 10
    return out


class _Side:
    """Lengths and bytes of a tokenizer's ids."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.bytes = [tokens.get(i, b"") for i in range(size)]
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        self.digits = _digit_table(size)

    def gives(self, ids, want: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == want


class Aligner:
    def __init__(self, a_file: str, b_file: bytes):
        self.a, self.b = ByteLevel(a_file, special=False), Pieces(b_file)
        self.sides = _Side(self.a.bytes), _Side(self.b.bytes)
        self.width = max(s.digits.shape[1] for s in self.sides)

    def encode(self, texts: list[str | None]):
        """(documents with tokens, A ids, B ids end to end, and the tokens of each document on both sides)."""
        some = [i for i, t in enumerate(texts) if t]
        right = self.b.ids([texts[i] for i in some])
        has, a_ids, b_ids = [], [], []
        for i, b in zip(some, right):
            want, a = b" " + texts[i].encode(), self.a.ids(" " + texts[i])
            if self.sides[0].gives(a.tolist(), want) and self.sides[1].gives(b, want):
                has.append(i)
                a_ids.append(a.astype(np.int64))
                b_ids.append(np.array(b, np.int64))
        sizes = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_ids, b_ids)]
        return np.array(has, np.int64), *flat, *sizes

    def digests(self, a, b, ga, gb, na, nb, groups_doc) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document."""
        end_a, end_b = np.cumsum(na), np.cumsum(nb)
        n = len(a) + len(b)
        text = np.zeros((n, self.width), np.uint8)
        at_a, at_b = np.arange(len(a)) + (end_b - nb)[ga], np.arange(len(b)) + end_a[gb]
        for at, ids, side in ((at_a, a, self.sides[0]), (at_b, b, self.sides[1])):
            text[at, :side.digits.shape[1] - 1] = side.digits[ids, :-1]
        text[:, -1] = ord(",")
        text[at_a[end_a - 1], -1] = ord("|")
        last = at_b[end_b - 1]
        text[last, -1] = ord(";")
        doc_last = last[np.cumsum(groups_doc) - 1]
        text[doc_last, -1] = 0
        solid = text != 0
        edges = np.append(0, np.cumsum(solid.sum(axis=1))[doc_last])
        flat = memoryview(np.ascontiguousarray(text[solid]))
        return [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(edges, edges[1:])]


def _records(a, b, ga, gb, na, nb, doc_of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of a batch's different pairs of each document, in order."""
    links = na * nb
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb

    def expand(g, a, b, ca, cb, start_b, nb):
        """All pairs of these A entries with the B entries of their groups."""
        for i, j in _slices(nb[g], EXPAND):
            n = nb[g[i:j]]
            left = np.repeat(np.arange(i, j), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + start_b[g[left]]
            doc = doc_of_group[g[left]]
            yield _fold(doc, a[left] << 32 | b[right], ca[left] * cb[right])

    ones = np.ones(max(len(a), len(b)), np.int64)
    small = (links <= LARGE_GROUP)[ga]
    parts = list(expand(ga[small], a[small], b, ones[:int(small.sum())], ones, start_b, nb))
    if not small.all():  # groups of many tokens: different ids with their numbers
        sides = []
        for g, ids in ((ga, a), (gb, b)):
            big = (links > LARGE_GROUP)[g]
            key, count = np.unique(g[big] << 32 | ids[big], return_counts=True)
            sides.append((key >> 32, key & 0xFFFFFFFF, count))
        (g, ai, ca), (h, bi, cb) = sides
        n = np.bincount(h, minlength=len(nb))
        parts += expand(g, ai, bi, ca, cb, np.cumsum(n) - n, n)
    return _fold(*(np.concatenate(x) for x in zip(*parts))) if parts else (start_a[:0],) * 3


def _slices(sizes: np.ndarray, most: int):
    """Cuts of a list whose items have these sizes, about ``most`` in each."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _fold(doc, pair, links):
    """Equal (document, pair) into one, in order."""
    order = np.lexsort((pair, doc))
    doc, pair, links = doc[order], pair[order], links[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else doc
    return doc[at], pair[at], np.add.reduceat(links, at) if len(at) else links


def align(aligner: Aligner, texts: list[str | None]):
    """What a batch knows of its documents: n_a, n_b, n_groups, n_links, digests, and (document, pair, links)."""
    has, a, b, size_a, size_b = aligner.encode(texts)
    rows = len(texts)
    numbers = [np.zeros(rows, np.int64) for _ in range(4)]
    digests = [""] * rows
    if not len(has):
        return (*numbers, digests, (has,) * 3)
    end_a, end_b = np.cumsum(aligner.sides[0].length[a]), np.cumsum(aligner.sides[1].length[b])
    mark = np.zeros(int(end_a[-1]) + 1, bool)
    mark[end_a] = True
    cut_b = mark[end_b]
    mark[:] = False
    mark[end_b] = True
    cut_a = mark[end_a]
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    na, nb = np.bincount(ga), np.bincount(gb)
    a_doc = np.repeat(np.arange(len(has)), size_a)
    doc_of_group = a_doc[np.flatnonzero(cut_a)]
    groups_doc = np.bincount(doc_of_group, minlength=len(has))
    for out, x in zip(numbers, (size_a, size_b, groups_doc, np.add.reduceat(na * nb, np.cumsum(groups_doc) - groups_doc))):
        out[has] = x
    for i, d in zip(has, aligner.digests(a, b, ga, gb, na, nb, groups_doc)):
        digests[i] = d
    return (*numbers, digests, _records(a, b, ga, gb, na, nb, has[doc_of_group]))


# ---- Spark jobs -----------------------------------------------------------------------------

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_BATCH = pa.schema([("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _NUMBERS),
                    ("groups_sha256", pa.list_(pa.string())), ("records", pa.binary()),
                    ("runs", pa.list_(pa.struct([("digit", pa.int32()), ("run", pa.binary())])))])
_BATCH_SQL = ("batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "groups_sha256 array<string>, records binary, runs array<struct<digit: int, run: binary>>")


def _by_digit(pairs: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(digit, order by digit and pair) of different sorted pairs."""
    digit = (K.mix((pairs >> 32).astype(np.uint64)) % np.uint64(digits)).astype(np.int64)
    return digit, np.argsort(digit, kind="stable")


def _batch_row(number: int, ids: list, made, digits: int) -> pa.RecordBatch:
    *numbers, digests, (doc, pair, links) = made
    pairs, local = np.unique(pair, return_inverse=True)
    digit, order = _by_digit(pairs, digits)
    held = np.bincount(local, minlength=len(pairs))[order]
    place = np.empty(len(pairs), np.int64)
    place[order] = np.arange(len(pairs))
    local, key, digit = place[local], pairs[order].astype(np.uint64), digit[order]
    edges = np.searchsorted(digit, np.arange(digits + 1))
    runs = [{"digit": d, "run": pack_run(key[i:j], held[i:j])} for d, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    within = np.lexsort((local, doc))  # by document and place among the batch's pairs: small steps
    per_doc = np.bincount(doc, minlength=len(ids))
    steps = np.diff(local[within], prepend=0)
    body = _planes(per_doc.astype("<u4")) + _planes(steps.astype("<i4")) + _planes(links[within].astype("<i8"))
    records = struct.pack("<QQ", len(ids), len(doc)) + zstandard.ZstdCompressor(level=1).compress(body)
    lists = [pa.array([x], t.type) for x, t in zip((ids, *numbers, digests), list(_BATCH)[1:7])]
    return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([records], pa.binary()), pa.array([runs], _BATCH.field("runs").type)],
                                      schema=_BATCH)


def _encode(a_file, b_file, digits: int, most: int):
    def encode(batches):
        aligner = kept("alignment", (a_file.value, b_file.value), lambda files: Aligner(*files))
        number = TaskContext.get().partitionId() << 40
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 64
                if size >= most:
                    yield _batch_row(number, ids, align(aligner, texts), digits)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield _batch_row(number, ids, align(aligner, texts), digits)
    return encode


_RUN_SQL, _ANSWER_SQL = "digit int, run long, blob binary", "digit int, run long, answer binary"


def _opened(rows: pa.Table) -> tuple[list[int], list[Run]]:
    rows = rows.sort_by("run")
    return rows.column("run").to_pylist(), [Run(x.as_py()) for x in rows.column("blob")]


def _answer_rows(digit, numbers: list[int], answers: list[bytes]) -> pa.Table:
    return pa.table({"digit": pa.array([digit] * len(numbers), pa.int32()), "run": pa.array(numbers, pa.int64()), "answer": pa.array(answers, pa.binary())})


def _top(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    numbers, runs = _opened(rows)
    answers = (((run, place, entry), (counts, best_of_side(keys, counts))) for keys, counts, run, place, entry in merge(runs))
    return _answer_rows(key[0].as_py(), numbers, _spread(runs, answers))


def _up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    made = b"".join(pack_run(keys, counts) for keys, counts, *_ in merge(_opened(rows)[1]))
    return pa.table({"digit": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int64()), "blob": pa.array([made], pa.binary())})


def _down(key: tuple[pa.Scalar, ...], rows: pa.Table, answer: pa.Table) -> pa.Table:
    numbers, runs = _opened(rows)
    counts, best = unpack_answer(answer.column("answer")[0].as_py())

    def answers():
        done = 0
        for keys, _, run, place, entry in merge(runs):
            yield (run, place, entry), (counts[done:done + len(keys)], best[done:done + len(keys)])
            done += len(keys)
    return _answer_rows(key[0].as_py(), numbers, _spread(runs, answers()))


def count_runs(runs: DataFrame, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """An answer for each of ``runs`` (``digit run blob``; at most about ``n`` in a digit): the pairs' counts over all runs and
    whether they are their side's highest."""
    if n <= fan_in:
        return runs.groupBy("digit").applyInArrow(_top, _ANSWER_SQL)
    groups = math.ceil(n / fan_in)
    grouped = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    path = scratch_path(runs.sparkSession, "alignment-runs")
    grouped.groupBy("digit", "group").applyInArrow(_up, _RUN_SQL).write.parquet(path)
    up = count_runs(runs.sparkSession.read.parquet(path), groups, fan_in).withColumnRenamed("run", "group")
    return grouped.groupBy("digit", "group").cogroup(up.groupBy("digit", "group")).applyInArrow(_down, _ANSWER_SQL)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*_NUMBERS, "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _finish(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _OUT.empty_table()
    flat = {c: rows.column(c).combine_chunks().flatten() for c in ("doc_id", *_NUMBERS, "groups_sha256")}
    raw = rows.column("records")[0].as_py()
    docs, n = struct.unpack_from("<QQ", raw)
    body = zstandard.ZstdDecompressor().decompress(raw[16:])
    per_doc = _unplanes(body, docs, "<u4").astype(np.int64)
    local = np.cumsum(_unplanes(body[4 * docs:], n, "<i4"), dtype=np.int64)
    links = _unplanes(body[4 * docs + 4 * n:], n, "<i8")
    best_sum, count_sum = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    if n:
        got = [unpack_answer(x.as_py()) for x in answers.sort_by("digit").column("answer")]
        counts, best = (np.concatenate(x) for x in zip(*got))
        has = per_doc > 0
        at = (np.cumsum(per_doc) - per_doc)[has]
        best_sum[has] = np.add.reduceat(links * best[local], at)
        count_sum[has] = np.add.reduceat(links * counts[local], at)
    made = {**flat, "n_best": pa.array(best_sum), "count_sum": pa.array(count_sum)}
    return pa.Table.from_arrays([made[f.name] for f in _OUT], schema=_OUT)


def alignments(docs: DataFrame, a_path: str, b_path: str, digits: int = DIGITS, fan_in: int = FAN_IN,
               batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:  # the driver's copies, 3 MB; tasks get them by broadcast
        a_file, b_file = spark.sparkContext.broadcast(a.read()), spark.sparkContext.broadcast(b.read())
    path = scratch_path(spark, "alignment-batches")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .mapInArrow(_encode(a_file, b_file, digits, batch_bytes), _BATCH_SQL).write.parquet(path))
    batches = spark.read.parquet(path)
    runs = batches.select(F.col("batch").alias("run"), F.explode("runs").alias("r")).select("r.digit", "run", F.col("r.run").alias("blob"))
    answers = count_runs(runs, batches.count(), fan_in).withColumnRenamed("run", "batch")
    return (batches.drop("runs").groupBy("batch").cogroup(answers.groupBy("batch"))
            .applyInArrow(_finish, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in _OUT)))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of byte-level BPE against sentencepiece in every document."""
    import public_tokenizers
    return alignments(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                      str(public_tokenizers.path("piece_bpe_32k.model")))
