"""Tables that grow by commits: segments of Parquet files and a manifest that names the live ones.

A commit writes its rows to a segment of its own and then a manifest, a small JSON folder with
the next version number, which lists all live segments. Readers take the highest
finished manifest and read exactly the segments it names, so they see a commit whole or not at
all, and nothing is copied or renamed. One writer at a time is assumed; the manifest's folder is
made with ``errorifexists``, so of two writers one fails.

Small segments are merged while the table grows: as soon as ``fan`` neighbours have one tier, they
become a segment of the next. After n commits at most ``(fan - 1) * log_fan(n) + 1`` segments
are live, and each row has been rewritten ``log_fan(n)`` times. Segments that were merged away, and
old manifests, are deleted ``keep`` versions later, so readers that have just opened one can finish.

A commit carries the stream and the batch it belongs to; a batch that is committed already is not
committed again (``committed``), which makes a replay after a failure harmless. It may carry one more
path (``extra``), a small table that changes with it.

``rewrite`` replaces single files: the files that hold rows to be changed are read and
written anew as a segment, and the manifest leaves them out of theirs. Which files hold an
id is known from an index beside the table (``index_by``): a row for each file with its
least and greatest id and a Bloom filter of all (``touched``).
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FAN = 8
KEEP = 4
#: Origin of rows that several streams have stored.
MIXED = "mixed"

_ROW = T.StructType([T.StructField(n, k()) for n, k in (
    ("version", T.LongType), ("stream", T.StringType), ("batch", T.LongType), ("path", T.StringType), ("tier", T.IntegerType),
    ("origin", T.StringType), ("dead_since", T.LongType), ("extra", T.StringType))]
    + [T.StructField("without", T.ArrayType(T.StringType()))])


class Segment(NamedTuple):
    path: str  # below the table's root
    tier: int = 0
    origin: str | None = None  # the stream whose rows it holds
    without: tuple[str, ...] = ()  # files of it that have been written anew


class Manifest(NamedTuple):
    version: int = -1
    stream: str | None = None
    batch: int = -1
    live: tuple[Segment, ...] = ()
    dead: tuple[tuple[str, int], ...] = ()
    extra: str | None = None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/_manifest/{version:012d}"


def latest(spark: SparkSession, root: str) -> Manifest:
    """The highest finished manifest; an empty one where there is none."""
    for name in sorted((n for n in _names(spark, f"{root}/_manifest") if n.isdigit()), reverse=True):
        path = _manifest_path(root, int(name))
        if not exists(spark, f"{path}/_SUCCESS"):
            continue  # its writer died
        rows = spark.read.schema(_ROW).json(path).collect()  # a row for each segment: bounded by the tiers
        live = tuple(Segment(r.path, r.tier, r.origin, tuple(r.without or ())) for r in rows if r.path and r.dead_since is None)
        dead = tuple((r.path, r.dead_since) for r in rows if r.dead_since is not None)
        head = rows[0]
        order = {s.path: s for s in live}
        return Manifest(head.version, head.stream, head.batch, tuple(order[p] for p in sorted(order, key=_first)), dead, head.extra)
    return Manifest()


def _first(path: str) -> int:
    """Segments are named by the first version of their rows."""
    return int(path.split("=")[1].split("-")[0])


def _commit(spark: SparkSession, root: str, m: Manifest) -> None:
    head = (m.version, m.stream, m.batch)
    rows = [(*head, s.path, s.tier, s.origin, None, m.extra, list(s.without)) for s in m.live]
    rows += [(*head, p, None, None, since, m.extra, None) for p, since in m.dead]
    rows = rows or [(*head, None, None, None, None, m.extra, None)]
    path = _manifest_path(root, m.version)
    if exists(spark, path) and not exists(spark, f"{path}/_SUCCESS"):
        delete(spark, path)  # left by a writer that died
    spark.createDataFrame(rows, _ROW).coalesce(1).write.mode("errorifexists").json(path)


def committed(m: Manifest, stream: str | None, batch: int | None) -> bool:
    """Whether this batch of this stream is in the table (batches come in order, so only the last can come again)."""
    return batch is not None and m.version >= 0 and m.stream == stream and batch <= m.batch


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    if partition_by:  # clustered, so that a task writes few folders; adaptive execution splits a large one again
        adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"  # off in micro-batches, where the hint has no effect
        df = df.hint("rebalance", partition_by) if adaptive else df.repartition(partition_by)
        df.write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _name(first: int, version: int, tier: int) -> str:
    return f"segment={first}-{version}-{tier}-{uuid.uuid4().hex[:8]}"


def _inside(path: str) -> str:
    """A file's path below its segment, which starts with the segment's own folder."""
    return path[path.rindex("/segment=") + 1:]


def read_segments(spark: SparkSession, root: str, segments, schema: T.StructType | None, with_file: bool = False) -> DataFrame:
    """The rows of these segments; ``with_file`` adds ``_file``, the file of each."""
    paths = []
    for s in segments:
        path = f"{root}/{s.path}"
        if s.without:
            gone = set(s.without)
            paths += [f for f in spark.read.parquet(path).inputFiles() if _inside(f) not in gone]
        else:
            paths.append(path)
    return read_files(spark, root, paths, schema, with_file)


def read_files(spark: SparkSession, root: str, paths: list[str], schema: T.StructType | None, with_file: bool = False) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], T.StructType((schema or T.StructType()).fields + [T.StructField("_file", T.StringType())] * with_file))
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("basePath", root).parquet(*paths)
    names = schema.fieldNames() if schema else [c for c in df.columns if c != "segment"]
    return df.select(*names, *[F.col("_metadata.file_path").alias("_file")] * with_file)


def read(spark: SparkSession, root: str, schema: T.StructType | None = None, with_file: bool = False) -> DataFrame:
    """The rows of the last committed version."""
    return read_segments(spark, root, latest(spark, root).live, schema, with_file)


def append(df: DataFrame, root: str, schema: T.StructType, stream: str | None = None, batch: int | None = None, partition_by: str | None = None,
           merge: Callable[[DataFrame], DataFrame] | None = None, extra: str | None = None, index_by: str | None = None,
           fan: int = FAN, keep: int = KEEP) -> bool:
    """Commits the rows of ``df``; False if this batch is committed already. ``merge`` makes the rows of merged segments
    fewer (sums, last writes); without it they are kept as they are."""
    spark = df.sparkSession
    m = latest(spark, root)
    if committed(m, stream, batch):
        return False
    version = m.version + 1
    path = _name(version, version, 0)
    _write(df.select(*schema.fieldNames()), f"{root}/{path}", partition_by)
    live, dead = [*m.live, Segment(path, 0, stream)], list(m.dead)
    while len(live) >= fan and len({(s.tier, s.origin) for s in live[-fan:]}) == 1:
        group = live[-fan:]
        rows = read_segments(spark, root, group, schema)
        path = _name(_first(group[0].path), version, group[0].tier + 1)
        _write(merge(rows).select(*schema.fieldNames()) if merge else rows, f"{root}/{path}", partition_by)
        live = [*live[:-fan], Segment(path, group[0].tier + 1, stream)]
        dead += [(s.path, version) for s in group]
    if index_by:
        for s in live:
            if s not in m.live:
                index_files(spark, root, s, index_by)
    _finish(spark, root, Manifest(version, stream, -1 if batch is None else batch, tuple(live), tuple(dead), extra or m.extra), keep)
    return True


def rewrite(df: DataFrame, root: str, schema: T.StructType, files: list[str], partition_by: str | None = None, index_by: str | None = None,
            keep: int = KEEP) -> Manifest:
    """Commits ``df`` in place of these files of the table."""
    spark = df.sparkSession
    m = latest(spark, root)
    version = m.version + 1
    gone: dict[str, set[str]] = {}
    for f in map(_inside, files):
        gone.setdefault(f.split("/")[0], set()).add(f)
    origins = {s.origin for s in m.live if s.path in gone}
    made = Segment(_name(version, version, 0), 0, origins.pop() if len(origins) == 1 else MIXED)
    _write(df.select(*schema.fieldNames()), f"{root}/{made.path}", partition_by)
    if index_by:
        index_files(spark, root, made, index_by)
    live = [s._replace(without=tuple(sorted({*s.without, *gone[s.path]}))) if s.path in gone else s for s in m.live]
    # a segment of which nothing is left
    empty = {s.path for s in live if s.path in gone and not read_segments(spark, root, [s], None).inputFiles()}
    dead = (*m.dead, *((p, version) for p in sorted(empty)))
    out = m._replace(version=version, live=(*(s for s in live if s.path not in empty), made), dead=dead)
    _finish(spark, root, out, keep)
    return out


# ---- which files hold an id -------------------------------------------------------------------

BITS, HASHES = 16, 6


def _bloom(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of so many bits, a row for each."""
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def _index(batches):
    parts: dict[str, list] = {}
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        code = files.indices.to_numpy()
        for n, name in enumerate(files.dictionary.to_pylist()):
            mine = pa.array(code == n)
            parts.setdefault(name, []).append((batch.column("h").filter(mine).to_numpy(), batch.column("id").filter(mine)))
    for name, got in parts.items():
        h = np.concatenate([x for x, _ in got]).view(np.uint64)
        ids = pa.compute.min_max(pa.chunked_array([x for _, x in got]))
        bits = max(64, BITS * len(h))
        mark = np.zeros(bits, bool)
        mark[_bloom(h, bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids["min"].as_py()], pa.string()), pa.array([ids["max"].as_py()], pa.string()),
                                          pa.array([bits], pa.int64()), pa.array([np.packbits(mark).tobytes()], pa.binary())],
                                         names=["file", "least", "most", "bits", "bloom"])


_INDEX = "file string, least string, most string, bits long, bloom binary"


def index_files(spark: SparkSession, root: str, segment: Segment, key: str) -> None:
    """Writes the index of a segment's files: a row for each file (or each split of it)."""
    rows = read_segments(spark, root, [segment], None, with_file=True).where(F.col(key).isNotNull())
    (rows.select(F.col(key).cast("string").alias("id"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col("_file").alias("file"))
     .mapInArrow(_index, _INDEX).write.mode("overwrite").parquet(f"{root}/_index/{segment.path}"))


#: Ids that meet the index at once; more go in several blocks.
BLOCK = 1_000_000


def touched(spark: SparkSession, root: str, ids: DataFrame, key: str = "id") -> list[str]:
    """The live files that may hold one of these ids: all that do, and of the others hardly any."""
    live = latest(spark, root).live
    gone = {f for s in live for f in s.without}
    paths = [f"{root}/_index/{s.path}" for s in live]
    if not paths:
        return []
    index = spark.read.schema(_INDEX).parquet(*paths)
    wanted = ids.select(F.col(key).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("h", F.xxhash64("id"))
    out: set[str] = set()
    blocks = -(-wanted.count() // BLOCK)
    for n in range(blocks):
        mine = wanted.where(F.pmod("h", F.lit(blocks)) == n).orderBy("id").toArrow()  # about BLOCK ids
        shared = spark.sparkContext.broadcast((mine.column("id").to_pylist(), mine.column("h").to_numpy().view(np.uint64)))

        def probe(batches, shared=shared):
            names, h = shared.value
            for batch in batches:
                hit = []
                for r in batch.to_pylist():
                    a, b = bisect.bisect_left(names, r["least"]), bisect.bisect_right(names, r["most"])
                    mark = np.unpackbits(np.frombuffer(r["bloom"], np.uint8), count=r["bits"])
                    hit.append(bool(b > a and mark[_bloom(h[a:b], r["bits"])].all(axis=1).any()))
                yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(hit, pa.bool_()))], names=["file"])

        out |= {r.file for r in index.mapInArrow(probe, "file string").distinct().collect()}
    return sorted(f for f in out if _inside(f) not in gone)


def replace(df: DataFrame, root: str, schema: T.StructType, partition_by: str | None = None, keep: int = KEEP) -> Manifest | None:
    """Commits ``df`` as the whole table; None, and nothing committed, if it has no rows (FLT-11, D18)."""
    spark = df.sparkSession
    m = latest(spark, root)
    version = m.version + 1
    path = _name(version, version, 0)
    _write(df.select(*schema.fieldNames()), f"{root}/{path}", partition_by)
    if read_segments(spark, root, [Segment(path)], schema).isEmpty():
        delete(spark, f"{root}/{path}")
        return None
    dead = (*m.dead, *((s.path, version) for s in m.live))
    made = Manifest(version, m.stream, m.batch, (Segment(path),), dead)
    _finish(spark, root, made, keep)
    return made


def _finish(spark: SparkSession, root: str, m: Manifest, keep: int) -> None:
    """Commits, then deletes what no reader of the last ``keep`` versions names."""
    old = [p for p, since in m.dead if since <= m.version - keep]
    _commit(spark, root, m._replace(dead=tuple((p, since) for p, since in m.dead if p not in old)))
    for p in old:
        delete(spark, f"{root}/{p}")
        delete(spark, f"{root}/_index/{p}")
    for name in _names(spark, f"{root}/_manifest"):
        if name.isdigit() and int(name) < m.version - keep:
            delete(spark, _manifest_path(root, int(name)))
