"""Records of a hand-edited CSV file, read by many tasks at once (SRC-03).

Where a record ends depends on quotes that may stand any number of lines further down, so a byte range of a
file cannot be cut into records on its own. It can be described on its own:

* what a record that begins at a given line does: it ends in the range, or it is still inside its n-th quoted
  field at the range's end (and, should that quote turn out not to be closed well, where it would go on);
* what becomes of a record that comes in from before, still inside its n-th quoted field;
* the first line that looks like the start of a record.

A record can enter a range only at its first line, at the end of a quoted field that came in, or at that line;
so a range's description is a map from a handful of entries to exits, and the maps of a file's ranges are
composed in order to give each range its entry. A second pass cuts the records. A record that spans ranges is put together
from one piece of each.

The rules are those of ``history_csv``: of a record's last field a well-formed quoted one comes first, then the rest of
the line, then, where a quote is never closed, everything up to the next line that starts like a record (in
that line alone); a line that is no record is a record by itself. A carriage return that does not end a line is a
character like any other.
"""

from __future__ import annotations

import itertools
import json
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, SparkSession, functions as F

_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_START = re.compile(rf'(?:{_FIELD}|[^,]*+),[^,]*@[^,]*,[^,]{{0,40}},')
_RUNS = re.compile(r'"+')
_PLAIN = re.compile(r'[^",\r]*')
_BLANK = re.compile(r"[ \t]*\r?\Z")
LAST_BREAK, LAST_BREAKS = r"\r\z", r"(\r?\n)*\r?\z"
#: Number of the last of a record's four fields.
LAST = 3
#: Bytes of a file that a task holds at once, about, and what a line counts besides its own bytes.
PART, LINE = 4 << 20, 64


class Lines:
    """The lines of a range: where each first run of an odd number of quotes ends, and which lines look like a start."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        n = len(lines)
        self.closes = [self._odd(x, 0) if '"' in x else -1 for x in lines]
        #: next line from here on with such a run, or that looks like a start
        self.next_close, self.next_start = [n] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.next_close[i] = i if self.closes[i] >= 0 else self.next_close[i + 1]
            self.next_start[i] = i if "@" in lines[i] and _START.match(lines[i]) else self.next_start[i + 1]
        self._ends: dict[int, tuple] = {}

    @staticmethod
    def _odd(line: str, at: int) -> int:
        """Where the first run of an odd number of quotes from ``at`` on ends, or -1."""
        for m in _RUNS.finditer(line, at):
            if (m.end() - m.start()) % 2:
                return m.end()
        return -1

    def _closing(self, i: int, at: int) -> tuple[int, int] | None:
        """(line, place after it) of the quote that closes a field whose text goes on at this place."""
        end = self._odd(self.lines[i], at) if '"' in self.lines[i][at:] else -1
        if end >= 0:
            return i, end
        j = self.next_close[i + 1]
        return (j, self.closes[j]) if j < len(self.lines) else None

    def _quoted(self, i: int, at: int) -> tuple[int, int] | None:
        """The same for a field that opens here: what follows its first quote in one run belongs to it."""
        end = at
        line = self.lines[i]
        while end < len(line) and line[end] == '"':
            end += 1
        return (i, end) if (end - at) % 2 == 0 else self._closing(i, end)

    def record(self, i: int) -> tuple:
        """What a record that begins at line i does: ("end", next line, line, place) with the last line and place of its
        text; ("open", field, fallback) where it is inside a quoted field at the end of the range."""
        if i not in self._ends:
            self._ends[i] = self._fields(i, i, 0, 0)
        return self._ends[i]

    def _alone(self, first: int) -> tuple:
        return ("end", first + 1, first, len(self.lines[first].removesuffix("\r")))

    def until_start(self, i: int) -> tuple:
        """A last field, opened in line i, that is never closed: up to the next line that looks like a start."""
        j = self.next_start[i + 1]
        return ("end", j, j - 1, len(self.lines[j - 1].removesuffix("\r"))) if j < len(self.lines) else ("start",)

    def _fields(self, first: int, i: int, at: int, field: int) -> tuple:
        """The fields from number ``field`` on, at a place; ``first`` is the record's first line (-1: in an earlier range)."""
        failed = self._alone(first) if first >= 0 else ("fail",)
        while field < LAST:
            if self.lines[i].startswith('"', at):
                closed = self._quoted(i, at)
                if closed is None:
                    return ("open", field, failed)
                i, at = closed
            else:
                at = _PLAIN.match(self.lines[i], at).end()
            if not self.lines[i].startswith(",", at):
                return failed
            at, field = at + 1, field + 1
        if not self.lines[i].startswith('"', at):
            return ("end", i + 1, i, len(self.lines[i].removesuffix("\r")))
        closed = self._quoted(i, at)
        if closed is None:
            return ("open", LAST, self.until_start(i))
        j, end = closed
        return ("end", j + 1, j, end) if _BLANK.match(self.lines[j], end) else self.until_start(i)

    def entered(self, field: int) -> tuple:
        """What becomes of a record that comes in inside its field ``field``: as ``record``; ("fail",) where its fields do not
        go on, ("bad",) where its last field is not closed well."""
        closed = self._closing(0, 0) if self.lines else None
        if closed is None:
            return ("open", field, None)
        i, at = closed
        if field == LAST:
            return ("end", i + 1, i, at) if _BLANK.match(self.lines[i], at) else ("bad",)
        return self._fields(-1, i, at + 1, field + 1) if self.lines[i].startswith(",", at) else ("fail",)

    def leave(self, i: int) -> tuple:
        """How a reader that begins a record at line i comes to the end: ("next",) between records; ("start", line) in that line's
        record, which ends before the next line that looks like a start; ("open", field, line, exit if it fails)."""
        while i < len(self.lines):
            r = self.record(i)
            if r[0] == "end":
                i = r[1]
            elif r[0] == "start":
                return ("start", i)
            else:
                return ("open", r[1], i, ("start", i) if r[2][0] == "start" else self.leave(r[2][1]))
        return ("next",)

    def describe(self) -> dict:
        """The range as a map: exits by the few entries there are."""
        end = lambda r: (r, self.leave(r[1])) if r and r[0] == "end" else (r, None)
        come = []
        for field in range(LAST + 1):
            r = self.entered(field)
            # a range in which the record goes on to another field says what follows if that one fails
            come.append((*end(r), end(r[2]) if r[0] == "open" and r[1] == LAST and r[1] != field else None))
        s = self.next_start[0]
        return {"n": len(self.lines), "first": self.leave(0), "start": s, "at_start": self.leave(s), "come": come}


def _resolve(ranges: list[dict], at: int, exit_: tuple) -> tuple:
    """Where the record that leaves range ``at`` ends: ("end", range, (.., next line, line, place), exit there), range = number of
    ranges at the end of the file; or ("back", exit) if it turns out to end in its own range."""
    n = len(ranges)

    def next_start(d: int) -> tuple:
        while d < n and ranges[d]["start"] >= ranges[d]["n"]:
            d += 1
        if d == n:
            return ("end", n, None, ("next",))
        s = ranges[d]["start"]
        return ("end", d, ("end", s, s - 1, None), ranges[d]["at_start"])

    if exit_[0] == "start":
        return next_start(at + 1)
    _, field, _, back = exit_
    later = None  # the last field was opened in a later range: what to do if it fails
    for d in range(at + 1, n):
        r, leave, fails = ranges[d]["come"][field]
        if r[0] == "end":
            return ("end", d, r, leave)
        if r[0] != "open":
            break
        if r[1] != field:
            field, later = r[1], (d, fails) if r[1] == LAST else None
    if later is None:
        return ("back", back)
    d, (r, leave) = later
    return next_start(d + 1) if r[0] == "start" else ("end", d, r, leave)


def compose(ranges: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
    """For the ranges of a file, in order: the line at which its first own record begins; the range where the record that comes in
    began (-1: none), and the last line and place of that one's text here (line -2: all of the range, place -1: the whole line); the line
    of the record that leaves (-1: none), and whether that one ends with the file."""
    n = len(ranges)
    out = [[0, -1, -1, -1, -1, 0] for _ in ranges]
    at, exit_ = 0, ranges[0]["first"] if n else ("next",)
    while at < n:
        if exit_[0] == "next":
            at += 1
            exit_ = ranges[at]["first"] if at < n else exit_
            continue
        r = _resolve(ranges, at, exit_)
        if r[0] == "back":
            exit_ = r[1]
            continue
        _, d, end, leave = r
        out[at][4:] = [exit_[1] if exit_[0] == "start" else exit_[2], int(d == n)]
        for k in range(at + 1, min(d, n)):
            out[k][:4] = [ranges[k]["n"], at, -2, -1]
        if d < n:
            out[d][:4] = [end[1], at, end[2], -1 if end[3] is None else end[3]]
        at, exit_ = d, leave
    return [tuple(x) for x in out]


def cut(lines: Lines, entry: int, owner: int, last: int, place: int, leaves: int, to_end: int):
    """(owner or -1 for a whole record, text) of a range's records and pieces; -2 and -3 are first pieces of its own, of
    a record that ends with the file (-3) or before."""
    text = lines.lines
    if owner >= 0 and last == -2 and text:
        yield owner, "\n".join(text)
    elif owner >= 0 and last >= 0:
        whole = text[last].removesuffix("\r") if place < 0 else text[last][:place]
        yield owner, "\n".join([*text[:last], whole])
    i = entry
    while i < len(text):
        if i == leaves:
            yield -2 - to_end, "\n".join(text[i:])
            return
        r = lines.record(i)
        r = r[2] if r[0] == "open" else r
        _, j, last, place = r
        yield -1, "\n".join([*text[i:last], text[last][:place]])
        i = j


# ---- Spark jobs ------------------------------------------------------------------------


def _runs(column: pa.Array):
    """(value, from, to) of the runs of equal values in a column."""
    ends = pa.compute.run_end_encode(column)
    first = 0
    for value, last in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
        yield value, first, last
        first = last


def _ranges(batches):
    """(file, start, part, lines) of the ranges that a task reads, one at a time; a split is cut into parts at lines, always the same."""
    key, part, lines, held = None, 0, [], 0
    for batch in batches:
        for file, a, b in _runs(batch.column("file")):
            for start, c, d in _runs(batch.column("start").slice(a, b - a)):
                if (file, start) != key:
                    if lines:
                        yield *key, part, lines
                    key, part, lines, held = (file, start), 0, [], 0
                values = batch.column("value").slice(a + c, d - c)
                for v, n in zip(values, pa.compute.binary_length(values).to_pylist()):
                    if held >= PART:
                        yield *key, part, lines
                        part, lines, held = part + 1, [], 0
                    lines.append(v.as_py())
                    held += n + LINE
    if lines:
        yield *key, part, lines


def _describe(batches):
    for file, start, part, lines in _ranges(batches):
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([part], pa.int32()), pa.array([json.dumps(Lines(lines).describe())])],
                                         names=["file", "start", "part", "map"])


def _compose(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("start", "ascending"), ("part", "ascending")])
    made = compose([json.loads(x) for x in rows.column("map").to_pylist()])
    return pa.Table.from_arrays([rows.column("file"), rows.column("start"), rows.column("part"), pa.array(range(len(made)), pa.int32()),
                                 *(pa.array(c, pa.int32()) for c in zip(*made))], schema=_ENTRIES)


_ENTRY = ("number", "entry", "owner", "last", "place", "leaves", "to_end")
_ENTRIES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), *((c, pa.int32()) for c in _ENTRY)])


def _cut(entries):
    def run(batches):
        known = entries.value
        for file, start, part, lines in _ranges(batches):
            number, *entry = known[file, start, part]
            made = cut(Lines(lines), *entry)
            while some := list(itertools.islice(made, 1000)):
                owner, rec = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array([number if o < -1 else o for o in owner], pa.int32()),
                                                  pa.array([number] * len(some), pa.int32()), pa.array(rec, pa.string()), pa.array([o == -3 for o in owner], pa.bool_())],
                                                 names=["file", "owner", "number", "rec", "to_end"])
    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """``rec``: the records of all files below a path, as text. Ranges are parts of the splits that Spark makes of the files
    (``spark.sql.files.maxPartitionBytes``); a task holds one of them, however large its splits are."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
    found = lines.mapInArrow(_describe, "file string, start long, part int, map string").groupBy("file").applyInArrow(
        _compose, "file string, start long, part int, " + ", ".join(f"{c} int" for c in _ENTRY)).toArrow().to_pylist()
    # a row for each range of PART bytes, some 100 bytes
    entries = spark.sparkContext.broadcast({(r["file"], r["start"], r["part"]): tuple(r[c] for c in _ENTRY) for r in found})
    made = lines.mapInArrow(_cut(entries), "file string, owner int, number int, rec string, to_end boolean")
    pieces = (made.where("owner >= 0").groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "rec"))), lambda x: x["rec"]), "\n").alias("rec"), F.max("to_end").alias("to_end")))
    # a record ends before its line break, the last one of a file before all that follow
    pieces = pieces.select(F.when(F.col("to_end"), F.regexp_replace("rec", LAST_BREAKS, "")).otherwise(F.regexp_replace("rec", LAST_BREAK, "")).alias("rec"))
    return made.where("owner < 0").select("rec").unionByName(pieces).where(F.length("rec") > 0)
