"""A tolerant CSV file gives the same records however it is cut into ranges."""

import random
import re

import pytest

from sentiscope.sources import csv_ranges as C
from sentiscope.sources import history_csv as hcsv

# The records by one pattern over the whole file, as a definition.
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf'(?:{_QUOTED}|[^",\r\n]*+)'
_START = rf'(?:(?:"(?:[^"\n]++|"")*+"|[^",\r\n]*+)|[^,\r\n]*+),[^,\r\n]*@[^,\r\n]*,[^,\r\n]{{0,40}},'
_TEXT = rf'(?:{_QUOTED}(?=[ \t]*(?:\r?\n|\Z))|(?!")[^\r\n]*+|(?s:.*?)(?=\r?\n{_START}|\Z))'
RECORD = re.compile(rf'^(?:{_FIELD},{_FIELD},{_FIELD},{_TEXT}|[^\r\n]++)', re.M)


def whole(text):
    body = re.sub(r"(\r?\n)+\Z", "", text)
    return [m.group(0) for m in RECORD.finditer(body) if m.group(0)]


def in_ranges(text, cuts):
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    made = [C.Lines(p) for p in parts]
    entries = C.compose([m.describe() for m in made])
    out, pieces, order = [], {}, []
    for n, (m, e) in enumerate(zip(made, entries)):
        for owner, rec in C.cut(m, *e):
            if owner == -1:
                order.append(("rec", rec))
            else:
                o = n if owner < -1 else owner
                if o not in pieces:
                    order.append(("end" if owner == -3 else "piece", o))
                pieces.setdefault(o, []).append(rec)
    for kind, x in order:
        rec = x if kind == "rec" else re.sub((C.LAST_BREAKS if kind == "end" else C.LAST_BREAK).replace("z", "Z"), "", "\n".join(pieces[x]))
        if rec:
            out.append(rec)
    return out


ATOMS = ['Ann,@ann,2024-01-02,plain', 'Bob,@bob,2024-01-02,"quoted, with comma"', 'Cid,@cid,d,stray quote at end"', 'Dan,@dan,d,"never closed',
         'a line', '"', '""', 'end of it"', 'end" of it', '"Smith, Jo",@jo,d,"x ""y"" z"', '"two', 'lines",@two,d,text', '', 'Eve,@eve,d,"a', 'Fay,@fay,d,""', 'x,y',
         'Gus,@gus,d,"""q"" at the start"', 'Hal,@hal,"d', 'd2","multi', 'text"  ', ',,,', '"a","b@c","d","e"', 'Ivy,@ivy,d,"odd """', 'z"",@q,d,"']


@pytest.mark.parametrize("seed", range(8))
def test_records_do_not_depend_on_the_cuts(seed):
    rng = random.Random(seed)
    for _ in range(400):
        lines = [rng.choice(ATOMS) for _ in range(rng.randint(0, 14))]
        text = "".join(x + rng.choice(["\n", "\n", "\r\n"]) for x in lines)
        if rng.random() < 0.3:
            text = text.rstrip("\r\n")
        n = len(text.split("\n"))
        cuts = sorted(rng.randint(0, n - 1) for _ in range(rng.randint(0, 4)))
        assert in_ranges(text, cuts) == in_ranges(text, []) == whole(text), (text, cuts)


def test_one_file_is_read_by_many_tasks(spark, scratch):
    rng = random.Random(1)
    text = "author,author account,date,text\n" + "".join(rng.choice(ATOMS) + rng.choice(["\n", "\r\n"]) for _ in range(3000))
    with open(f"{scratch}/a.csv", "w", newline="") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(f"{scratch}/a.csv").rdd.getNumPartitions() > 8
        got = sorted(r.rec for r in C.records(spark, f"{scratch}/a.csv").collect())
        rows = hcsv.read_history_csv(spark, f"{scratch}/a.csv").count()
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)
    want = whole(text)
    assert got == sorted(want)
    assert rows == len([x for x in want if x.strip() and x != hcsv.HEADER])


def test_a_task_holds_one_part_of_its_split(spark, scratch, monkeypatch):
    """A split is cut into parts of a bounded size, the same in both passes, and gives the same records."""
    import pyarrow as pa
    rng = random.Random(2)
    text = "".join(rng.choice(ATOMS) + "\n" for _ in range(2000))
    lines = text.split("\n")[:-1]
    batches = lambda step: iter([pa.RecordBatch.from_pydict({"value": lines[i:i + step], "file": ["f"] * len(lines[i:i + step]),
                                                             "start": pa.array([0 if i < 1200 else 9] * len(lines[i:i + step]), pa.int64())}) for i in range(0, len(lines), step)])
    monkeypatch.setattr(C, "PART", 2000)
    parts = [(start, part, got) for _, start, part, got in C._ranges(batches(100))]
    assert parts == [(start, part, got) for _, start, part, got in C._ranges(batches(40))]
    assert sum((got for _, _, got in parts), []) == lines
    assert max(sum(len(x) + C.LINE for x in got) for _, _, got in parts) < 2200
    assert [p for s, p, _ in parts if s == 9] == list(range(len([1 for s, _, _ in parts if s == 9])))
    found = C._compose(pa.concat_tables(pa.Table.from_batches([b]) for b in C._describe(batches(100)))).to_pylist()
    assert len(found) == len(parts) > 20

    class Entries:
        value = {(r["file"], r["start"], r["part"]): tuple(r[c] for c in C._ENTRY) for r in found}

    rows = [r for b in C._cut(Entries)(batches(100)) for r in b.to_pylist()]
    made, pieces = [], {}
    for r in rows:
        made += [r["rec"]] if r["owner"] < 0 else []
        if r["owner"] >= 0:
            pieces.setdefault(r["owner"], []).append((r["number"], r["rec"], r["to_end"]))
    for p in pieces.values():
        rec = "\n".join(x for _, x, _ in sorted(p))
        made.append(re.sub((C.LAST_BREAKS if any(e for *_, e in p) else C.LAST_BREAK).replace("z", "Z"), "", rec))
    assert sorted(x for x in made if x) == sorted(whole(text))
