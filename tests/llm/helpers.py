"""Brute-force versions and comparisons for the tests of this folder."""

import hashlib
import re

import duckdb

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall(text or "")


def id_key(doc_id):
    return doc_id is None, doc_id or 0


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def same_as_sql(df, sql, sf=SF001, **tables):
    """Values of a Spark result and of DuckDB SQL over the same tables."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        if t in tables:
            con.register(f"{t}_given", tables[t].toArrow())
            con.sql(f"CREATE TABLE {t} AS SELECT * FROM {t}_given")
        else:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df, *want.columns) == sorted(want.fetchall(), key=str)


def repeats_removed(given, window):
    """op3 by its definition."""
    seen = {}
    cut = [(d, words(t)) for d, t in given]
    for d, w in cut:
        for q in range(len(w) - window + 1):
            k, at = tuple(w[q:q + window]), (id_key(d), q)
            seen[k] = min(seen.get(k, at), at)
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for q in range(len(w) - window + 1):
            if seen[tuple(w[q:q + window])] < (id_key(d), q):
                gone[q:q + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1))


def linked(given, threshold=0.8):
    """(component, links to other rows, different texts linked) of each row, pair by pair."""
    sets = [shingles(t) for _, t in given]
    n = len(given)
    up, links, texts = list(range(n)), [0] * n, [set() for _ in given]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                if sets[a] != sets[b]:
                    texts[a].add(sets[b])
                    texts[b].add(sets[a])
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [(top(a), links[a], len(texts[a])) for a in range(n)]


def near_classes(given):
    """op8 by its definition: (doc_id, class_id, n_links, n_texts)."""
    found, least = linked(given), {}
    for (doc_id, _), (c, _, _) in zip(given, found):
        least[c] = min(least.get(c, doc_id), doc_id, key=id_key)
    return sorted(((d, least[c], n, m) for (d, _), (c, n, m) in zip(given, found)), key=str)


def edit_distance_inside(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    column, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        fresh = [0]
        for i, p in enumerate(pattern, 1):
            fresh.append(min(column[i] + 1, fresh[-1] + 1, column[i - 1] + (p != c)))
        column = fresh
        best = min(best, column[-1])
    return best
