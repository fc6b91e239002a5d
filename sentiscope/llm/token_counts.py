"""Token counts by a finite-state tokenizer.

The tokenizer file (byte-level BPE with word ends, lower case, NFC) is compiled to one
deterministic transducer over characters. Its transitions carry the number of tokens
that they emit, so a count is a sum along the path and no token is ever made.

* The *lexer* part has a state for each way to be inside a word: letters, other marks, an
  apostrophe that may open a contraction, or nothing.
* The *merge* part follows a word byte by byte. BPE has the property that the encoding of a
  prefix is the encoding of a shorter prefix and one last token, and that a token may
  follow another exactly if the two, encoded together, stay as they are. So a state is the set
  of token beginnings that are still open, each with the token before it and its count
  relative to now; reading a byte closes exactly one of them as the last token of the
  longer prefix. The count may go down when a longer token replaces several. The last byte
  of a word is a symbol of its own (``x</w>``), so a byte is read when its successor is known.

States and transitions are made when a text first needs them and kept in bounded
tables; a run between white space that was met before is one transition. A full table
starts anew, which changes time only.

A text is cut into chunks. White space brings the transducer to its start state from any
state, so a chunk's map from entry state to (exit state, count) is its characters before the
first white space, a constant, and those after the last. These maps compose
associatively; a text's count comes from composing them in a balanced tree.

Special strings are cut out before everything else and count one token each, as the
library does by default. Defined cases: a null or empty text has 0 bytes and 0 tokens;
repeated rows count alike; an empty table gives an empty table; ``n_bytes``,
``n_tokens`` and ``over_limit`` replace columns of these names, others pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LIMIT = 2048
#: Bounds of the tables in a worker's memory: states, runs between white space, pairs of
#: tokens. A full table starts anew; runs met lately stay for one more turn.
STATES = 100_000
RUNS = 300_000
PAIRS = 300_000
#: Characters into a word up to which states are kept, and the longest run that is.
DEPTH = 5
LONGEST = 64
CHUNK = 1 << 16
END = "</w>"

# Fixed values of the tokenizer format: white space of its patterns, and its contractions.
WHITE = frozenset("\t\n\v\f\r \x85\xa0                　")
_SPACES = re.compile("[" + "".join(sorted(WHITE)) + "]+")
_ODD = re.compile("[\x1c-\x1f]")  # str.split takes these for white space
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_letters() -> list[str]:
    """The printable letter that the format writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def _kind(c: str) -> str:
    if c in WHITE:
        return "white"
    major = unicodedata.category(c)[0]
    return {"L": "letter", "N": "number"}.get(major, "other")


class Merges:
    """The merge part: states as described above, over the symbols ``x`` and ``x</w>``.

    Symbols and tokens are numbers; ``child[node]`` has the nodes below a node of the
    token trie, ``token[node]`` the token that ends there (-1: none)."""

    START = ((0, -1, 0),)

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.rank = {p: n for n, p in enumerate(pairs)}
        letters = _byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        made = {a + b for a, b in pairs}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.words: list[list[str]] = []
        for word in vocab:
            symbols = self._symbols(word)
            if len(symbols) > 1 and word not in made:
                continue
            node = 0
            for s in symbols:
                below = self.child[node]
                s = self.byte[s[0]] + 256 * (len(s) > 1)
                if s not in below:
                    below[s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = below[s]
            self.token[node] = len(self.words)
            self.words.append(symbols)
        self.pairs: dict[int, bool] = {}
        self.single: dict[int, bool] = {}

    @staticmethod
    def _symbols(word: str) -> list[str]:
        if word.endswith(END) and len(word) > len(END):
            body = word[:-len(END)]
            return [*body[:-1], body[-1] + END]
        return list(word)

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, for the few symbols of one or two tokens."""
        parts, rank = list(symbols), self.rank
        ranks = [rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), 1 << 60)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), 1 << 60)
        return parts

    def _whole(self, token: int) -> bool:
        """Is a token the encoding of its own characters?"""
        if token not in self.single:
            self.single[token] = len(self.encode(self.words[token])) == 1
        return self.single[token]

    def _follows(self, before: int, token: int, key: int) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        a, b = self.words[before], self.words[token]
        self.pairs[key] = answer = self._whole(token) and self.encode(a + b) == ["".join(a), "".join(b)]
        return answer

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """(next state, change of the count)."""
        still, last, count = [], -1, 0
        children, tokens, pairs = self.child, self.token, self.pairs
        for node, before, base in state:
            node = children[node].get(symbol)
            if node is None:
                continue
            still.append((node, before, base))
            if last < 0 and (token := tokens[node]) >= 0:
                if before < 0:
                    good = self._whole(token)
                else:
                    key = before << 20 | token
                    good = pairs.get(key)
                    if good is None:
                        good = self._follows(before, token, key)
                if good:
                    last, count = token, base + 1
        if last < 0:
            raise ValueError(f"no token ends with symbol {symbol}")
        return (*[(n, b, base - count) for n, b, base in still if children[n]], (0, last, 0)), count


class State:
    """A state of the whole transducer; ``out`` maps a character to (state, tokens)."""
    __slots__ = ("lexer", "merge", "pending", "depth", "out")

    def __init__(self, lexer: str, merge: tuple, pending: int, depth: int):
        self.lexer, self.merge, self.pending, self.depth, self.out = lexer, merge, pending, depth, {}


class Transducer:
    def __init__(self, file: str, states: int = STATES):
        spec = json.loads(file)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.most = states
        self.runs: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.table: dict[tuple, State] = {}
        self.start = self.state("start", Merges.START, -1, 0)

    def state(self, lexer: str, merge: tuple, pending: int, depth: int) -> State:
        """States this far into a word are kept; later ones are rarely met twice."""
        if depth > DEPTH:
            return State(lexer, merge, pending, depth)
        key = (lexer, merge, pending)
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = State(*key, depth)
        return found

    def _read(self, merge: tuple, pending: int, text: str) -> tuple[tuple, int, int]:
        """Put characters on a word: (merge state, last byte that waits, change of the count)."""
        n = 0
        for b in text.encode("utf-8", "surrogatepass"):
            if pending >= 0:
                merge, d = self.merges.step(merge, pending)
                n += d
            pending = b
        return merge, pending, n

    def _end(self, merge: tuple, pending: int) -> int:
        return self.merges.step(merge, pending + 256)[1] if pending >= 0 else 0

    def _word(self, word: str) -> int:
        merge, pending, n = self._read(Merges.START, -1, word)
        return n + self._end(merge, pending)

    def make(self, s: State, c: str) -> tuple[State, int]:
        """The transition of a state on a character, added to its table if the state is kept."""
        kind, lexer, n = _kind(c), s.lexer, 0
        if lexer[:1] == "'":
            to, n = self._apostrophe(lexer, c, kind)
        elif kind == lexer:  # the word goes on
            merge, pending, n = self._read(s.merge, s.pending, c)
            to = self.state(lexer, merge, pending, s.depth + 1)
        else:
            n = self._end(s.merge, s.pending)
            if kind == "white":
                to = self.start
            elif kind == "number":
                to, n = self.start, n + self._word(c)
            elif c == "'":
                to = self.state("'", Merges.START, -1, 0)
            else:
                merge, pending, more = self._read(Merges.START, -1, c)
                to, n = self.state(kind, merge, pending, 1), n + more
        if s.depth <= DEPTH and to.depth <= DEPTH:
            s.out[c] = to, n
        return to, n

    def _apostrophe(self, so_far: str, c: str, kind: str) -> tuple[State, int]:
        """After an apostrophe that opened a word, and letters that may complete a contraction."""
        grown = so_far + c
        if grown in CONTRACTIONS:
            return self.start, self._word(grown)
        if any(x.startswith(grown) for x in CONTRACTIONS):
            return self.state(grown, Merges.START, -1, 0), 0
        if len(so_far) == 1 and kind == "other":  # the apostrophe begins a run of marks
            merge, pending, n = self._read(Merges.START, -1, "'")
            base = self.state("other", merge, pending, 1)
        elif len(so_far) == 1:  # it is a mark of its own
            base, n = self.start, self._word("'")
        else:  # so it is here, and the letters after it begin a word
            merge, pending, n = self._read(Merges.START, -1, so_far[1:])
            base, n = self.state("letter", merge, pending, 1), n + self._word("'")
        to, more = base.out.get(c) or self.make(base, c)
        return to, n + more

    def _run(self, run: str) -> int:
        """Tokens of a run of characters without white space, from the start state back to it."""
        n = self.older.get(run)
        if n is None:
            s, n = self.start, 0
            for c in run + " ":
                found = s.out.get(c)
                s, d = found if found is not None else self.make(s, c)
                n += d
            if len(self.table) > self.most:
                self.reset()
        if len(run) <= LONGEST:
            if len(self.runs) >= RUNS:
                self.older, self.runs = self.runs, {}
            self.runs[run] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a text that starts and ends between words. A run that was met before is
        one transition from the start state to itself, with the tokens of the whole run."""
        runs = text.split() if not _ODD.search(text) else _SPACES.split(text)
        counts = list(map(self.runs.get, runs))
        try:
            return sum(counts)
        except TypeError:
            return sum(self._run(r) if n is None else n for r, n in zip(runs, counts) if r)

    # chunk maps: (head, None, "") without white space, else (head, tokens, tail)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        first = _SPACES.search(chunk)
        if first is None:
            return chunk, None, ""
        last = len(chunk) - _SPACES.search(chunk[::-1]).start()
        return chunk[:first.start()], self.tokens(chunk[first.start():last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First a, then b."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.tokens(a[2] + b[0]) + b[1], b[2])

    def count_segment(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        maps = [self.chunk_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.tokens(head) + (n or 0) + self.tokens(tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        segments, n = [text], 0
        for s in self.special:
            if s in text:
                cut = [x.split(s) for x in segments]
                n += sum(len(x) - 1 for x in cut)
                segments = [y for x in cut for y in x]
        return n + sum(self.count_segment(x) for x in segments if x)


_made: dict[int, Transducer] = {}


def _transducer(file) -> Transducer:
    """One transducer for each worker process, kept from task to task."""
    if hash(file) not in _made:
        _made.clear()
        _made[hash(file)] = Transducer(file)
    return _made[hash(file)]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """The columns of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's copy, 2 MB; tasks get it by broadcast
        shared = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")

    def run(batches):
        t = _transducer(shared.value)
        for batch in batches:
            n = pa.array([t.count(x.as_py()) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "n_tokens"])

    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.withColumn("n_bytes", bytes_)
    rest = [c for c in out.columns if c != "text"]
    schema = T.StructType([*out.schema.fields, T.StructField("n_tokens", T.LongType())])
    return out.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word-end BPE vocabulary of 49k."""
    import public_tokenizers
    from sentiscope.llm.common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
