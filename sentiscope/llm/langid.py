"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is given (a sentencepiece file; its segmentation is not used).
Each language has a probability for every piece, and a word's probability in
a language is the sum over all ways to cut it into pieces of the product of their
probabilities, which the forward algorithm gives in one pass over its characters. A
text's score is the sum of the logarithms over its words; the language with the largest
wins, with its share of the total probability as ``score``.

The probabilities are fitted by expectation maximisation (forward and backward, expected piece
counts), from a common uniform start, smoothed towards the counts of all languages
together. Fitting takes at most ``SAMPLE`` documents of each language, those with the smallest
hash of the id (a documented bound): Spark counts their words, one task fits, and the
model is one number for each piece and language whatever the input. Scoring is one pass
over all texts without a shuffle, a batch's distinct words at a time, with a bounded table of
the words met last.

Words are runs between white space, led by the vocabulary's word mark; a run over ``LONGEST``
characters is scored in stretches of that length. A character without a piece counts as
one unknown piece. Sums are scaled by ``exp(SCALE)`` a character; a word whose sum still
leaves the range of float64 in some language, as a run of characters that fitting has not seen
does, is summed in logarithms.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every
text if there is nothing to learn from; languages that tie go by name; rows with a null language
or text are not learned from; repeated rows count as often as they occur; an empty table
gives an empty table; ``lang_pred`` and ``score`` replace columns of these names, others
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sentiscope.llm import words as K
from sentiscope.llm.common import fold, table

MARK = "▁"
SAMPLE = 400
ROUNDS = 4
LONGEST = 64
PRIOR = 200.0
SCALE = 6.0
SEED = 11
UNDETERMINED = "und"
#: Words scored at once, and slots of a worker's table of words.
BLOCK = 16_384
#: A smaller scaled total may have lost sums below float64's range, and is made again in
#: logarithms. Such a sum is under 3e-308 and grows by at most exp(SCALE * LONGEST) * LONGEST,
#: 4e168, to the word's end, so that above this all of them are under 1e-16 of the total.
FLOOR = 1e-120
SLOTS = 1 << 18


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file that stand for text."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Pieces:
    """A vocabulary, found by hashes of characters, one sorted table for each length."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.constants = K.constants(self.longest, 500)
        self.tables = []
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            chars = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, n)
            with np.errstate(over="ignore"):
                h = (K.mix(chars.ravel().astype(np.uint64) + np.uint64(1)).reshape(-1, n) * self.constants[:n]).sum(1, dtype=np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], ids[order]))


class Lattice:
    """All pieces inside a list of words: arcs ordered by where they end, then by word."""

    def __init__(self, pieces: Pieces, words: list[str]):
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(chars)) - np.repeat(ends - size, size)
        left = np.repeat(size, size) - place  # characters from here to the word's end
        c = K.mix(chars + np.uint64(1))
        h = np.zeros(len(chars), np.uint64)
        arcs = []
        with np.errstate(over="ignore"):
            for n, (known, ids) in enumerate(pieces.tables, 1):
                if n > 1:
                    h = h[:-1] if len(h) == len(chars) - n + 2 else h
                h = h[:max(0, len(chars) - n + 1)] + c[n - 1:] * pieces.constants[n - 1] if len(chars) >= n else h[:0]
                at = np.flatnonzero(left[:len(h)] >= n)
                if not len(at):
                    break
                k = np.minimum(np.searchsorted(known, h[at]), max(0, len(known) - 1))
                good = known[k] == h[at] if len(known) else np.zeros(len(at), bool)
                if n == 1:
                    ident = np.where(good, ids[k] if len(ids) else 0, pieces.size)
                    arcs.append((at, np.full(len(at), 1), ident))
                else:
                    arcs.append((at[good], np.full(int(good.sum()), n), ids[k[good]]))
        start = np.concatenate([a[0] for a in arcs]) if arcs else np.zeros(0, np.int64)
        length = np.concatenate([a[1] for a in arcs]) if arcs else np.zeros(0, np.int64)
        ident = np.concatenate([a[2] for a in arcs]) if arcs else np.zeros(0, np.int64)
        end = place[start] + length
        order = np.lexsort((word[start], end))
        self.n, self.size = len(words), size
        self.word, self.end = word[start][order], end[order]
        self.length, self.ident = length[order], ident[order]
        first = np.append(0, np.cumsum(size + 1))  # a cell before each character and one at the end
        self.cells, self.first = int(first[-1]), first[:-1]
        self.into = self.first[self.word] + self.end
        self.out_of = self.into - self.length
        self.steps = np.searchsorted(self.end, np.arange(1, int(size.max(initial=0)) + 2))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Scaled sums over all segmentations up to each cell; ``weight`` is by arc and language."""
        alpha = np.zeros((self.cells, weight.shape[1]))
        alpha[self.first] = 1
        for a, b in zip(self.steps, self.steps[1:]):
            if a < b:
                into = self.into[a:b]
                head = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
                alpha[into[head]] = np.add.reduceat(alpha[self.out_of[a:b]] * weight[a:b], head, axis=0)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.cells, weight.shape[1]))
        beta[self.first + self.size] = 1
        # arcs that leave the cells at a distance from their word's start, the last cells first
        place = self.end - self.length
        order = np.lexsort((self.out_of, -place))
        cuts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)) if len(order) else order
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            k = order[a:b]
            head = np.flatnonzero(np.append(True, np.diff(self.out_of[k]) != 0))
            beta[self.out_of[k][head]] = np.add.reduceat(beta[self.into[k]] * weight[k], head, axis=0)
        return beta

    def log_forward(self, weight: np.ndarray) -> np.ndarray:
        """``forward`` in logarithms, of weights in logarithms."""
        alpha = np.full((self.cells, weight.shape[1]), -np.inf)
        alpha[self.first] = 0
        for a, b in zip(self.steps, self.steps[1:]):
            if a < b:
                into = self.into[a:b]
                head = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
                alpha[into[head]] = np.logaddexp.reduceat(alpha[self.out_of[a:b]] + weight[a:b], head, axis=0)
        return alpha

    def log_backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.full((self.cells, weight.shape[1]), -np.inf)
        beta[self.first + self.size] = 0
        place = self.end - self.length
        order = np.lexsort((self.out_of, -place))
        cuts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)) if len(order) else order
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            k = order[a:b]
            head = np.flatnonzero(np.append(True, np.diff(self.out_of[k]) != 0))
            beta[self.out_of[k][head]] = np.logaddexp.reduceat(beta[self.into[k]] + weight[k], head, axis=0)
        return beta

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.first + self.size]


class Model:
    """``p[piece, language]``; the last piece is the unknown character."""

    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p

    def weights(self, lattice: Lattice) -> np.ndarray:
        return self.p[lattice.ident] * np.exp(SCALE * lattice.length)[:, None]

    def log_weights(self, lattice: Lattice) -> np.ndarray:
        return np.log(self.p)[lattice.ident] + SCALE * lattice.length[:, None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's probability in each language."""
        out = np.empty((len(words), len(self.languages)))
        for i in range(0, len(words), BLOCK):
            lat = Lattice(self.pieces, words[i:i + BLOCK])
            total = lat.total(lat.forward(self.weights(lat)))
            small = low(total)
            made = np.log(np.where(small[:, None], 1, total))
            if small.any():
                lat_low = Lattice(self.pieces, [words[i + k] for k in np.flatnonzero(small)])
                made[small] = lat_low.total(lat_low.log_forward(self.log_weights(lat_low)))
            out[i:i + BLOCK] = made - SCALE * lat.size[:, None]
        return out


def low(total: np.ndarray) -> np.ndarray:
    """Words whose scaled total in any language is too small to be right."""
    return ~(total >= FLOOR).all(1)


def stretches(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i:i + LONGEST] for i in range(0, len(marked), LONGEST)]


def fit(pieces: Pieces, languages: list[str], words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over words with their count in each language."""
    v, n = pieces.size + 1, len(languages)
    m = Model(pieces, languages, np.full((v, n), 1 / v))
    for _ in range(rounds):
        expected = np.zeros((v, n))
        for i in range(0, len(words), BLOCK):
            lat = Lattice(pieces, words[i:i + BLOCK])
            w = m.weights(lat)
            alpha, beta = lat.forward(w), lat.backward(w)
            total = lat.total(alpha)
            small = low(total)
            share = np.where(small[:, None], 0, counts[i:i + BLOCK]) / np.where(small[:, None], 1, total)
            use = alpha[lat.out_of] * w * beta[lat.into] * share[lat.word]
            for k in range(n):
                expected[:, k] += np.bincount(lat.ident, use[:, k], minlength=v)
            if small.any():
                at = i + np.flatnonzero(small)
                lat = Lattice(pieces, [words[j] for j in at])
                w = m.log_weights(lat)
                alpha, beta = lat.log_forward(w), lat.log_backward(w)
                use = np.exp(alpha[lat.out_of] + w + beta[lat.into] - lat.total(alpha)[lat.word]) * counts[at][lat.word]
                for k in range(n):
                    expected[:, k] += np.bincount(lat.ident, use[:, k], minlength=v)
        together = expected.sum(1) + 0.01
        smooth = expected + PRIOR * (together / together.sum())[:, None]
        m = Model(pieces, languages, smooth / smooth.sum(0))
    return m


#: Times the sample of a language that is expected to pass the first cut.
CUT = 4


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """``lang`` and ``text`` of at most ``sample`` documents of each language, the smallest by a hash of id and text.

    Repeated rows count as one. Rows are cut by their hash before they are ranked, so the ranking meets some ``CUT`` times the
    sample of a language, however many rows it has.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "doc_id", "text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    least = F.lit(float(-2 ** 63)) + F.lit(float(2 ** 64)) * F.least(F.lit(1.0), F.lit(float(CUT * sample)) / F.col("n"))
    cut = (known.join(F.broadcast(sizes), "lang")  # a row for each language: the model itself has a column for each
           .where(F.col("h").cast("double") <= least)
           .groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return cut.withColumn("n", rank).where(F.col("n") <= sample).select("lang", "text")


def train(docs: DataFrame, vocabulary: list[str], sample: int = SAMPLE) -> Model | None:
    """A model of the languages of ``docs``, from at most ``sample`` documents of each."""
    spark = docs.sparkSession
    texts = sampled(docs, sample)
    counts = (texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
              .groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")))
    shared = spark.sparkContext.broadcast(vocabulary)

    def together(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("word", "ascending"), ("lang", "ascending")])
        languages = sorted(set(rows.column("lang").to_pylist()))
        at = {x: i for i, x in enumerate(languages)}
        words, row = [], {}
        cells = []
        for word, lang, n in zip(*(rows.column(c).to_pylist() for c in ("word", "lang", "n"))):
            for part in stretches(word):
                if part not in row:
                    row[part] = len(words)
                    words.append(part)
                cells.append((row[part], at[lang], n))
        counts = np.zeros((len(words), len(languages)))
        if cells:
            r, k, n = np.array(cells).T
            np.add.at(counts, (r, k), n)
        m = fit(Pieces(shared.value), languages, words, counts)
        return pa.table({"languages": pa.array([languages], pa.list_(pa.string())),
                         "p": pa.array([m.p.astype(np.float32).tobytes()], pa.binary())})

    found = counts.groupBy(F.lit(1).alias("one")).applyInArrow(together, "languages array<string>, p binary").collect()
    if not found:
        return None
    languages = list(found[0].languages)
    return Model(Pieces(vocabulary), languages, np.frombuffer(found[0].p, np.float32).reshape(-1, len(languages)).astype(np.float64))


class _Words:
    """Scores of the words met last, in a table of fixed size; a word's slot is its hash."""

    def __init__(self, model: Model):
        self.model = model
        self.key = np.zeros(SLOTS, np.uint64)
        self.value = np.zeros((SLOTS, len(model.languages)))

    def scores(self, h: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Scores of the distinct words ``h``; the k-th is the word ``first[k]`` of the piece."""
        slot = (h % np.uint64(SLOTS)).astype(np.int64)
        known = self.key[slot] == h
        out = np.empty((len(h), self.value.shape[1]))
        out[known] = self.value[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            parts = [stretches(w) for w in text]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            made = self.model.word_scores([p for x in parts for p in x])
            out[new] = np.add.reduceat(made, np.cumsum(n) - n, axis=0)
            self.key[slot[new]], self.value[slot[new]] = h[new], out[new]
        return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        met = _Words(m)
        for batch in batches:
            for piece in K.pieces(batch):
                first, starts, ends, h, data = K.words(piece.column("text"))
                distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
                total = np.zeros((piece.num_rows, len(m.languages)))
                has = np.diff(first) > 0
                if len(h):
                    total[has] = np.add.reduceat(met.scores(distinct, at, starts, ends, data)[back], first[:-1][has], axis=0)
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(m.languages).take(pa.array(best)), pa.array(score)],
                    names=[*piece.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.mapInArrow(run, schema)
    return (out.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNDETERMINED))
            .withColumn("score", F.when(letters, F.col("score")).otherwise(0.0)))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; the held-out fold is not learned from."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(4) != 2), read_pieces(str(public_tokenizers.path("piece_bpe_32k.model"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
