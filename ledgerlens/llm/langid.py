"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces gives the units; each language has a probability per piece. A word's
probability under a language is the sum over all its segmentations into pieces (a forward pass), a text's the product
over its words. The piece probabilities are fitted by expectation-maximisation: the forward-backward
pass gives the expected count of each piece in each language.

Words are runs of letters in lower case, so a text's score needs each distinct word's forward pass only
once per batch. Passes run over many words side by side, for all languages at once.

Fitting takes the labelled rows up to ``MAX_FIT_ROWS`` (a documented bound): every language has an equal share of them,
drawn by a hash of the id, and languages with fewer rows are taken whole, so each language with a letter in its rows is
learned at every table size. Word counts and expected counts are aggregated by Spark, and what reaches the driver is one
number per piece and language.

Edge cases: text that is null or has no letter is ``und`` with score 0; without any labelled row every text is ``und``; one language
gets score 1; ties go to the smallest language; repeated rows score alike; letters outside the vocabulary are single
pieces of a fixed small probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, no_text, text_batches, without

VOCABULARY = "piece_bpe_32k.model"
MAX_FIT_ROWS = 8_000
#: Words of one block take so many characters (or one longer word alone); a longer word is scored in stretches of so many.
CELLS, STRETCH = 1 << 18, 1 << 14
ROUNDS = 4
PRIOR = 0.05
UNKNOWN = -16.0
CACHE = 300_000
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_START = "▁"
_worker: dict = {}


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path or public_tokenizers.path(VOCABULARY)))
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(x for x in found if (x[1:] if x[0] == _START else x).isalpha())


class Pieces:
    """Finds pieces in words laid out as rows of code points."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        number = {p: i for i, p in enumerate(pieces)}
        longer = {p[:k] for p in pieces for k in range(1, len(p))}
        entries = sorted(longer | number.keys())        # pieces, and what pieces begin with
        self.piece = np.array([number.get(e, -1) for e in entries] + [-1], np.int32)
        self.longer = np.array([e in longer for e in entries] + [False], bool)
        key = np.array([self._key(e) for e in entries], np.uint64)
        self.levels = []
        left = np.arange(len(entries))
        for shift in (43, 44, 45, 46):          # slots taken twice go on to the next, smaller table
            slot = (key[left] * _MIX >> np.uint64(shift)).astype(np.int64)
            table = np.full(1 << (64 - shift), -1, np.int32)
            table[slot] = left
            self.levels.append((np.uint64(shift), table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("pieces can't be told apart")
        self.key = np.append(key, np.uint64(0))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        return self.piece[self.entries(key)]

    def entries(self, key: np.ndarray) -> np.ndarray:
        """Places in ``piece`` and ``longer``, -1 for none."""
        out, mixed = np.full(len(key), -1, np.int32), key * _MIX
        for shift, table in self.levels:
            at = table[(mixed >> shift).astype(np.int64)]
            out = np.where((out < 0) & (self.key[at] == key), at, out)
        return out


def pieces(path: str | None = None) -> Pieces:
    if ("pieces", path) not in _worker:
        _worker["pieces", path] = Pieces(vocabulary(path))
    return _worker["pieces", path]


def _blocks(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words, short ones first, in blocks of about ``CELLS`` characters."""
    held: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if held and (len(held) + 1) * (len(words[i]) + 1) > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def _spans(marked: list[str], book: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the marked words, and found[i, end, n - 1]: the piece of n characters that ends there."""
    size = np.array([len(w) for w in marked])
    width = int(size.max())
    code = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass"),
                         np.uint32).reshape(len(marked), width).astype(np.uint64) + np.uint64(1)
    most = min(book.longest, width)
    found = np.full((len(marked), width, most), -1, np.int32)
    flat, out = code.ravel(), found.reshape(-1, most)
    at = np.flatnonzero(flat != 1)              # where a piece may begin; only what begins some piece is followed
    h = flat[at]
    for n in range(1, most + 1):
        if n > 1:
            room = at % width + n <= width
            at, h = at[room], h[room]
            h = h * _BASE + flat[at + n - 1]
        entry = book.entries(h)
        piece, more = book.piece[entry], book.longer[entry]
        got = piece >= 0
        out[at[got] + n - 1, n - 1] = piece[got]
        at, h = at[more], h[more]
        if not len(at):
            break
    return size, found


def _forward(found: np.ndarray, logp: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """alpha[word, place, language]: log sum over the segmentations of the characters up to the place. ``logp`` has a last row of
    -inf, for no piece; a single character without a piece has ``UNKNOWN``. ``before`` has alpha at the places before the first
    character, as many as the longest piece found has characters; a word's start has 0 there and nothing before it."""
    n, width, most = found.shape
    if before is None:
        before = np.full((n, most, logp.shape[1]), -np.inf)
        before[:, -1] = 0
    alpha = np.concatenate([before, np.full((n, width, logp.shape[1]), -np.inf)], axis=1)
    for end in range(width):
        at = most - 1 + end                     # of the place before this character
        total = alpha[:, at] + np.where(found[:, end, 0, None] < 0, UNKNOWN, logp[found[:, end, 0]])
        rows, more = np.nonzero(found[:, end, 1:] >= 0)
        for k in range(1, most) if len(rows) else ():
            r = rows[more == k - 1]
            if len(r):
                total[r] = np.logaddexp(total[r], alpha[r, at - k] + logp[found[r, end, k]])
        alpha[:, at + 1] = total
    return alpha[:, most - 1:]


def _long_score(word: str, logp: np.ndarray, book: Pieces) -> np.ndarray:
    """The forward pass over one word, a stretch at a time: the last values are carried on, so segmentations run over the borders."""
    marked, carry = _START + word, None
    for at in range(0, len(marked), STRETCH):
        back = min(at, book.longest - 1)        # characters that pieces ending here may begin with
        _, found = _spans([marked[at - back:at + STRETCH]], book)
        found = found[:, back:]
        if carry is not None and found.shape[2] > carry.shape[1]:
            raise ValueError("stretches are shorter than the longest piece")
        alpha = _forward(found, logp, None if carry is None else carry[:, carry.shape[1] - found.shape[2]:])
        known = alpha if carry is None else np.concatenate([carry[:, :-1], alpha], axis=1)
        pad = np.full((1, book.longest, logp.shape[1]), -np.inf)
        carry = np.concatenate([pad, known], axis=1)[:, -book.longest:]
    return carry[0, -1]


def word_scores(words: list[str], logp: np.ndarray, book: Pieces) -> np.ndarray:
    """Log probability of each word under each language."""
    out = np.zeros((len(words), logp.shape[1]))
    for block in _blocks(words):
        if len(words[block[0]]) >= STRETCH:
            for i in block:
                out[i] = _long_score(words[i], logp, book)
            continue
        size, found = _spans([_START + words[i] for i in block], book)
        out[block] = _forward(found, logp)[np.arange(len(size)), size]
    return out


def expected_counts(words: list[str], n: np.ndarray, lang: np.ndarray, logp: np.ndarray, book: Pieces) -> np.ndarray:
    """Expected count of every piece in every language, over words with a count and a language each. Memory follows the longest
    word (some 100 bytes a letter)."""
    total = np.zeros(logp.shape)
    for x in np.unique(lang):
        mine = np.flatnonzero(lang == x)
        for block in _blocks([words[i] for i in mine]):
            rows = mine[block]
            weight = n[rows]
            s, f = _spans([_START + words[i] for i in rows], book)
            p = logp[:, x:x + 1]
            alpha = _forward(f, p)[:, :, 0]
            whole = alpha[np.arange(len(s)), s]
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(s)), s] = 0
            some = (f >= 0).any(0)
            some[:, 0] = True
            for end in range(f.shape[1], 0, -1):
                for j in np.flatnonzero(some[end - 1, :end]):
                    piece = f[:, end - 1, j]
                    step = p[piece, 0]
                    if j == 0:
                        step = np.where(piece < 0, UNKNOWN, step)
                    through = step + beta[:, end]
                    beta[:, end - 1 - j] = np.logaddexp(beta[:, end - 1 - j], through)
                    share = np.exp(alpha[:, end - 1 - j] + through - whole) * weight
                    ok = (piece >= 0) & (share > 0)
                    np.add.at(total[:, x], piece[ok], share[ok])
    return total


def _letters(text: pa.Array) -> pa.ListArray:
    """The words of each text: runs of letters, in lower case."""
    low = pc.utf8_lower(text)
    return pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}]+", " "), " "), " ")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                           pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "n"])
    for b in batches:
        for lang, words in zip(b.column("lang").to_pylist(), _letters(b.column("t")).to_pylist()):
            held.update((lang, w) for w in words if w)
        if len(held) > CACHE:
            yield flush()
            held.clear()
    if held:
        yield flush()


def shares(rows: dict[str, int], total: int) -> dict[str, int]:
    """How many rows of each language to fit on: equal shares of ``total``, what small languages leave goes to the others; one row at least."""
    out, left = {}, total
    for k, x in enumerate(sorted(rows, key=lambda x: (rows[x], x))):
        out[x] = min(rows[x], max(1, left // (len(rows) - k)))
        left -= out[x]
    return out


def _fit_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the rows (i, t, lang), by language."""
    spread = 1 << 40
    rows = rows.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(spread)))
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    if sum(r["n"] for r in found.values()) <= max_rows:
        return rows
    take = shares({x: r["n"] for x, r in found.items()}, max_rows)
    cuts = [(x, max(take[x] * spread // r["n"], r["least"] + 1)) for x, r in found.items()]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(cuts, "lang string, cut long")), "lang").where("h < cut")


def train(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS,
          rounds: int = ROUNDS) -> dict:
    """``langs`` (sorted) and ``logp`` (pieces + 1, langs). ``df`` has the rows to learn from."""
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(F.col(id_col).cast("string").alias("i"), no_text(text).alias("t"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    rows = _fit_rows(rows.where(F.col("t").rlike(r"\p{L}")), max_rows)     # rows without a letter teach nothing
    words = checkpoint(rows.select("t", "lang").mapInArrow(_word_counts, "lang string, word string, n long")
                       .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(size)
    book = pieces()
    if not langs:
        return {"langs": [], "logp": np.zeros((book.n + 1, 0))}
    place = {x: i for i, x in enumerate(langs)}
    logp = np.full((book.n + 1, len(langs)), -np.log(book.n))
    logp[-1] = -np.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, total = shared.value, None
            for pdf in batches:
                part = expected_counts(pdf["word"].tolist(), pdf["n"].to_numpy(float), pdf["lang"].map(place).to_numpy(int), p, pieces())
                total = part if total is None else total + part
            if total is not None:
                at, k = np.nonzero(total)
                yield pd.DataFrame({"piece": at, "k": k, "n": total[at, k]})
        got = (words.mapInPandas(expect, "piece long, k int, n double").groupBy("piece", "k")
               .agg(F.round(F.sum("n"), 6).alias("n")).toPandas())
        count = np.zeros((book.n, len(langs)))
        count[got["piece"], got["k"]] = got["n"]
        logp = np.vstack([np.log((count + PRIOR) / (count.sum(0) + PRIOR * book.n)), np.full((1, len(langs)), -np.inf)])
    return {"langs": langs, "logp": logp}


def predict(df: DataFrame, model: dict, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the most likely language and its posterior under equal priors; keeps all columns, but given columns of these names are
    replaced."""
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = without(df, out, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value["langs"], shared.value["logp"]
        known: dict[str, int] = {}
        table = np.zeros((1024, len(langs)))
        for b in batches:
            lists = _letters(b.column(text))
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            if len(known) > CACHE:
                known.clear()
            new = [w for w in names if w and w not in known]
            if new and langs:
                start = len(known)
                known.update(zip(new, range(start, start + len(new))))
                while len(table) < len(known):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[start:len(known)] = word_scores(new, logp, pieces())
            values = np.array([table[known[w]] if w and langs else np.zeros(len(langs)) for w in names]).reshape(len(names), len(langs))
            letters = np.array([bool(w) for w in names], bool)
            at = coded.indices.to_numpy()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            name, prob = [], []
            for i in range(len(lists)):
                own = at[ends[i]:ends[i + 1]] if lists[i].is_valid else at[:0]
                if not langs or not letters[own].any():
                    name.append("und")
                    prob.append(0.0)
                    continue
                z = values[own].sum(0)
                k = int(np.argmax(z))
                name.append(langs[k])
                prob.append(float(1 / np.exp(z - z[k]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(name, pa.string()), pa.array(prob, pa.float64())],
                                             names=[*rest, out, score])
    fields = [*(df.schema[c] for c in rest), T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]
    return df.mapInArrow(run, T.StructType(fields))
