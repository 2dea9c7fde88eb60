"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has, for every depth 0 to ``DEPTH``, a node named by the last bytes and
the bits so far, with a Krichevsky-Trofimov estimate from its counts in the training texts. A node's weighted
probability is half its own estimate and half the product of the nodes one byte deeper, so the mixture runs over all
prunings of the context tree. The trained tree then gives every byte after every context a probability:
along the path from the root, each node's own estimate has its posterior weight and the deeper nodes the rest; a context that
was never seen leaves one half for each bit. A text is framed by a mark that no UTF-8 text holds, which also ends it.

How it runs: one pass over the training texts counts grams (context and next byte) and words, pre-aggregated per task. The
tree's levels from depth ``SPLIT`` down are weighted by Spark, by the last ``SPLIT`` bytes, many such subtrees at a time;
their sums give the levels above, whose nodes (at most 255 for each context of two bytes) go to every task. The log
probabilities of the most frequent grams, at most ``FREQUENT_GRAMS``, are a broadcast table that scores most places of a text;
all other grams, seen or not, are shuffled as (document, gram, count), meet the tree again, and are added by join. Words go
the same way: the ``FREQUENT`` most frequent from a table, all others by join. Tables thus have a fixed bound, and
nothing is left out or approximated.

Edge cases: null text counts as empty (its code is the end mark's); a null id is neither learned from nor held out; repeated
rows count and score as rows of their own; without training rows each bit costs one bit; very long texts are scored in
windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, no_text, stored, text_batches

DEPTH, SPLIT = 5, 3
FREQUENT, FREQUENT_GRAMS = 1 << 17, 1 << 20
BLOCK_ROWS = 1 << 16
HELD_WORDS, HELD_GRAMS = 300_000, 1 << 20
WINDOW = 1 << 19
MARK = b"\xff"
END_WORD = b""
HALF = np.log(0.5)


# --- counting -------------------------------------------------------------

def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with ``DEPTH`` marks before each and one after; first place and length + 1 of each."""
    gap = MARK * (DEPTH + 1)
    buf = np.frombuffer(MARK * DEPTH + gap.join(texts) + MARK, np.uint8)
    size = np.array([len(t) for t in texts], np.int64) + 1
    first = DEPTH + np.concatenate([[0], np.cumsum(size[:-1] + DEPTH)]).astype(np.int64)
    return buf, first, size


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and next byte as one number, count) over whole texts."""
    buf, first, size = framed(texts)
    scored = np.zeros(len(buf) + 1, np.int8)
    np.add.at(scored, first, 1)
    np.add.at(scored, first + size, -1)
    scored = np.cumsum(scored[:-1], dtype=np.int8).astype(bool)
    keys, ns = [], []
    for at in range(DEPTH, len(buf), WINDOW):
        part = buf[at - DEPTH: at + WINDOW].astype(np.int64)
        n = len(part) - DEPTH
        key = np.zeros(n, np.int64)
        for j in range(DEPTH + 1):
            key = (key << 8) | part[j:j + n]
        k, c = np.unique(key[scored[at:at + n]], return_counts=True)
        keys.append(k)
        ns.append(c)
    return _merge(keys, ns)


def _merge(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(ns), minlength=len(k)).astype(np.int64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(grams, words, n):
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())],
                                          names=["gram", "word", "n"])

    def of_words():
        return out([None] * len(words), list(words), list(words.values()))
    words: Counter = Counter()
    keys: list = []
    ns: list = []
    for b in batches:
        texts = b.column("t").cast(pa.binary()).to_pylist()
        if not texts:
            continue
        for t in texts:
            words.update(words_of(t))
            words[END_WORD] += 1
            if len(words) > HELD_WORDS:
                yield of_words()
                words.clear()
        k, n = gram_counts(texts)
        keys.append(k)
        ns.append(n)
        if sum(map(len, keys)) > HELD_GRAMS:
            k, n = _merge(keys, ns)
            keys, ns = [k], [n]
            if len(k) > HELD_GRAMS // 2:
                yield out(k, [None] * len(k), n)
                keys, ns = [], []
    yield of_words()
    k, n = _merge(keys, ns)
    yield out(k, [None] * len(k), n)


# --- the tree ---------------------------------------------------------------

def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5: Stirling's series eight places up."""
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - r / 1260) * r) / y - np.log(low)


def log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.zeros(zero.shape)
    some = (zero + one) > 0
    a, b = zero[some], one[some]
    out[some] = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)
    return out


def kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (zero + one + 1)


def weigh(own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a node, and the posterior weight of its own estimate."""
    both = np.logaddexp(own, deeper) + HALF
    return both, np.exp(own + HALF - both)


def bit_nodes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8, m) node keys on the way to each gram's byte, and the bits taken there. A key is the context and, in the
    last byte, the bits so far behind a leading one."""
    byte = gram & 255
    step = np.arange(8)[:, None]
    return (gram >> 8 << 8) | (1 << step) | (byte >> (8 - step)), (byte >> (7 - step)) & 1


def shorten(key: np.ndarray, depth: int) -> np.ndarray:
    """The same nodes under the last ``depth`` bytes of their contexts."""
    return ((key >> 8) & ((1 << 8 * depth) - 1)) << 8 | (key & 255)


def _sums(at: np.ndarray, n: int, *weights: np.ndarray) -> tuple:
    return tuple(np.bincount(at, weights=w, minlength=n) for w in weights)


class Level:
    """Nodes of one depth: sorted keys, log weighted probability, own weight, estimate, and the place of each one's
    parent in the level above (set when that is made). ``base`` and ``rest`` give the tree's probability of a
    one as base + rest * (probability one byte deeper)."""

    def __init__(self, key, zero, one, deeper=None):
        self.key, self.zero, self.one = key, zero, one
        self.kt = kt(zero, one)
        own = log_kt(zero, one)
        self.both, self.own = (own, np.ones(len(key))) if deeper is None else weigh(own, deeper)
        self.up = self.base = self.rest = None

    def above(self, depth: int) -> tuple:
        """Keys and sums (zeros, ones, log weighted probabilities) of the parents."""
        key, self.up = np.unique(shorten(self.key, depth), return_inverse=True)
        return key, *_sums(self.up, len(key), self.zero, self.one, self.both)

    def mix(self, base, rest) -> None:
        self.base, self.rest = base + rest * self.own * self.kt, rest * (1 - self.own)


def levels(gram: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels ``DEPTH`` to ``SPLIT`` of whole subtrees, deepest first."""
    keys, bit = bit_nodes(gram)
    key, at = np.unique(keys.ravel(), return_inverse=True)
    w = np.broadcast_to(n, keys.shape).ravel()
    bit = bit.ravel()
    out = [Level(key, *_sums(at, len(key), w * (1 - bit), w * bit))]
    for depth in range(DEPTH - 1, SPLIT - 1, -1):
        out.append(Level(*out[-1].above(depth)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (gram, n), sorted by subtree, in blocks of whole subtrees."""
    held: list[np.ndarray] = []
    size, mask = 0, (1 << 8 * (SPLIT + 1)) - 256
    for b in batches:
        if not b.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1))
        size += b.num_rows
        if size >= BLOCK_ROWS:
            rows = np.concatenate(held)
            tree = rows[:, 0] & mask
            cut = int(np.searchsorted(tree == tree[-1], True)) if tree[0] != tree[-1] else 0
            if cut:
                yield rows[:cut]
            held, size = [rows[cut:]], 0
    if held:
        yield np.concatenate(held)


def _by_subtree(grams: DataFrame) -> DataFrame:
    tree = F.col("gram").bitwiseAND(F.lit((1 << 8 * (SPLIT + 1)) - 256))
    return grams.select("gram", "n", tree.alias("tree")).repartition("tree").sortWithinPartitions("tree").select("gram", "n")


def _subtree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        parts = levels(rows[:, 0], rows[:, 1])[-1].above(SPLIT - 1)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["key", "zero", "one", "deeper"])


def top_levels(grams: DataFrame) -> list[Level]:
    """The levels above ``SPLIT``, the root first; their nodes are at most 255 for each context of ``SPLIT`` - 1 bytes."""
    sums = (_by_subtree(grams).mapInArrow(_subtree_sums, "key long, zero double, one double, deeper double")
            .groupBy("key").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("deeper").alias("deeper"))
            .toArrow())
    key, *rest = (sums.column(c).to_numpy() for c in ("key", "zero", "one", "deeper"))
    order = np.argsort(key)
    out = [Level(key[order], *(r[order] for r in rest))]
    for depth in range(SPLIT - 2, -1, -1):
        out.append(Level(*out[-1].above(depth)))
    out[-1].mix(0.0, 1.0)
    for i in range(len(out) - 2, -1, -1):
        out[i].mix(out[i + 1].base[out[i].up], out[i + 1].rest[out[i].up])
    return out[::-1]


def gram_scores(query: np.ndarray, gram: np.ndarray, n: np.ndarray, top: list[Level]) -> np.ndarray:
    """Log10 probability of each queried gram's byte after its context, from the subtrees of ``gram`` (which are all that
    the queries need) and the levels above."""
    found = levels(gram, n) if len(gram) else []
    above = top[-1]
    if found:
        at = np.searchsorted(above.key, shorten(found[-1].key, SPLIT - 1))
        found[-1].mix(above.base[at], above.rest[at])
        for i in range(len(found) - 2, -1, -1):
            found[i].mix(found[i + 1].base[found[i].up], found[i + 1].rest[found[i].up])
    keys, bit = bit_nodes(query)
    p, todo = np.full(keys.size, 0.5), np.arange(keys.size)
    for depth, level in [*zip(range(DEPTH, SPLIT - 1, -1), found), *zip(range(SPLIT - 1, -1, -1), top[::-1])]:
        if not len(level.key):
            continue
        key = shorten(keys.ravel()[todo], depth)
        at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
        hit = level.key[at] == key
        p[todo[hit]] = level.base[at[hit]] + level.rest[at[hit]] * 0.5
        todo = todo[~hit]
    p = p.reshape(keys.shape)
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(0)


def _score_grams(top: Broadcast, least: int):
    """Scores the rows with count 0, or with at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            gram, n = rows[:, 0], rows[:, 1]
            query = gram[(n == 0) | (n >= least)]
            seen = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(gram_scores(query, gram[seen], n[seen], top.value))], names=["gram", "lp"])
    return run


# --- scoring ---------------------------------------------------------------

class GramTable:
    """Values of known grams, found by hashing without a loop over places."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.gram, self.value, self.tables = gram, value.astype(np.float32), []
        left, width = np.arange(len(gram)), max(10, int(4 * len(gram)).bit_length())
        mix = 0x9E3779B97F4A7C15
        while len(left):
            slot = self._slot(gram[left], mix, width)
            table = np.full(1 << width, -1, np.int32)
            table[slot] = left
            self.tables.append((mix, width, table))
            left = left[table[slot] != left]
            mix, width = (mix * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % (1 << 64) | 1, max(10, int(4 * len(left)).bit_length())

    @staticmethod
    def _slot(gram: np.ndarray, mix: int, width: int) -> np.ndarray:
        return (gram.view(np.uint64) * np.uint64(mix) >> np.uint64(64 - width)).view(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for unknown grams) and the places of the unknown."""
        out, todo = np.zeros(len(gram), np.float32), np.arange(len(gram))
        for mix, width, table in self.tables:
            at = table[self._slot(gram, mix, width)]
            hit = (at >= 0) & (self.gram[at] == gram)
            out[todo[hit]] = self.value[at[hit]]
            todo, gram = todo[~hit], gram[~hit]
        return out, todo


def score_texts(texts: list[bytes], table: GramTable) -> tuple[np.ndarray, list, list]:
    """Per text: the log10 probability of its known grams; the other grams and their counts."""
    buf, first, size = framed(texts)
    out = np.zeros(len(texts))
    other: list[list[np.ndarray]] = [[] for _ in texts]
    for at in range(DEPTH, len(buf), WINDOW):
        part = buf[at - DEPTH: at + WINDOW].astype(np.int64)
        n = len(part) - DEPTH
        gram = part[:n]
        for j in range(1, DEPTH + 1):
            gram = (gram << 8) | part[j:j + n]
        value, unknown = table.find(gram)
        run = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        lo = int(np.searchsorted(first + size, at, "right"))
        hi = int(np.searchsorted(first, at + n, "left"))
        start, stop = np.clip(first[lo:hi] - at, 0, n), np.clip((first + size)[lo:hi] - at, 0, n)
        out[lo:hi] += run[stop] - run[start]
        for i, a, b in zip(range(lo, hi), np.searchsorted(unknown, start), np.searchsorted(unknown, stop)):
            if a < b:
                other[i].append(gram[unknown[a:b]])
    found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.int64),) * 2 for x in other]
    return out, [f[0] for f in found], [f[1] for f in found]


def _score_rows(grams: Broadcast, common: Broadcast):
    """Per document: tokens, the sums over frequent words and grams, and the other words and grams with their counts."""
    def lists(rows: list, kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end, table = common.value.get, common.value.get(END_WORD), grams.value
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("t").cast(pa.binary()).to_pylist()
            score, gram, gn = score_texts(texts, table)
            tokens, known, base, rare, n = [], [], [], [], []
            for text in texts:
                words = words_of(text)
                found = list(map(get, words))
                other = Counter(w for w, v in zip(words, found) if v is None)
                hit = [v for v in found if v is not None]
                tokens.append(len(words) + 1)
                known.append(len(hit) + (end is not None))
                base.append(float(np.sum(hit)) + (end if end is not None else np.log10(0.5)))
                rare.append(list(other))
                n.append(list(other.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(n, pa.list_(pa.int64())),
                 lists(gram, pa.int64()), lists(gn, pa.int64())],
                names=["rid", "n_tokens", "known", "base", "score", "rare", "n", "gram", "gn"])
    return run


def least_count(counts: DataFrame, col: str, most: int) -> int:
    """The smallest count such that at most ``most`` rows have it or more (from a histogram, so it may be up to 5 %
    above)."""
    bucket = F.when(F.col(col) < 64, F.col(col).cast("double")).otherwise(F.floor(F.log2(F.col(col)) * 16) * 4)
    rows = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r["least"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", frequent: int = FREQUENT,
          frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """One row per document: ``n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities), ``bits_per_byte``.

    ``learn`` is a condition on ``df`` for the rows to learn from."""
    spark = df.sparkSession
    text_batches(spark)
    sc = spark.sparkContext
    counts = checkpoint(df.where(learn).select(no_text(text).alias("t")).mapInArrow(_counts, "gram long, word binary, n long")
                        .groupBy("gram", "word").agg(F.sum("n").alias("n")))
    words = counts.where("gram is null").select("word", F.col("n").alias("c"))
    grams = counts.where("gram is not null").select("gram", "n")
    top = sc.broadcast(top_levels(grams))
    often = (_by_subtree(grams).mapInArrow(_score_grams(top, least_count(grams, "n", frequent_grams)), "gram long, lp double")
             .toArrow())
    table = sc.broadcast(GramTable(often.column("gram").to_numpy().astype(np.int64), often.column("lp").to_numpy()))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("c") >= least_count(words, "c", frequent)).collect()
    common = sc.broadcast({bytes(r["word"]): float(np.log10(r["c"] + 0.5)) for r in often})
    rid = F.struct(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("id"), F.octet_length("t").alias("bytes"))
    docs = df.select(F.col(id_col).alias("id"), no_text(text).alias("t")).select(rid.alias("rid"), "t")
    kind = docs.schema["rid"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_score_rows(table, common),
                                  f"rid {kind}, n_tokens long, known long, base double, score double, rare array<binary>, n array<long>, "
                                  "gram array<long>, gn array<long>"), "scored")
    rare = rows.select("rid.rid", F.explode(F.arrays_zip("rare", "n")).alias("x"))
    rare = rare.select("rid", F.col("x.rare").alias("word"), "x.n").join(words, "word", "left")
    added = rare.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"))
    deep = rows.select("rid.rid", F.explode(F.arrays_zip("gram", "gn")).alias("x")).select("rid", "x.gram", "x.gn")
    asked = grams.union(deep.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("n")))
    answers = _by_subtree(asked).mapInArrow(_score_grams(top, 1 << 62), "gram long, lp double")
    deep = deep.join(answers, "gram").groupBy("rid").agg(F.sum(F.col("gn") * F.col("lp")).alias("deep"))
    norm = float(np.log10(total + 0.5 * (kinds + 1)))
    value = F.col("score") + F.coalesce("deep", F.lit(0.0))
    return (rows.select("rid.*", "n_tokens", "known", "base", "score").join(added, "rid", "left").join(deep, "rid", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), value.alias("score"),
        (-value / np.log10(2.0) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte")))
