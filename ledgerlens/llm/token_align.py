"""Alignment of two tokenizers over the same texts.

Each text is encoded by a byte-level vocabulary (A, of the text with a space before it) and by a piece vocabulary (B, which
adds that space itself). The cumulative byte ends of A's tokens and of B's go into end-to-index dictionaries; the ends that
both sets of keys hold, sorted, slice both id lists into groups, and each slice is expanded into links: the pairs of
an A token and a B token whose byte ranges overlap.

Neither vocabulary joins tokens over a space that follows anything but white space, so a text falls into stretches there, and each
distinct stretch is encoded and aligned once in a worker (up to about ``CACHE`` of them are kept).

How many links of all documents hold a pair of ids, and whether that is the most of its B id, needs the whole corpus. The first pass
stores, for blocks of documents, each distinct stretch's links and each document's stretches; the counts of all pairs are
summed from it by a shuffle, and the second pass reads the blocks again. It holds the most frequent pairs (at most ``TABLE``) as a
table; documents' other pairs are joined to the counts by the pair, so no pair with many occurrences is shuffled by its key.

Edge cases: null and empty texts, and texts whose tokens of A or B do not give their bytes back (such as those with U+2581), have
no tokens: all counts are 0 and the group text is empty. Repeated rows and rows with a null id are documents of their own; other
columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .token_files import _SPACE, Encoder, blocks, gather, sums, vocabulary_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE, LONG = 250_000, 64
BLOCK_BYTES = 6 << 20
#: Stretches aligned at a time.
LEARNT = 40_000
#: Most pairs held by every worker (20 bytes each).
TABLE = 1 << 19
#: Where texts fall apart: a space after anything but white space.
_CUT = re.compile("(?<=[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])(?= )")
_worker: dict = {}


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, ...]:
    """Groups (i, k, j, m): tokens i to k of A and j to m of B lie between neighbouring ends of both; and those ends."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    k, m = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
    return np.append(0, k)[:-1], k, np.append(0, m)[:-1], m, np.array(common, np.int64)


def links(ends_a: np.ndarray, ends_b: np.ndarray, i: np.ndarray, k: np.ndarray, j: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that overlap, group by group. A token alone on its side meets all of the other side's; otherwise both sides
    are walked, and the token that ends first goes on. So a group has one link less than tokens."""
    count = (k - i) + (m - j) - 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    x = np.repeat(i, count) + np.where(np.repeat(m - j == 1, count), step, 0)
    y = np.repeat(j, count) + np.where(np.repeat(k - i == 1, count), step, 0)
    first = np.cumsum(count) - count
    for g in np.flatnonzero((k - i > 1) & (m - j > 1)).tolist():
        a, b, at = int(i[g]), int(j[g]), int(first[g])
        for n in range(at, at + int(count[g])):
            x[n], y[n] = a, b
            if ends_a[a] <= ends_b[b]:
                a += 1
            else:
                b += 1
    return x, y


class Aligner:
    """Aligns stretches of text and remembers them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in self.a.letters.items()}
        self.bytes_a = [b""] * self.a.lib.get_vocab_size()
        for e, i in self.a.lib.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # an id before another of its side, and as the last of its group
        self.text_a, self.text_b = (np.array([[f"{i}," for i in range(len(x))], [f"{i}{end}" for i in range(len(x))]], object)
                                    for x, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))
        self.space_b = self.b.piece_to_id("▁")
        # B joins nothing over "other character, space", or stretches would not be independent
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []                       # groups as text
        self.facts = np.zeros((0, 5), np.int64)         # tokens of A and of B, groups, links, whether bytes are given back
        self.keys = np.zeros(0, np.int64)               # links: A id << 32 | B id
        self.long = False

    def ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of stretches that begin with a space: A's, one after the other, and how many each has; B's likewise."""
        b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        b = [x if s != " " else [self.space_b] for s, x in zip(stretches, b)]
        sizes = np.fromiter(map(len, b), np.int64, len(b))
        a, of = self.a.piece_ids(stretches)
        return a.astype(np.int64), of, np.fromiter(chain.from_iterable(b), np.int64, int(sizes.sum())), sizes

    def _given_back(self, stretches: list[str], tokens: tuple[np.ndarray, ...]) -> np.ndarray:
        """Which stretches' tokens, of both sides, give their bytes back."""
        a, of_a, b, of_b = tokens
        raw = [s.encode() for s in stretches]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = (sums(self.size_a[a], of_a) == size) & (sums(self.size_b[b], of_b) == size)
        for table, ids, of in ((self.bytes_a, a, of_a), (self.bytes_b, b, of_b)):
            if not good.all() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):
                ends = np.cumsum(of)
                good &= [x == b"".join(map(table.__getitem__, ids[e - n:e].tolist())) for x, n, e in zip(raw, of, ends)]
        return good

    def _learn(self, stretches: list[str]) -> None:
        tokens = self.ids(stretches)
        good = self._given_back(stretches, tokens)
        text = np.full(len(stretches), "", object)
        facts = np.zeros((len(stretches), 5), np.int64)
        facts[:, 4] = good
        if good.any():
            a, of_a, b, of_b = tokens
            a, b, of_a, of_b = a[np.repeat(good, of_a)], b[np.repeat(good, of_b)], of_a[good], of_b[good]
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            i, k, j, m, common = slices(ends_a.tolist(), ends_b.tolist())
            x, y = links(ends_a, ends_b, i, k, j, m)
            self.keys = np.concatenate([self.keys, a[x] << 32 | b[y]])
            ends = ends_a[np.cumsum(of_a) - 1]                      # of the stretches
            groups = np.bincount(np.searchsorted(ends, common), minlength=len(ends))
            facts[good, :4] = np.stack([of_a, of_b, groups, sums(k - i + m - j - 1, groups)], 1)
            pieces = np.empty(len(a) + len(b), object)
            for ids, table, first, last, before in ((a, self.text_a, i, k, j), (b, self.text_b, j, m, k)):
                ending = np.zeros(len(ids), np.int64)
                ending[last - 1] = 1
                pieces[np.arange(len(ids)) + np.repeat(before, last - first)] = table[ending, ids]
            pieces, stop = pieces.tolist(), np.cumsum(of_a + of_b).tolist()
            text[good] = ["".join(pieces[s:e])[:-1] for s, e in zip([0, *stop], stop)]
        self.known.update(zip(stretches, range(len(self.text), len(self.text) + len(stretches))))
        self.text += text.tolist()
        self.facts = np.concatenate([self.facts, facts])

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all stretches of the texts, one after the other, and how many each text has; an empty text has none."""
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |{_SPACE} "), not self.apart)
        if self.long or len(self.text) > CACHE:
            self._forget()
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        words = [" " + w for w in coded.dictionary.to_pylist()]
        whole = {i: (_CUT.split(" " + t) if self.apart else [" " + t]) if t else []
                 for i, t in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)), texts.filter(odd).to_pylist())}
        new = [w for w in dict.fromkeys([*words, *(x for c in whole.values() for x in c)]) if w not in self.known]
        for i in range(0, len(new), LEARNT):
            self._learn(new[i:i + LEARNT])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        index, at = number[coded.indices.to_numpy(zero_copy_only=False)], split.offsets.to_numpy()
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        parts, sizes = [], []
        for i in range(len(texts)):
            part = index[at[i]:at[i + 1]]
            if empty[i]:
                part = part[:0]
            elif i in whole:
                part = np.array([self.known[x] for x in whole[i]], np.int64)
            if len(part) and not self.facts[part, 4].all():
                part = part[:0]
            parts.append(part)
            sizes.append(len(part))
        self.long = sum(map(len, new)) > LONG * len(new)
        return np.concatenate(parts) if parts else index[:0], np.array(sizes, np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _worker:
        _worker[path_a, path_b] = Aligner(path_a, path_b)
    return _worker[path_a, path_b]


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    text_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or vocabulary_path(VOCABULARY_A), b or vocabulary_path(VOCABULARY_B)


def _documents(found: Aligner, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], Iterator[str]]:
    """Stretches and how many each text has; tokens of A and B, groups and links; the groups as text."""
    numbers, sizes = found.stretches(texts)
    ends = np.cumsum(sizes)
    facts = [sums(found.facts[numbers, c], sizes) for c in range(4)]
    text = (";".join([found.text[n] for n in numbers[e - s:e].tolist()]) for s, e in zip(sizes, ends))
    return numbers, sizes, facts, text


def align(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary_a: str | None = None,
          vocabulary_b: str | None = None) -> DataFrame:
    """Per document its numbers of tokens, groups and links, and the groups as text: ``a1,a2|b1;a3|b2,b3``."""
    paths = _paths(vocabulary_a, vocabulary_b)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            _, _, facts, groups = _documents(aligner(*paths), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, facts), pa.array(list(groups), pa.string())],
                                             names=["id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return _texts(df, id_col, text).mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string").withColumnRenamed("id", id_col)


def pack(values: np.ndarray) -> bytes:
    """Compressed, lowest bytes of all values first."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return len(values).to_bytes(8, "little") + (pa.compress(raw.T.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    flat = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(dtype).reshape(-1)


def _blocks(df: DataFrame, id_col: str, text: str, paths: tuple[str, str]) -> DataFrame:
    """First pass: a row for each block of documents."""
    kind = df.schema[id_col].dataType.simpleString()
    facts_of = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, b in enumerate(blocks(batches, BLOCK_BYTES)):
            found = aligner(*paths)
            numbers, sizes, facts, groups = _documents(found, b.column(1))
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            distinct, local = np.unique(numbers, return_inverse=True)
            keys, per = gather(found.keys, found.facts[:, 3], distinct)
            row = [pa.array([part << 32 | n]), *(pa.array([x]) for x in facts), pa.array([digest])]
            packed = [pa.array([pack(x)], pa.binary()) for x in (sizes, local.astype(np.int32), keys, per.astype(np.int32))]
            ids = pa.ListArray.from_arrays([0, b.num_rows], b.column(0))
            yield pa.RecordBatch.from_arrays([*row, *packed, ids], names=["block", *facts_of, "groups_sha256", "sizes", "local",
                                                                          "keys", "per", "id"])
    lists = ", ".join(f"{c} array<long>" for c in facts_of)
    return _texts(df, id_col, text).mapInArrow(
        run, f"block long, {lists}, groups_sha256 array<string>, sizes binary, local binary, keys binary, per binary, "
             f"id array<{kind}>")


def pair_counts(table: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links that hold a pair, and whether no other pair of its B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for local, keys, per in zip(*(b.column(i).to_pylist() for i in range(3))):
                local, keys, per = unpack(local, np.int32), unpack(keys, np.int64), unpack(per, np.int32)
                times = np.repeat(np.bincount(local, minlength=len(per)), per)
                pairs, at = np.unique(keys, return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, at, times)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total)], names=["pair", "n"])
    counts = stored(table.select("local", "keys", "per").mapInArrow(run, "pair long, n long")
                    .groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)),
                    "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return stored(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-ranks")


def frequent(counts: DataFrame, most: int = TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of at least 2^k links, sorted, for the least k that leaves no more than ``most``."""
    power = F.floor(F.log2("n")).cast("int")
    least, held = 62, 0
    for r in sorted(counts.groupBy(power.alias("k")).count().collect(), reverse=True):
        if (held := held + r["count"]) > most:
            break
        least = r["k"]
    rows = counts.where(F.col("n") >= F.lit(1 << least)).toArrow()
    pairs, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order], n[order], best[order]


def alignment_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary_a: str | None = None,
                     vocabulary_b: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, ``n_best`` and ``count_sum`` by the counts of all documents, and the digest of
    its groups as text."""
    spark = df.sparkSession
    table = stored(_blocks(df, id_col, text, _paths(vocabulary_a, vocabulary_b)), "aligned")
    counts = pair_counts(table)
    held = spark.sparkContext.broadcast(frequent(counts))
    kind = df.schema[id_col].dataType.simpleString()
    facts = ["n_a", "n_b", "n_groups", "n_links"]
    columns = ["block", "doc", "id", *facts, "groups_sha256", "n_best", "count_sum", "pair", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, totals, bests = held.value
        for b in batches:
            for r in range(b.num_rows):
                block, sizes, local, keys, per = (b.column(i)[r].as_py() for i in range(5))
                sizes, local, keys, per = (unpack(x, t) for x, t in ((sizes, np.int64), (local, np.int32), (keys, np.int64),
                                                                     (per, np.int32)))
                at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                n = np.where(known, totals[at], 0) if len(pairs) else np.zeros(len(keys), np.int64)
                best = known & (bests[at] if len(pairs) else known)
                n_best, count_sum = (sums(sums(x, per)[local], sizes) for x in (best, n))
                rows = len(sizes)
                given = [b.column(i)[r].values for i in range(5, 11)]       # id, facts, digest
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * rows, pa.int64()), pa.array(np.arange(rows)), *given, pa.array(n_best),
                     pa.array(count_sum), none, none], names=columns)
                rest, of = gather(keys[~known], sums(~known, per), local)
                doc = np.repeat(np.repeat(np.arange(rows), sizes), of)
                found, number = np.unique(rest, return_inverse=True)
                both, times = np.unique(doc * max(len(found), 1) + number, return_counts=True)
                doc, number = np.divmod(both, max(len(found), 1))
                none = [pa.nulls(len(both), x.type) for x in given]
                zero = pa.array(np.zeros(len(both), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(both), pa.int64()), pa.array(doc), *none, zero, zero, pa.array(found[number]),
                     pa.array(times)], names=columns)
    scored = stored(table.select("block", "sizes", "local", "keys", "per", "id", *facts, "groups_sha256").mapInArrow(
        run, f"block long, doc long, id {kind}, {', '.join(f'{c} long' for c in facts)}, groups_sha256 string, n_best long, "
             "count_sum long, pair long, times long"), "scored")
    here = ["block", "doc"]
    more = (scored.where(F.col("pair").isNotNull()).select(*here, "pair", "times").join(counts, "pair")
            .groupBy(*here).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return scored.where(F.col("pair").isNull()).join(more, here, "left").select(
        F.col("id").alias(id_col), *facts, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
