"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id; every partition becomes one Arrow IPC file in the shared
folder. A record batch holds ``BATCH_ROWS`` rows of two fixed-size lists: ``ids`` (uint16, or
uint32 for a vocabulary over 65,536) and ``mask`` (bit-packed; set for real ids, unset for the padding
after a file's last document). The ids of a file run on from row to row, so place p is row p // length,
column p % length, and a memory-mapped file gives any sequence, or any document's ids, without a copy or a scan.

An index (file, document, place, count) goes beside the files; a file's name holds its task attempt, and
only files that the index names count, so a lost executor or a second attempt leaves no trace.

Each worker keeps the ids of up to about ``CACHE`` words that it has met.

Edge cases: null text counts as empty; an empty document has just the end id; null ids sort first; repeated rows
are documents of their own, ordered by text hash; no rows write no file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, no_text, shared_path, text_batches

LENGTH = 2048
BATCH_ROWS = 256
END_ID = 0
CACHE, LONG, GROUP = 1_000_000, 64, 1024
#: Texts of this size are encoded at a time.
BLOCK_BYTES = 8 << 20
#: Stops that the splitting rule parts from the letters before them.
STOPS = ".,;:!?|"
#: A line end in byte letters.
LINE_END = "\u010a"
VOCABULARY = "byte_bpe_50k.json"
#: Where white space (of the tokenizer's own splitting rule, Unicode White_Space) doesn't stand alone between other
#: characters.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = _SPACE + _SPACE
_worker: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves,
    the others, in order, for the letters from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, without special tokens.

    The library cuts a text by a public pattern and never joins ids across cuts; so a distinct cut is given to its
    merging model once, spelt in the vocabulary's byte letters, and, for fewer calls, many at a time with a line end
    between them."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.merges = Tokenizer(self.lib.model)     # no further cutting: for cuts in byte letters
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters_of = np.zeros(self.lib.get_vocab_size(), np.int64)
        for entry, i in self.lib.get_vocab().items():
            self.letters_of[i] = len(entry)
        self.cuts = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}         # a piece, without the space before it -> its number in the store
        self.store, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _cut(self, text: str) -> list[str] | tuple[str, ...]:
        """The pattern's cuts; a space, letters and at most one stop need no search."""
        word = text[1:]
        if text[:1] == " " and word:
            if word.isalpha():
                return (text,)
            if word[-1] in STOPS and word[:-1].isalpha():
                return text[:-1], word[-1]
        return self.cuts(text)

    def _cut_ids(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct cuts, and how many each has."""
        lines = [i for i, c in enumerate(cuts) if "\n" in c]
        plain = list(cuts)
        for i in lines:
            plain[i] = ""
        spelt = self._spelt("\n".join(plain)).split(LINE_END)
        for i in lines:
            spelt[i] = self._spelt(cuts[i])
        groups = [spelt[i:i + GROUP] for i in range(0, len(cuts), GROUP)]
        found = self.merges.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in found])
        ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
        last = np.searchsorted(np.cumsum(self.letters_of[ids]), ends, "right")     # cuts end where ids do
        return ids, np.diff(last, prepend=0)

    def _spelt(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def piece_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of stretches of text that are whole between two cuts, and how many each has."""
        cuts = [self._cut(t) for t in texts]
        flat = list(chain.from_iterable(cuts))
        if not flat:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        place = dict(zip(distinct := list(dict.fromkeys(flat)), range(len(flat))))
        ids, taken = gather(*self._cut_ids(distinct), np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)))
        return ids, sums(taken, np.fromiter(map(len, cuts), np.int64, len(cuts)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, sizes = self.encode_all(pa.array(texts, pa.large_string()))
        raw, stop = ids.tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has.

        A single space or line end between other characters always begins a cut, so texts fall into pieces there, and
        equal pieces are encoded once; a text with longer runs of white space is one piece."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _RUN)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        at = split.offsets.to_numpy()
        pieces = split.flatten()
        first = pc.if_else(odd, texts, pieces.take(pa.array(at[:-1]))).to_pylist()
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.known]
        ids, sizes = self.piece_ids([w if w[:1] == "\n" else " " + w for w in new])
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.store, self.sizes = np.concatenate([self.store, ids]), np.concatenate([self.sizes, sizes])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        index = number[coded.indices.to_numpy(zero_copy_only=False)]
        index[at[:-1]] = len(self.sizes) + np.arange(len(texts))            # no space before a text's first piece
        ids, sizes = self.piece_ids(first)
        ids, taken = gather(np.concatenate([self.store, ids]), np.concatenate([self.sizes, sizes]), index)
        if sum(map(len, new)) > LONG * len(new):
            self._forget()
        return ids, sums(taken, np.diff(at))


def gather(store: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``store`` (one after the other, of the given sizes) that ``index`` names, and their sizes."""
    taken = sizes[index]
    ends = np.cumsum(taken)
    first = (np.cumsum(sizes) - sizes)[index] - (ends - taken)
    return store[np.repeat(first, taken) + np.arange(ends[-1] if len(ends) else 0)], taken


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``size`` bytes or one larger given batch."""
    held, full = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            full += b.nbytes
        if full >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, full = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


def record_batch(ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    """A batch of whole rows, of which the first ``real`` ids are no padding."""
    mask = np.zeros(len(ids), bool)
    mask[:real] = True
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
         pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema(ids.dtype, length))


class TokenWriter:
    """Appends ids to one file; only a batch and the document at hand are held."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH):
        self.length, self.dtype, self.count = length, dtype, 0
        self.full = length * BATCH_ROWS
        self.held = bytearray()
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.sink = self.fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, schema(dtype, length))

    def append(self, ids: bytes) -> None:
        self.held += ids
        self.count += len(ids) // self.dtype.itemsize
        step = self.full * self.dtype.itemsize
        while len(self.held) >= step:
            self.out.write_batch(record_batch(np.frombuffer(bytes(self.held[:step]), self.dtype), self.full, self.length))
            del self.held[:step]

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.dtype)
            rows = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            rows[: len(ids)] = ids
            self.out.write_batch(record_batch(rows, len(ids), self.length))
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to a file's sequences; local files are memory-mapped and nothing is copied."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.at[0] != k:
            self.at = (k, self.file.get_batch(k))
        return self.at[1]

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask of one row."""
        b, i = self._batch(row // BATCH_ROWS), row % BATCH_ROWS
        return b.column(0).flatten().to_numpy()[i * self.length:(i + 1) * self.length], b.column(1)[i].values

    def span(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids of places start to start + count, in views of at most one batch."""
        full = self.length * BATCH_ROWS
        while count > 0:
            k, i = divmod(start, full)
            view = self._batch(k).column(0).flatten().to_numpy()[i:i + count]
            yield view
            start, count = start + len(view), count - len(view)

    def close(self) -> None:
        self.at = (-1, None)
        self.source.close()


def write_token_files(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes the files and returns their index, checkpointed: ``(part, file, row, id, place, n_tokens)``, places
    counted within the file. ``folder`` is a URI that every executor can write to."""
    spark = df.sparkSession
    text_batches(spark)
    folder = folder or shared_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    path = vocabulary or vocabulary_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, row = TaskContext.get(), None, 0
        part, enc = task.partitionId(), encoder(path)
        uri = f"{folder}/part-{part:05d}-{task.taskAttemptId()}.arrow"
        end = np.array([end_id], enc.dtype).tobytes()
        for b in blocks(batches, BLOCK_BYTES):
            out = out or TokenWriter(uri, enc.dtype, length)
            ids, sizes = enc.encode_all(b.column(1))
            count = sizes + 1
            place = out.count + np.cumsum(count) - count
            raw, stop = ids.tobytes(), (np.cumsum(sizes) * enc.dtype.itemsize).tolist()
            for s, e in zip([0, *stop], stop):
                out.append(raw[s:e] + end)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([uri] * n), pa.array(range(row, row + n), pa.int64()),
                 b.column(0), pa.array(place, pa.int64()), pa.array(count, pa.int64())],
                names=["part", "file", "row", "id", "place", "n_tokens"])
            row += n
        if out:
            out.close()
    docs = df.select(F.col(id_col).alias("id"), no_text(text).alias("t"))
    order = ["id", F.xxhash64("t")]
    return checkpoint(docs.repartitionByRange(*order).sortWithinPartitions(*order)
                      .mapInArrow(run, f"part int, file string, row long, id {kind}, place long, n_tokens long"))


def read_token_index(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: ``(id, start, n_tokens, ids_crc32)`` per document; start counts over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = (index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            out = []
            for uri, place, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if uri != name:
                    if file:
                        file.close()
                    name, file = uri, TokenFile(uri)
                crc = 0
                for view in file.span(place, n):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(4), b.column(3), pa.array(out, pa.int64())],
                                             names=["id", "start", "n_tokens", "ids_crc32"])
        if file:
            file.close()
    rows = index.join(F.broadcast(files), "part").select(
        "file", "id", "place", "n_tokens", (F.col("base") + F.col("place")).alias("start"))
    return (rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
            .withColumnRenamed("id", id_col))


def token_files(df: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Writes all documents and returns, from the files, one row per document."""
    return read_token_index(write_token_files(df, id_col=id_col, text=text, **kw), id_col)
