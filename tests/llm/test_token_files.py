"""Token files: ids of the whole text by the library, an exact round trip, places and checksums."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import catalog, token_files

from .conftest import SF

ODD = ["", " ", "a  b", " a\n b\t c ", "a \nb", "\nab c\n", "it's 12,3 don't!!\n\n", "　x y z", "<|endoftext|> a", "x\r\ny  \n", "é ß  ",
       "a\x1cb \x1d c", "naïve café " * 3000, "x" * 3000]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(token_files.vocabulary_path())
    t.encode_special_tokens = True
    return t


def whole(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library(lib, monkeypatch):
    enc = token_files.Encoder(token_files.vocabulary_path())
    for cache in (token_files.CACHE, 3):
        monkeypatch.setattr(token_files, "CACHE", cache)
        for _ in range(2):
            got = enc.encode(ODD)
            assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [whole(lib, t)[:-1] for t in ODD]


def test_query_matches_brute_force(spark, lib):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(catalog.QUERIES["op3_token_files"](spark, SF).collect())
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = whole(lib, r["text"])
        assert tuple(g) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_give_equal_sequences_and_masks(docs, lib, tmp_path):
    df = docs([(i, t) for i, t in enumerate(ODD)])
    index = token_files.write_token_files(df, folder=f"file://{tmp_path}", length=64).collect()
    by_file = {}
    for r in sorted(index, key=lambda r: (r["part"], r["row"])):
        by_file.setdefault(r["file"], []).append(r)
    ids = []
    for uri, rows in by_file.items():
        file = token_files.TokenFile(uri)
        total = sum(r["n_tokens"] for r in rows)
        for k in range(-(-total // 64)):
            row, mask = file.sequence(k)
            assert len(row) == len(mask) == 64 and row.base is not None
            real = np.array(mask.to_pylist())
            assert real.sum() == min(64, total - 64 * k) and not row[~real].any()
            ids += row[real].tolist()
        file.close()
    assert ids == [x for t in ODD for x in whole(lib, t)]


def test_edge_cases(docs):
    df = docs([(None, "b"), (2, None), (2, ""), (1, "same"), (1, "same")])
    got = sorted(token_files.token_files(df).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 2]
    assert [r["n_tokens"] for r in got][3:] == [1, 1] and got[1]["ids_crc32"] == got[2]["ids_crc32"]
    assert token_files.token_files(df.limit(0)).count() == 0
