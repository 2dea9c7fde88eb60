"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import catalog, token_align
from ledgerlens.llm.token_files import byte_letters, vocabulary_path

from .conftest import SF

ODD = ["", None, " ", "  ", "a  b", " a\n b\t c ", "a \nb ", "it's 12,3 don't!!\n\n", "　x y z", "<|endoftext|> a", "<s> </s> <unk>", "<0x41> 漢字 ",
       "x\r\ny  \n", "é ß  ﬁ", "a\x1cb \x1d c", "a▁b", "▁", "naïve café " * 500, "x" * 3000, "\x00 a", "🙂🙂 🙂"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    byte = {c: i for i, c in enumerate(byte_letters())}

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])
    return tokens


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, tokens):
    found, counts = [], Counter()
    for _, text in rows:
        a, b = map(spans, tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 400 else sweep(a, b)
        counts.update(links)
        groups, start = [], 0
        for end in sorted({x[2] for x in a} & {y[2] for y in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)) if len(a) < 400 else None)
            start = end
        if len(a) >= 400:
            groups = cut(a, b)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((d if d is not None else -1, na, nb, ng, len(li), sum(counts[x] == top[x[1]] for x in li), sum(counts[x] for x in li),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for (d, _), (na, nb, ng, li, g) in zip(rows, found)))


def sweep(a, b):
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def cut(a, b):
    out, x, y, j = [], [], [], 0
    ends = {t[2] for t in b}
    for i, _, e in a:
        x.append(str(i))
        if e in ends:
            while j < len(b) and b[j][2] <= e:
                y.append(str(b[j][0]))
                j += 1
            out.append(f"{','.join(x)}|{','.join(y)}")
            x, y = [], []
    return out


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                   r["groups_sha256"]) for r in df.collect())


def test_query_matches_brute_force(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(catalog.QUERIES["op13_token_align"](spark, SF)) == brute(rows, plain)


def test_edge_cases_and_pairs_beyond_the_table(spark, plain, docs, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b")]
    df = docs(rows, "doc_id long, text string, id string, groups string, pair long, block long").repartition(3)
    want = brute(rows, plain)
    assert rows_of(token_align.alignment_report(df)) == want
    monkeypatch.setattr(token_align.frequent, "__defaults__", (5,))
    assert rows_of(token_align.alignment_report(df)) == want
    groups = {r["doc_id"]: r["groups"] for r in token_align.align(df.where("doc_id = 4")).collect()}
    assert hashlib.sha256(groups[4].encode()).hexdigest() in {w[-1] for w in want if w[0] == 4}


def test_empty_table(spark, docs):
    assert token_align.alignment_report(docs([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB é7\n\t'.,<>|▁漢🙂  \x85s")), max_size=30))
def test_stretches_equal_whole_texts(plain, text):
    found = token_align.aligner(*token_align._paths(None, None))
    numbers, _ = found.stretches(pa.array([text]))
    a, b = plain(text)
    got = ";".join(found.text[n] for n in numbers.tolist())
    assert [int(i) for i in got.replace("|", ";").replace(",", ";").split(";") if i] != [] or not a
    sides = [g.split("|") for g in got.split(";")] if got else []
    assert [int(i) for s in sides for i in s[0].split(",")] == [i for i, _ in a]
    assert [int(i) for s in sides for i in s[1].split(",")] == [i for i, _ in b]
