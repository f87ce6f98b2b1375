"""Token ids against the library; the solver against bounds and brute force; the
query against its own pieces."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from iolens.llm import packing as P
from iolens.llm import tokens as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(T.vocab_file(P.VOCAB))
    t.encode_special_tokens = True
    return t


def ids(enc, text):
    return np.frombuffer(enc.bytes_of(text), enc.dtype).tolist()


def test_chunked_ids_are_the_whole_texts(tok):
    enc = T.Encoder(T.vocab_file(P.VOCAB))
    assert enc.plain and enc.width == 2
    fixed = ["", " ", "\n", "a", " a", "a ", "a  b", "a   b", "a\n\nb", "a \n b", "a\t b", "a\t  b", "x\xa0 y", "x  y", "é　 z", "\x1c a\x1db",
             "don't I'll we've 12 34th!", "a\r\nb", "<|endoftext|> x", "naïve Ünï. Foo, bar. 'quoted' #!?", "日本語 テキスト。", "a" * 300 + " " + "b" * 100, "\n\n\nx", "  lead"]
    rng = random.Random(2)
    parts = ["a", "Foo", "bär.", " ", "  ", "\n", "\t", "\xa0", "1", "2x", "'s", "!!", "é", " ", "\x85", "᠎", "🙂", "\r"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    for t in fixed + made + fixed:
        assert ids(enc, t) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def valid(count, patterns, capacity):
    got = np.zeros_like(count)
    for content, uses in patterns:
        assert uses > 0 and sum(s * t for s, t in content) <= capacity
        for s, t in content:
            got[s] += t * uses
    assert (got == count).all()
    return sum(u for _, u in patterns)


def optimum(sizes, capacity):
    """Fewest sequences, by trying."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                go(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1:]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_bin_completion_reaches_the_optimum_of_small_cases():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(10, 60))
        sizes = rng.integers(1, capacity + 1, rng.integers(1, 11))
        count = np.bincount(sizes, minlength=capacity + 1)
        n = valid(count, P.bin_completion(count, capacity), capacity)
        best = optimum(sizes.tolist(), capacity)
        assert P.lower_bound(count, capacity) <= best == n


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_is_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int), 1, 1024)
    count = np.bincount(sizes, minlength=1025)
    fit = valid(count, P.best_fit(count, 1024), 1024)
    n = valid(count, P.bin_completion(count, 1024, 500), 1024)
    assert P.lower_bound(count, 1024) <= n <= fit
    assert n <= P.lower_bound(count, 1024) * 1.01 + 1


def test_best_fit_is_that_of_single_pieces():
    rng = np.random.default_rng(9)
    for _ in range(40):
        capacity = int(rng.integers(8, 40))
        sizes = sorted(rng.integers(1, capacity + 1, 30).tolist(), reverse=True)
        room = []
        for s in sizes:
            fits = [r for r in room if r >= s]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - s)
            else:
                room.append(capacity - s)
        count = np.bincount(sizes, minlength=capacity + 1)
        assert valid(count, P.best_fit(count, capacity), capacity) == len(room)


def test_fillings_are_undominated_and_complete():
    count = np.zeros(31, np.int64)
    for s in (3, 5, 7, 11, 13):
        count[s] = 2
    got = list(P.fillings(count, 20, 6))
    assert got and [w for w, _ in got] == sorted(w for w, _ in got)
    every = {c for n in range(1, 7) for c in itertools.combinations([3, 3, 5, 5, 7, 7, 11, 11, 13, 13], n) if sum(c) == 20}
    assert {tuple(sorted(s for s, t in used for _ in range(t))) for w, used in got if w == 0} == {tuple(sorted(c)) for c in every}


def check_result(rows, texts, tok, capacity=P.CAPACITY, end=P.END_ID):
    """``rows`` pack exactly the ids of ``texts`` ([(doc_id, text)])."""
    want = []
    for doc, text in texts:
        x = tok.encode(text or "", add_special_tokens=False).ids + [end]
        at = 0
        for k, n in enumerate(P.piece_lengths(len(x), capacity)):
            want.append((doc, k, at, n, zlib.crc32(np.array(x[at:at + n], "<u4").tobytes())))
            at += n
        assert at == len(x)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_query_packs_all_documents(spark, tok):
    rows = P.op1_best_fit_packing(spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_result(rows, texts, tok)
    count = np.bincount([r.length for r in rows], minlength=1025)
    assert n <= sum(u for _, u in P.best_fit(count, 1024))


def test_edge_rows(spark, tok):
    texts = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (4, "word " * 5000), (5, "word " * 5000)]
    docs = spark.createDataFrame([(*t, 9, 9, 9) for t in texts], "doc_id long, text string, length int, block int, rank int")
    check_result(P.pack(docs).collect(), texts, tok)
    assert P.pack(docs.limit(0)).count() == 0
    assert P.piece_lengths(1024, 1024) == [1024] and P.piece_lengths(1025, 1024) == [1, 1024]


SPECIAL = [(1, "<|endoftext|>"), (2, "a <|endoftext|> b"), (3, "x<|endoftext|><|endoftext|>\n\ny"), (4, "<|endoftext| >"), (5, "word " * 900 + "<|endoftext|>")]


def test_special_tokens_in_texts_are_the_librarys(spark):
    plain = Tokenizer.from_file(T.vocab_file(P.VOCAB))
    enc = T.encoder(T.vocab_file(P.VOCAB))
    for t in [t for _, t in SPECIAL] + ["plain words, no token"]:
        assert ids(enc, t) == plain.encode(t, add_special_tokens=False).ids, t
    docs = spark.createDataFrame(SPECIAL, "doc_id long, text string")
    check_result(P.pack(docs).collect(), SPECIAL, plain)
