"""SentencePiece: the Viterbi segmentation against a plain one, decoding against the library, round trips."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece

from iolens.llm import pieces as P
from iolens.llm.tokens import vocab_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return P.Pieces(vocab_file(P.VOCAB))


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=vocab_file(P.VOCAB))


def plain_scores(sp):
    return {sp.id_to_piece(k): np.float32(sp.get_score(k)) for k in range(sp.get_piece_size())
            if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))}


def best_sum(word, scores, floor, longest):
    """Highest sum of scores of a segmentation, in float32 from left to right."""
    best = [np.float32(0)] + [np.float32(-np.inf)] * len(word)
    for e in range(1, len(word) + 1):
        top = best[e - 1] + floor if word[e - 1] not in scores else np.float32(-np.inf)
        for s in range(max(0, e - longest), e):
            x = scores.get(word[s:e])
            if x is not None:
                top = max(top, np.float32(best[s] + x))
        best[e] = top
    return best[-1]


def score_of(ids, sp, scores, floor):
    total, run = np.float32(0), bytearray()
    for k in ids:
        if sp.is_byte(k):
            run.append(int(sp.id_to_piece(k)[3:5], 16))
            try:
                run.decode()
            except UnicodeDecodeError:
                continue
            run.clear()
            total = np.float32(total + floor)
        else:
            total = np.float32(total + scores[sp.id_to_piece(k)])
    assert not run
    return total


def test_segmentations_have_the_best_score(spark, model, sp):
    scores = plain_scores(sp)
    longest = max(map(len, scores))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdeéß日🙂 .,ing") for _ in range(60)) for _ in range(60)]
    words = sorted({w for t in texts for w in model.words(t)})[:3000]
    model.add(set(words))
    for w in words:
        ids = np.frombuffer(model.cache[w], "<u4").tolist()
        assert score_of(ids, sp, scores, model.floor) == best_sum(w, scores, model.floor, longest), w


def test_words_fall_apart_where_no_piece_crosses(model, sp):
    assert model.words("") == [] and model.words("a  b c") == ["▁a", "▁▁b", "▁c"] and model.words(" a ") == ["▁▁a", "▁"]
    assert not any("▁" in sp.id_to_piece(k).lstrip("▁") for k in range(sp.get_piece_size()) if not sp.is_byte(k))


def test_decoding_is_the_librarys_and_inverts(model, sp):
    rng = random.Random(2)
    texts = ["", " ", "  two", "tail ", "a\nb\tc", "é🙂日本 x", "plain words"] + ["".join(rng.choice("ab cé🙂\n.") for _ in range(30)) for _ in range(200)]
    for t, ids in zip(texts, model.encode(texts)):
        assert model.decode(ids) == t
        assert sp.decode(np.frombuffer(ids, "<u4").tolist()) == t
    for t in texts:  # the library's own segmentations decode the same
        own = sp.encode(t)
        assert model.decode(np.array(own, "<u4").tobytes()) == sp.decode(own)


def test_query_and_columns(spark, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.op5_sentencepiece(spark, SF).collect()
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in rows} == {d: (len(x) // 4, zlib.crc32(x)) for d, x in zip(texts, model.encode(list(texts.values())))}
    assert all(r.round_trip for r in rows)
    path = vocab_file(P.VOCAB)
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x y", 1), (3, "x y", 1), (None, "né 🙂", 1), (5, "w" * 3000 + " b" * 30_000, 1)], "doc_id long, text string, n_pieces int")
    out = docs.select("text", P.decode(P.encode(docs["text"], path), path).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in out)
    got = sorted(((r.doc_id or 0, r.n_pieces) for r in P.describe(docs, path).collect()))
    assert got[1:3] == [(1, 0), (2, 0)] and P.describe(docs.limit(0), path).count() == 0


def test_ids_are_the_librarys(spark, model, sp):
    assert model.kind == P.BPE
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").collect()]
    rng = random.Random(5)
    texts += ["", " ", "   ", "aaaaaaa aaaa", " Elle des", "x" * 700, "日本語🙂🙂é" * 200, "".join(rng.choice("etaoins ") for _ in range(3000)), "ab" * 3000]
    texts += ["".join(rng.choice("abcdeéß日🙂 .,ingthe\n") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    for t, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t), t


def test_both_ways_of_merging_agree(model):
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("etaoinshé🙂") for _ in range(40)) for _ in range(300)]
    assert model.merge(words) == [model.merge_long(w) for w in words]
