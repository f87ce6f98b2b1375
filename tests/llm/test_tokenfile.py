"""Token files: exact round trip, random access without copies, edge rows."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from iolens.llm import tokenfile as F
from iolens.llm import tokens as T
from iolens.session import scratch_path

SF = "/root/testdata/sf0.001"


def expected(texts, end=F.END_ID):
    """{doc_id: [(start, n_tokens, crc)]} and all ids, documents in ascending doc_id order."""
    tok = Tokenizer.from_file(T.vocab_file(F.VOCAB))
    tok.encode_special_tokens = True
    out, stream = {}, []
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        out.setdefault(doc, []).append((len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    return out, stream


def by_doc(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.start):
        out.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    return out


def test_query_round_trip(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_doc(F.op8_token_id_output(spark, SF).collect()) == expected(texts)[0]


def test_random_access_and_masks(spark):
    texts = [(k, f"document {k} " + "some words " * (k % 40)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folder = scratch_path(spark, "t-tokens")
    manifest = F.write(docs, folder, T.vocab_file(F.VOCAB), sequence=64).orderBy("base").collect()
    stream = []
    for m in manifest:
        shard = F.Shard(m.shard)
        assert shard.sequence == 64 and m.base == len(stream)
        before = pa.total_allocated_bytes()
        got = np.concatenate([shard.ids(k)[np.array(shard.mask(k).to_pylist())] for k in range(len(shard))])
        views = [shard.ids(k) for k in range(len(shard))]
        assert not any(v.flags.owndata for v in views) and pa.total_allocated_bytes() - before < 1 << 16
        assert len(got) == m.n_ids and (np.concatenate(list(shard.tokens(5, 150))) == got[5:155]).all()
        stream += got.tolist()
    assert stream == expected(texts)[1]


def test_edge_rows(spark):
    texts = [(7, None), (2, ""), (3, "x y"), (3, "x y"), (3, "a"), (None, "no id"), (1, "word " * 30_000)]
    docs = spark.createDataFrame([(*t, "z", 1) for t in texts], "doc_id long, text string, shard string, width int")
    got = F.read_documents(F.write(docs, scratch_path(spark, "t-tokens"), T.vocab_file(F.VOCAB)))
    assert by_doc(got.collect()) == expected(texts)[0]
    empty = F.write(docs.limit(0), scratch_path(spark, "t-tokens"), T.vocab_file(F.VOCAB))
    assert empty.count() == 0 and F.read_documents(empty).count() == 0


def test_special_tokens_in_texts_are_the_librarys(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = F.read_documents(F.write(docs, scratch_path(spark, "t-tokens"), T.vocab_file(F.VOCAB))).collect()
    tok, start = Tokenizer.from_file(T.vocab_file(F.VOCAB)), 0
    for r in sorted(got, key=lambda r: r.start):
        want = tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [F.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
