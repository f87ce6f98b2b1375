"""Token alignment: spans against decoded bytes, units against whole texts, the query against brute force, slices, edge rows."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from tokenizers import Tokenizer

from iolens.llm import alignment as A
from iolens.llm.tokens import vocab_file

SF = "/root/testdata/sf0.001"
PATHS = vocab_file(A.A_FILE), vocab_file(A.B_FILE)
ODD = ["a", "x y", "Hello wörld\nab  中文 x😀 ▁q <s>", "tab\there", "two  spaces", " lead", "trail ", "\nnew", "line\n\nline", "a\n b", "<|endoftext|> x", "naïve façade\nétude",
       "日本語 テキスト", "🙂🙂 👩‍👩‍👧 ok", " nbsp ", "a b", "\x00nul", "don't we'll", "x" * 300, "…—–“”", "𝔘𝔫𝔦 ⟨⟩", "́ mark", "a\r\nb", " ", "\n", "\x1c sep", "éé"]


def tokens():
    """(ids, bytes) of both sides by the libraries alone."""
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def a(text):
        got = tok.encode(" " + text, add_special_tokens=False)
        return got.ids, [bytes(chars[c] for c in t) for t in got.tokens]

    def b(text):
        ids = sp.encode(text)
        return ids, [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, map(sp.id_to_piece, ids))]
    return a, b


def brute(texts):
    """{row: digest columns} by walking all bytes."""
    a, b = tokens()
    rows, counts = [], Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        x, y = (a(text), b(text)) if text else (([], []), ([], []))
        if not text or b"".join(x[1]) != raw or b"".join(y[1]) != raw:
            rows.append(((0, 0, 0, []), ""))
            continue
        owner = [[k for k, t in enumerate(side[1]) for _ in t] for side in (x, y)]
        links = sorted(set(zip(*owner)))
        ends = [set(accumulate(map(len, side[1]))) for side in (x, y)]
        cuts, groups, at = sorted(ends[0] & ends[1]), [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(side[0][k]) for k in range(o[at], o[c - 1] + 1)) for side, o in zip((x, y), owner)))
            at = c
        pairs = [(x[0][i], y[0][j]) for i, j in links]
        counts.update(pairs)
        rows.append(((len(x[0]), len(y[0]), len(groups), pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return [(na, nb, g, len(p), sum(counts[q] == top[q[1]] for q in p), sum(counts[q] for q in p), sha) for (na, nb, g, p), sha in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def made(seed, n):
    rng = random.Random(seed)
    parts = ["word", "é", "中", "😀", " ", " ", " ", "\n", "'s", "12", ".", ",", "Stra", "ße", "\t", "<s>", "un", "tion", "▁", "\x07", "ſ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def rows_of(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows_of(A.op13_token_alignment(spark, SF))
    assert len(got) == len(texts)
    assert [got[d] for d in texts] == brute(texts.values())


@pytest.mark.parametrize("slice_rows", [A.SLICE, 900])
def test_odd_texts_and_slices(spark, slice_rows):
    texts = [None, "", *ODD, *made(1, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows_of(A.alignment(docs, *PATHS, slice_rows=slice_rows))
    want = brute(texts)
    for k, t in enumerate(texts):
        assert got[k] == want[k], repr(t)
    assert sum(w[0] == 0 for w in want) > 2 and sum(w[0] > 0 for w in want) > 200


def test_units_are_whole_texts():
    al = A.Aligner(*PATHS, units=50)  # generations turn over
    assert al.in_units
    texts = [t for t in ODD + made(2, 500) if t]
    assert al.texts(texts) == [al.align(t) for t in texts]
    assert len(al.units) <= 50 and len(al.units.old) <= 50


def test_cuts_are_the_decoded_bytes():
    al = A.Aligner(*PATHS)
    for t in ODD + made(3, 300):
        for got, table in ((al.a_tokens(" " + t), al.a_bytes), (al.b_tokens(t), al.b_bytes)):
            if got:
                ends, n = [], 0
                for k in got[0]:
                    n += len(table[k])
                    ends.append(n)
                assert got[1] == ends, repr(t)


def test_edge_rows(spark):
    rows = [(7, None, "x", 1), (2, "", "x", 1), (3, "x y", "x", 1), (3, "x y", "x", 1), (3, "a", "x", 1), (None, "no id", "x", 1), (1, "word étude " * 20_000 + "end", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int")
    got = A.alignment(docs, *PATHS).collect()
    assert len(got) == len(rows)
    want = brute([r[1] for r in rows[:6]] + ["word étude " * 20_000 + "end"])
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, r.n_a, r.n_b, r.n_links, r.count_sum, r.groups_sha256) for r in got) == \
        order((r[0], w[0], w[1], w[3], w[5], w[6]) for r, w in zip(rows, want))
    empty = A.alignment(docs.limit(0), *PATHS)
    assert empty.count() == 0
