"""Quality rules: base counts by definition, the Kneser-Ney model against a plain one, bands, edge rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from iolens.llm import quality as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts_by_definition():
    rng = random.Random(1)
    texts = ["", " \n", "a\n\na\n\nb", "a b c a b c a", "x\xa0y \x1c z w", "## <b> &|", "a a a a a", "l\nl\r\nl\n l"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\t", "a b c "]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        words = t.encode().split()
        assert (len(words), *Q.base_rules(t, words)) == brute_base(t), repr(t)


def plain_model(words, alphabet):
    """Modified Kneser-Ney by dictionaries: p(context, symbol)."""
    sym = lambda c: int(np.searchsorted(alphabet, ord(c))) + 2 if ord(c) in set(alphabet.tolist()) else Q.OTHER
    count = [None] + [defaultdict(float) for _ in range(Q.ORDER)]
    for w, n in words.items():
        s = [Q.END] * (Q.ORDER - 1) + [sym(c) for c in w] + [Q.END]
        for k in range(len(s) - Q.ORDER + 1):
            count[Q.ORDER][tuple(s[k:k + Q.ORDER])] += n
    for k in range(Q.ORDER - 1, 0, -1):
        for g, n in count[k + 1].items():
            count[k][g[1:]] += n if k > 1 and g[1] == Q.END else 1
    totals = [None] + [defaultdict(float) for _ in range(Q.ORDER)]
    left = [None] + [defaultdict(float) for _ in range(Q.ORDER)]
    d = [None] + [Q.discounts(np.array(list(count[k].values()))) for k in range(1, Q.ORDER + 1)]
    for k in range(1, Q.ORDER + 1):
        for g, n in count[k].items():
            totals[k][g[:-1]] += n
            left[k][g[:-1]] += d[k][int(min(n, 3))]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / Q.SYMBOLS
        if g[:-1] not in totals[k]:
            return below
        n = count[k].get(g, 0.0)
        return (max(n - d[k][int(min(n, 3))], 0) + left[k][g[:-1]] * below) / totals[k][g[:-1]]

    return p, sym


def test_model_against_a_plain_one():
    rng = random.Random(4)
    words = Counter("".join(rng.choice("aaabbcdeé") for _ in range(rng.randint(1, 7))) for _ in range(900))
    alphabet = np.array(sorted(map(ord, "abcde")), np.uint32)
    gram, n = Q.word_grams(list(words), alphabet)
    keys, inverse = np.unique(gram, return_inverse=True)
    model = Q.kneser_ney(keys, np.bincount(inverse, np.repeat(list(words.values()), n)))
    p, sym = plain_model(words, alphabet)
    test = [*list(words)[:60], "zzz", "abcdeabcde", "", "éé"]
    gram, n = Q.word_grams(test, alphabet)
    got = np.split(Q.log2_probability(model, gram), np.cumsum(n)[:-1])
    for w, lp in zip(test, got):
        s = [Q.END] * (Q.ORDER - 1) + [sym(c) for c in w] + [Q.END]
        want = [math.log2(p(tuple(s[k:k + Q.ORDER]))) for k in range(len(w) + 1)]
        assert np.allclose(lp, want, atol=1e-4), w
    for context in ((0, 0, 0), (2, 3, 2), (9, 9, 9)):  # probabilities of all symbols sum to one
        packed = np.array([sum(c << Q.BITS * (3 - k) for k, c in enumerate((*context, x))) for x in range(Q.SYMBOLS)])
        assert abs((2.0 ** Q.log2_probability(model, packed)).sum() - 1) < 1e-3


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_bands_reject_noise_and_keep_clean_rows(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(120)), "xx") for k in range(300)]
    noise = [(1000 + k, " ".join("".join(rng.choice("qwxz#&%09JKV") for _ in range(8)) for _ in range(120)), "xx") for k in range(5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows + noise], "doc_id long, text string, lang string, m int")
    out = Q.filter_quality(docs)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and kept == set(range(300))


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(80_000))
    rows = [(1, None, "en"), (2, "", None), (3, "few words", "en"), (4, "few words", None), (4, "few words", None), (None, long, "en"), (7, "ü" * 5000 + " " + "b " * 60, "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, n_words int, gram int")
    assert [r.doc_id for r in Q.filter_quality(docs).collect()] == [None]
    assert Q.filter_quality(docs.limit(0)).count() == 0


def test_every_character_has_its_own_grams(spark):
    """More characters than any one alphabet: none is merged with others, in any language."""
    kana = [chr(c) for c in range(0x3041, 0x3041 + 400)]
    grams = [tuple(Q.byte_grams([c.encode()])[0].tolist()) for c in [*kana, *map(chr, range(0x21, 0x7F)), "é", "\U0001F600", "\x00"]]
    assert len(set(grams)) == len(grams)
    assert all(x % Q.SYMBOLS != Q.OTHER for g in grams for x in g)
    # frequent characters first, then a rare one that is in a word and one that is nowhere
    rows = [(k, " ".join(kana[:100]) + " " + kana[300], "ja") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = Q.Scorer(Q.train(docs), "ja")
    s.add({c.encode() for c in (kana[300], kana[350], "x")})
    assert s.cost[kana[300].encode()] < s.cost[kana[350].encode()] < s.cost[b"x"]


def test_bands_are_exact_quartiles(spark):
    """More values than a sketch keeps: the quartiles are values at their exact places."""
    from pyspark.sql import functions as F
    n = 60_000
    x = (F.pow((F.col("id") * 7919 % n).cast("double"), F.lit(1.5))).alias("log2ppl")
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("en")).alias("lang"), F.struct((F.col("id") % 5 == 0).alias("failed"), x).alias("m"))
    got = Q.bands(rows.union(rows), width=1.0)
    want = {}
    for lang, keep in (("en", lambda k: k % 3 > 0), ("", lambda k: k % 3 == 0)):
        v = sorted({float(k * 7919 % n) ** 1.5 for k in range(n) if keep(k) and k % 5})
        q = [v[-(-k * len(v) // 4) - 1] for k in (1, 2, 3)]
        want[lang] = (q[1] - (q[2] - q[0]), q[1] + (q[2] - q[0]))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    assert Q.bands(rows.filter("m.failed")) == {}


def plain_bigrams(texts):
    """The words' model by dictionaries: bits of every word of a text, its own count taken out."""
    spelled = Counter(w for t in texts for w in t.split())
    p, sym = plain_model(Counter({w.encode().decode("latin-1"): n for w, n in spelled.items()}), Q.BYTES)
    after = lambda t: list(zip(["", "", *t.split()], ["", *t.split()], t.split()))
    c = Counter((u, w) for _, u, w in {g for t in texts for g in after(t)})
    before = Counter(w for _, w in c)
    d, e = (Q.discounts(np.array(list(x.values()))) for x in (c, before))

    def bits(u, w):
        s = [Q.END] * (Q.ORDER - 1) + [sym(x) for x in w.encode().decode("latin-1")] + [Q.END]
        p0 = 2.0 ** max(-Q.WORD_BITS, sum(math.log2(p(tuple(s[k:k + Q.ORDER]))) for k in range(len(s) - Q.ORDER + 1)))
        one = {x: n - (x == w and c[u, w] == 1) for x, n in before.items()}
        two = {x: n - (x == w) for (v, x), n in c.items() if v == u}

        def mixed(n, disc, below):
            total = sum(n.values())
            return (max(n[w] - disc[min(n[w], 3)], 0) + sum(disc[min(x, 3)] for x in n.values()) * below) / total if total else below

        return min(Q.WORD_BITS, -math.log2(mixed(two, d, mixed(one, e, p0))))

    return lambda t: [bits(u, w) for _, u, w in after(t)]


def test_words_against_a_plain_model(spark):
    """Every bigram of every text, in one text's order, across lines, twice in a text and over repeated rows."""
    rng = random.Random(9)
    vocab = ["the", "of", "é", "日本", "a", "b1", "zz", "of,"]
    texts = [" ".join(rng.choices(vocab, range(8, 0, -1), k=rng.randint(1, 25))) for _ in range(25)] + ["once only\nmore", "the", "the of\tthe of the of"]
    docs = spark.createDataFrame([(t, x) for x in ("en", None) for t in texts] + [(texts[0], "en")] * 3 + [(None, "en"), ("", None)], "text string, lang string")
    got = docs.select(Q.text_key(docs.text, docs.lang).alias("t"), "text", "lang").distinct().join(Q.perplexities(docs), "t", "left").collect()
    for x, part in (("en", texts + texts[:1] * 3), (None, texts)):
        plain = plain_bigrams(part)
        for r in got:
            if r.lang == x and r.text:
                want = plain(r.text)
                assert abs(r.log2ppl - sum(want) / len(want)) < 1e-3, r
    assert [r.log2ppl for r in got if not r.text] == [None, None]


def test_order_of_words_counts(spark):
    """The same words in another order are another text; copies of it don't make it likely."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    follow = {w: rng.sample(vocab, 4) for w in vocab}
    texts = []
    for _ in range(200):
        words = [rng.choice(vocab)]
        while len(words) < 120:
            words.append(rng.choice(follow[words[-1]]))
        texts.append(" ".join(words))
    salad = texts[0].split()
    rng.shuffle(salad)
    rows = [(k, t, "xx") for k, t in enumerate(texts)] + [(1000 + k, " ".join(salad), "xx") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in Q._scored(docs, [docs.doc_id, docs.lang], "m").collect()}
    ppl = {k: r.m.log2ppl for k, r in found.items()}
    assert abs(found[0].m.spelling - found[1000].m.spelling) < 1e-9  # by spelling they are one
    assert ppl[1000] > max(ppl[k] for k in range(200)) + 2
    assert {r.doc_id for r in Q.filter_quality(docs).collect()} == set(range(200))
