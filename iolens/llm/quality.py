"""Quality rules with n-gram perplexity bands.

Every word of every text is predicted from the word before it, by one modified
Kneser-Ney model of word bigrams a language. A bigram counts once for each different
word before it, as Kneser-Ney counts lower orders: copies of a passage, whole or near,
add nothing and so don't foretell each other. Below it is how many different words
stand before its second word, and below that the word's spelling, so that unseen
words have probabilities too. A document's perplexity is that of its
words in their order, per word; a word counts at most ``WORD_BITS`` bits, so that a
few addresses or hashes don't make a text look foreign. Its spelling's perplexity is
that of the same words by spelling alone. A document is rejected outside its
language's band of either, or if a base rule fails.

Every occurrence is predicted with its own count taken out, as otherwise a word that
occurs once would foretell what follows it.

The words' model grows with the texts: all different trigrams, as 64-bit numbers of
words, are dealt out by their bigrams, and the bigrams are rows of a Spark table that no process holds. Contexts and last
words are joined to it, then its costs to the bigrams of the texts, whose bits are
summed by the 64-bit hash of text and language. Bits are whole multiples of
``1 / PARTS``: their sums don't depend on the order of rows. Figures in the README.

Spelling is a modified Kneser-Ney model too, of byte n-grams inside words. Every
character of every script is spelled by its UTF-8 bytes, so none is left out or
merged with others; the 237 bytes that occur in words and one symbol for word ends
fit 8 bits, an n-gram of order 4 packs into 32, and the hash of an n-gram is
injective. How many n-grams a language has is a matter of its script and not of the
table's size: 94**4 if its ASCII is pure noise, some millions in texts. The arrays of
an order are sorted by hash and searched in bulk; they are files in the shared
folder, which a worker loads when it meets the language.

The bands of a language: between ``median - WIDTH * IQR`` and ``median + WIDTH *
IQR`` of each log2 perplexity over all its documents that pass the base rules, equal
perplexities counted once (a large group of copies must not narrow the band),
with an IQR of ``LEAST_IQR`` bits at least.

Defined results: null or empty text has no words and fails the base rules; a
null language is a language of its own; repeated rows count each in the spelling's
model and once in the words', and get one result each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import prepare, table, written
from iolens.plans.order import number_in_cells
from iolens.session import scratch_path

ORDER = 4
SYMBOLS = 256
BITS = 8
END, OTHER = 0, 1
#: every byte of a word in UTF-8: no white space, none of the 13 that UTF-8 never has
BYTES = np.array([b for b in range(0xF5) if b not in b" \t\n\v\f\r\xc0\xc1"], np.uint32)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WIDTH = 8.0
WORD_BITS = 48.0
LEAST_IQR = 0.25
#: words counted in a task before they are passed on
CACHE_WORDS = 500_000
#: trigrams gathered in a task before they are passed on, and rows of a batch that passes them
CACHE_PAIRS = 2_000_000
BATCH_PAIRS = 100_000
#: a bit's parts in sums of costs
PARTS = 1 << 10
#: words whose scores a worker keeps, and languages whose models it keeps
SCORED_WORDS = 300_000
HELD_MODELS = 16
_SYMBOL_CHARS = "#*$%&|<>"


# ------------------------------------------------------------------ base rules

def base_rules(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOL_CHARS))
    dup_lines = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen = set()
            for x in lines:
                if x in seen:
                    dup_lines += bool(x.encode().split())
                else:
                    seen.add(x)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        until = 0  # words before this place are counted
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeat += k + 3 - max(k, until)
                until = k + 3
    return len(text) - spaces, symbols, dup_lines, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


# ----------------------------------------------------------------- the counts

def _language(lang) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all documents; word is UTF-8."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}

        def out():
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()),
                                                  pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            by.clear()

        for b in batches:
            for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist()):
                by.setdefault(lang, Counter()).update((text or b"").split())
            if sum(map(len, by.values())) > CACHE_WORDS:
                yield from out()
        yield from out()

    got = docs.select("text", _language(F.col("lang")).alias("lang")).mapInArrow(run, "lang string, word binary, n long")
    return got.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_grams(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of order ORDER, one for each character and word end, all
    words one after another, and how many each word has. Places before a word
    are word ends; characters that are not in the alphabet are ``OTHER``."""
    length = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, code), max(0, len(alphabet) - 1))
    sym = np.where(alphabet[at] == code, at + 2, OTHER) if len(alphabet) else np.full(len(code), OTHER)
    pad = ORDER - 1
    ends = np.cumsum(length)
    place = np.arange(len(code)) + np.repeat((np.arange(len(words)) + 1) * pad, length)
    flat = np.zeros(len(code) + pad * (len(words) + 1), np.int64)  # END between words, `pad` times
    flat[place] = sym
    gram = np.zeros(len(flat) - pad, np.int64)
    for k in range(ORDER):
        gram |= flat[k:len(flat) - pad + k] << BITS * (pad - k)
    first = np.r_[0, ends[:-1]] + np.arange(len(words)) * pad  # place of the gram that ends in the first character
    n = length + 1
    take = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return gram[take], n


def byte_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_grams`` of the words' bytes."""
    return word_grams([w.decode("latin-1") for w in words], BYTES)


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, gram, n``: packed n-grams of all documents' words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            n = b.column("n").to_numpy()
            for lang in dict.fromkeys(langs):
                at = np.flatnonzero(langs == lang)
                gram, each = byte_grams([b.column("word")[int(k)].as_py() for k in at])
                keys, inverse = np.unique(gram, return_inverse=True)
                total = np.bincount(inverse, np.repeat(n[at], each), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys),
                                                  pa.array(total)], names=["lang", "gram", "n"])

    return words.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------- the model

def discounts(count: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0: none)."""
    return discounts_of([int((count == k).sum()) for k in range(1, 5)])


def discounts_of(n: list[int]) -> np.ndarray:
    """``discounts`` from how many counts are 1, 2, 3 and 4."""
    d = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                d[k] = k - (k + 1) * y * n[k] / n[k - 1]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted arrays of the interpolated model: for order k ``g{k}`` (packed
    n-grams) with ``p{k}`` (log2 probability), and ``c{k}`` (packed contexts of
    order-k n-grams) with ``b{k}`` (log2 of the weight left for order k-1)."""
    order = np.argsort(gram)
    keys, count = {ORDER: gram[order].astype(np.int64)}, {ORDER: n[order].astype(np.float64)}
    for k in range(ORDER - 1, 0, -1):
        up = keys[k + 1]
        low = up & ((1 << BITS * k) - 1)
        # how many symbols precede it; word beginnings, which only word ends precede, keep their counts
        start = (low >> BITS * (k - 1) == END) if k > 1 else np.zeros(len(low), bool)
        weight = np.where(start, count[k + 1], 1.0)
        keys[k], inverse = np.unique(low, return_inverse=True)
        count[k] = np.bincount(inverse, weight, len(keys[k]))
    out: dict[str, np.ndarray] = {}
    lower = None
    for k in range(1, ORDER + 1):
        d = discounts(count[k])
        bucket = np.minimum(count[k], 3).astype(np.int64)
        context, inverse = np.unique(keys[k] >> BITS, return_inverse=True)
        total = np.bincount(inverse, count[k], len(context))
        left = np.bincount(inverse, d[bucket], len(context)) / total
        if k == 1:
            below = np.full(len(keys[k]), 1 / SYMBOLS)
        else:
            below = lower[np.searchsorted(keys[k - 1], keys[k] & ((1 << BITS * (k - 1)) - 1))]
        lower = np.maximum(count[k] - d[bucket], 0) / total[inverse] + left[inverse] * below
        out |= {f"g{k}": keys[k].astype(np.uint32), f"p{k}": np.log2(lower).astype(np.float32),
                f"c{k}": context.astype(np.uint32), f"b{k}": np.log2(np.maximum(left, 1e-12)).astype(np.float32)}
    return out


def log2_probability(model: dict[str, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """log2 p(symbol | its context) of packed n-grams, by backing off."""
    out = np.zeros(len(gram))
    todo = np.arange(len(gram))
    for k in range(ORDER, 0, -1):
        g = gram[todo] & ((1 << BITS * k) - 1)
        keys = model[f"g{k}"]
        at = np.minimum(np.searchsorted(keys, g.astype(keys.dtype)), len(keys) - 1)
        hit = keys[at] == g
        out[todo[hit]] += model[f"p{k}"][at[hit]]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            break
        context = model[f"c{k}"]
        at = np.minimum(np.searchsorted(context, (g >> BITS).astype(context.dtype)), len(context) - 1)
        known = context[at] == g >> BITS
        out[todo[known]] += model[f"b{k}"][at[known]]
    out[todo] += -np.log2(SYMBOLS)
    return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train(docs: DataFrame, words: DataFrame | None = None) -> str:
    """Spelling model of every language in ``docs`` (text, lang): a file each in a
    folder of the shared file system, whose URI is returned. ``words``: their
    ``word_counts``, if at hand."""
    spark = docs.sparkSession
    words = written(word_counts(docs), "quality-words") if words is None else words
    folder = scratch_path(spark, "quality-models")

    def build(group: pa.Table) -> pa.Table:
        # the different n-grams of one language
        lang = group["lang"][0].as_py()
        model = kneser_ney(group["gram"].to_numpy(), group["n"].to_numpy())
        buffer = io.BytesIO()
        np.savez(buffer, **model)
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name = _file(lang)
        # under its final name only when whole; an attempt that runs twice writes the same bytes
        part = f"{path}/.{name}-{np.random.default_rng().integers(1 << 62):x}"
        with store.open_output_stream(part) as f:
            f.write(buffer.getvalue())
        store.move(part, f"{path}/{name}")
        return pa.table({"lang": [lang], "rows": [len(group)]})

    gram_counts(words).groupBy("lang").applyInArrow(build, "lang string, rows long").collect()  # a row a language
    return folder


def _file(lang: str) -> str:
    return f"m-{hashlib.sha256(lang.encode()).hexdigest()}.npz"


class Scorer:
    """Negative log2 probability of words, from a bounded cache where possible."""

    def __init__(self, folder: str, lang: str):
        store, path = _open(folder)
        with store.open_input_stream(f"{path}/{_file(lang)}") as f:
            with np.load(io.BytesIO(f.read())) as z:
                self.model = {k: z[k] for k in z.files}
        self.cost: dict[bytes, float] = {}

    def add(self, words: set[bytes]) -> None:
        new = list(words.difference(self.cost))
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            gram, n = byte_grams(part)
            cost = -np.add.reduceat(log2_probability(self.model, gram), np.cumsum(n) - n)
            self.cost.update(zip(part, np.minimum(cost, WORD_BITS).tolist()))


#: this worker's scorers, of one model folder at a time
_HELD: dict[tuple[str, str], Scorer] = {}


def scorer(folder: str, lang: str) -> Scorer:
    if (folder, lang) not in _HELD:
        if any(f != folder for f, _ in _HELD):
            _HELD.clear()
        _HELD[folder, lang] = Scorer(folder, lang)
    return _HELD[folder, lang]


def trim() -> None:
    """Between batches: keep what a worker holds within ``SCORED_WORDS`` and ``HELD_MODELS``."""
    if len(_HELD) > HELD_MODELS:
        _HELD.clear()
    if sum(len(s.cost) for s in _HELD.values()) > SCORED_WORDS:
        for s in _HELD.values():
            s.cost.clear()


# ------------------------------------------------------------- the words' model

class Numbers:
    """64-bit numbers of a language's words, from a bounded cache where possible.
    The number of ``b""`` stands before a text's first word."""

    def __init__(self):
        self.known: dict[str, dict[bytes, int]] = {}

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        if sum(map(len, self.known.values())) > CACHE_WORDS:
            self.known.clear()
        known = self.known.setdefault(lang, {})
        name = lang.encode()
        of_lang = hashlib.blake2b(b"%d:" % len(name) + name, digest_size=8)
        for w in set(words).difference(known):
            h = of_lang.copy()
            h.update(w)
            known[w] = int.from_bytes(h.digest(), "little", signed=True)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def text(self, lang: str, words: list[bytes]) -> np.ndarray:
        """A text's words, after two of ``b""``."""
        return self(lang, [b"", b"", *words])


def _slices(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), BATCH_PAIRS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k:k + BATCH_PAIRS]) for c in columns], names=names)


def word_pairs(docs: DataFrame, place: dict[str, int]) -> DataFrame:
    """``l, u, w, c``: after how many different words ``u w`` stands in the documents of a language, whose place is ``l``."""
    names = ["l", "x", "u", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = Numbers(), {}

        def out():
            for lang, texts in held.items():
                x, u, w = (np.concatenate([t[k:len(t) - 2 + k] for t in texts]) for k in range(3))
                order = np.lexsort((x, w, u))
                x, u, w = x[order], u[order], w[order]
                first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (x[1:] != x[:-1])])
                yield from _slices(names, [np.full(len(first), place[lang], np.int32), x[first], u[first], w[first]])
            held.clear()

        for b in batches:
            for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist()):
                if words := (text or b"").split():
                    held.setdefault(lang, []).append(numbers.text(lang, words))
            if sum(len(t) for x in held.values() for t in x) > CACHE_PAIRS:
                yield from out()
        yield from out()

    got = docs.select("text", _language(F.col("lang")).alias("lang")).mapInArrow(run, "l int, x long, u long, w long")
    # dealt out once: the different trigrams of a bigram are in one place
    return got.repartition("u", "w").distinct().groupBy("l", "u", "w").agg(F.count(F.lit(1)).alias("c"))


def text_key(text: Column, lang: Column) -> Column:
    """Rows with equal keys have one perplexity."""
    return F.xxhash64(F.coalesce(text, F.lit("")), _language(lang))


def text_pairs(docs: DataFrame) -> DataFrame:
    """``t, u, w``: a row for each word of each document, with its text's key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            rows = []
            for text, lang, t in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), b.column("t").to_pylist()):
                if words := (text or b"").split():
                    got = numbers.text(lang, words)
                    rows.append((np.full(len(words), t, np.int64), got[1:-1], got[2:]))
            if rows:
                yield from _slices(["t", "u", "w"], list(map(np.concatenate, zip(*rows))))

    got = docs.select("text", _language(F.col("lang")).alias("lang"), text_key(F.col("text"), F.col("lang")).alias("t"))
    return got.mapInArrow(run, "t long, u long, w long")


def spelled(words: DataFrame, folder: str, place: dict[str, int]) -> DataFrame:
    """``l, w, letters``: what a word's spelling costs, in parts of a bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            trim()
            by: dict[str, list[bytes]] = {}
            for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist()):
                by.setdefault(lang, []).append(w)
            for lang, part in by.items():
                s = scorer(folder, lang)
                s.add(set(part))
                yield pa.RecordBatch.from_arrays([pa.array([place[lang]] * len(part), pa.int32()), pa.array(numbers(lang, part)),
                                                  pa.array([round(s.cost[w] * PARTS) for w in part], pa.int32())], names=["l", "w", "letters"])

    return words.select("lang", "word").mapInArrow(run, "l int, w long, letters int")


def _counts_of_counts(count: Column) -> list[Column]:
    return [*[F.sum((count == k).cast("long")).alias(f"n{k}") for k in range(1, 5)], F.sum((count > 2).cast("long")).alias("more"), F.sum(count).alias("total")]


def pair_bits(pairs: DataFrame, last: DataFrame) -> DataFrame:
    """``u, w, bits, letters``: what ``w`` after ``u`` costs, with its own count taken
    out everywhere, and what its spelling does, both in parts of a bit. ``pairs``: l, u, w, c; ``last``: l, w, letters
    and ``before``, the number of different words before it."""
    spark = pairs.sparkSession
    upper = {r.l: r for r in pairs.groupBy("l").agg(*_counts_of_counts(F.col("c"))).collect()}  # a row a language
    lower = {r.l: r for r in last.groupBy("l").agg(*_counts_of_counts(F.col("before"))).collect()}
    rows = []
    for k, r in upper.items():
        d, e = (discounts_of([x.n1, x.n2, x.n3, x.n4]) for x in (r, lower[k]))
        left = e[1] * lower[k].n1 + e[2] * lower[k].n2 + e[3] * lower[k].more
        rows.append((k, *d[1:].tolist(), *e[1:].tolist(), float(left), lower[k].total))
    of_lang = spark.createDataFrame(rows, "l int, d1 double, d2 double, d3 double, e1 double, e2 double, e3 double, low_left double, low_total long")
    context = pairs.groupBy("u").agg(*_counts_of_counts(F.col("c"))).drop("n3", "n4")

    def discount(kind: str, count: Column) -> Column:
        return F.when(count <= 0, 0.0).when(count == 1, F.col(f"{kind}1")).when(count == 2, F.col(f"{kind}2")).otherwise(F.col(f"{kind}3"))

    def mixed(kind: str, count: Column, was: Column, left: Column, total: Column, below: Column) -> Column:
        """Interpolated probability by ``count``, which is ``was`` in ``left``, the discounts of all counts."""
        left = left - discount(kind, was) + discount(kind, count)
        p = (F.greatest(count - discount(kind, count), F.lit(0.0)) + left * below) / F.greatest(total, F.lit(1))
        return F.when(total > 0, p).otherwise(below)

    once = (F.col("c") == 1).cast("long")  # then the bigram itself is out
    all_left = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("more")
    p1 = mixed("e", F.col("before") - once, F.col("before"), F.col("low_left"), F.col("low_total") - once, F.pow(F.lit(2.0), -F.col("letters") / PARTS))
    p2 = mixed("d", F.col("c") - 1, F.col("c"), all_left, F.col("total") - 1, F.col("p1"))
    each = pairs.join(last.drop("l"), "w").join(context, "u").join(F.broadcast(of_lang), "l").withColumn("p1", p1)
    bits = F.round(F.least(-F.log2(p2), F.lit(WORD_BITS)) * PARTS).cast("int")
    return each.select("u", "w", bits.alias("bits"), "letters")


def perplexities(docs: DataFrame) -> DataFrame:
    """``t, log2ppl, spelling``: log2 perplexities per word of every text with words, by ``text_key``."""
    words = written(word_counts(docs), "quality-words")
    folder = train(docs, words)
    place = {r.lang: k for k, r in enumerate(words.select("lang").distinct().collect())}
    pairs = written(word_pairs(docs, place), "quality-pairs")
    before = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before"))
    last = written(spelled(words, folder, place).join(before, "w"), "quality-last")
    pair = F.xxhash64("u", "w").alias("pair")
    bits = pair_bits(pairs, last).select(pair, "bits", "letters")
    mean = lambda c: F.sum(c) / F.count(F.lit(1)) / PARTS
    each = text_pairs(docs).select("t", pair).join(bits, "pair").groupBy("t").agg(mean("bits").alias("log2ppl"), mean("letters").alias("spelling"))
    return written(each, "quality-perplexities")


# ------------------------------------------------------------------ the verdict

_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, failed: boolean>"


def measure(text: Column) -> Column:
    """A struct of the base counts and whether they fail."""
    @F.pandas_udf(_MEASURED)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = t.encode().split()
            chars, symbols, dup, repeat = base_rules(t, words)
            rows.append((len(words), chars, symbols, dup, repeat, base_failed(len(words), repeat)))
        return pd.DataFrame(rows, columns=[*_COLUMNS, "failed"])

    return measured(F.coalesce(text, F.lit("")))


def _scored(docs: DataFrame, keep: list[Column], name: str) -> DataFrame:
    """``keep`` of every row of ``docs``, and the struct ``name``: base counts, failed, log2ppl, spelling."""
    found = perplexities(docs).select(F.col("t").alias(f"{name}t"), F.struct("log2ppl", "spelling").alias(f"{name}p"))
    rows = docs.select(*keep, text_key(F.col("text"), F.col("lang")).alias(f"{name}t"), measure(F.col("text")).alias(f"{name}b"))
    m = F.struct(F.col(f"{name}b.*"), F.col(f"{name}p.log2ppl"), F.col(f"{name}p.spelling")).alias(name)
    return written(rows.join(found, f"{name}t", "left").select(*[F.col(f"`{c}`") for c in rows.columns[:-2]], m), "quality-scored")


def bands(scored: DataFrame, lang: str = "lang", value: str = "m", width: float = WIDTH, of: str = "log2ppl") -> dict[str, tuple[float, float]]:
    """Band of the log2 perplexity ``of`` by language, over all rows that pass the base rules. Quartiles
    are exact: the values are ordered as a trace is, and those at three places taken."""
    each = scored.filter(~F.col(f"{value}.failed")).select(_language(F.col(lang)).alias("l"), F.col(f"{value}.{of}").alias("x")).distinct()
    each = written(each, "quality-values")
    place = {r.l: [(k * r.n + 3) // 4 - 1 for k in (1, 2, 3)] for r in each.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not place:
        return {}
    at = F.element_at(F.create_map(*[F.lit(x) for k, v in place.items() for x in (k, ",".join(map(str, v)))]), F.col("l"))
    found = number_in_cells(each, ["x"], ["l"]).df.filter(F.array_contains(F.split(at, ",").cast("array<bigint>"), F.col("seq")))
    value_at = {(r.l, r.seq): r.x for r in found.select("l", "seq", "x").collect()}  # three rows a language
    out = {}
    for x, v in place.items():
        low, middle, high = (value_at[x, k] for k in v)
        half = width * max(LEAST_IQR, high - low)
        out[x] = (middle - half, middle + half)
    return out


def inside(band: dict[str, tuple[float, float]], lang: str = "lang", value: str = "m", of: str = "log2ppl") -> Column:
    """Whether the log2 perplexity ``of`` lies in the language's band."""
    if not band:
        return F.lit(False)
    low, high = (F.create_map(*[F.lit(x) for k, v in band.items() for x in (k, float(v[i]))]) for i in (0, 1))
    at = _language(F.col(lang))
    return F.coalesce(F.col(f"{value}.{of}").between(F.element_at(low, at), F.element_at(high, at)), F.lit(False))


def kept(scored: DataFrame, value: str = "m") -> Column:
    """The verdict: base rules pass and both perplexities lie in the language's bands."""
    return ~F.col(f"{value}.failed") & inside(bands(scored, value=value), value=value) & inside(bands(scored, value=value, of="spelling"), value=value, of="spelling")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns text, lang and any others) that are kept, columns as they were."""
    prepare(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    name = "m"
    while any(c.lower() in (name, f"{name}t", f"{name}b", f"{name}p") for c in docs.columns):
        name += "_"
    scored = _scored(docs, columns, name)
    return scored.filter(kept(scored, name)).select(*columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    m = _scored(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang")], "m")
    return m.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in _COLUMNS], F.col("m.failed").alias("base_failed"),
                    kept(m).alias("kept"), F.pow(F.lit(2.0), "m.log2ppl").alias("perplexity"))
