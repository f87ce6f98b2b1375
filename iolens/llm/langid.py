"""Language identification by nearest centroid.

A text's features are hashed character trigrams (over the UTF-8 bytes of the
lower-cased text, every run of ASCII characters other than letters read as one
space), weighted (1 + ln count) * idf and scaled to length one. Every language
has a few centroids, found by spherical k-means, and a text belongs to the
language of the centroid with the highest cosine.

What covers what: document frequencies count every training document. The
centroids are a classifier and are fitted on a bounded sample, at most
``SAMPLE`` different texts of each language. A text is *rejected* if its
distance to the nearest centroid is out of the ordinary for texts of its
length: cosine under ``REJECT`` times the median cosine of the sample's texts
of that language and length class.

Defined results: null text, or text without a letter, is ``und`` with score 0
and rejected; without any training document all texts are; ties between
centroids go to the language that sorts first; repeated rows get one result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import map_text, prepare, table, written

BITS = 13
DIM = 1 << BITS
CLUSTERS = 4
SAMPLE = 800
ROUNDS = 12
REJECT = 0.5
#: most bytes of centroids that are sent to the workers
MODEL_BYTES = 256 << 20
LENGTH_CLASSES = 24
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_STEP = 64


def grams(text: str) -> np.ndarray:
    """Bucket of every trigram of a text."""
    b = b" " + b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split()) + b" "
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    return (((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts, one row per text, and the number of trigrams of each."""
    out, size = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        g = grams(t)
        if len(g):
            out[k] = np.bincount(g, minlength=DIM)
        size[k] = len(g)
    return out, size


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (zero where there is nothing to count)."""
    v = np.zeros_like(count)
    np.log(count, out=v, where=count > 0)
    v += count > 0
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def length_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), LENGTH_CLASSES - 1)


@dataclass
class Model:
    """``langs`` of the centroids' rows, the centroids, idf, and the least
    accepted cosine by language (rows) and length class."""
    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: dict[str, np.ndarray]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        lang, score, bad = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return lang, score, bad
        told = [k for k, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(told), _STEP):
            part = told[at:at + _STEP]
            count, size = counts([texts[k] for k in part])
            cos = vectors(count, self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for k, b, c, n in zip(part, best, cos[np.arange(len(part)), best], length_class(size)):
                lang[k] = self.langs[b]
                score[k] = min(1.0, max(0.0, float(c)))
                bad[k] = score[k] < self.floor[lang[k]][n]
        return lang, score, bad


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``k`` unit centroids of unit rows; starts from far-apart rows."""
    mean = x.mean(axis=0)
    start = [int((x @ mean).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        start.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = new / np.where(norm > 0, norm, 1)
        if np.allclose(new, c):
            break
        c = new
    return c


def floors(cos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least accepted cosine by length class; classes with under five texts take
    the nearest shorter class that has them, or else zero."""
    out, last = np.zeros(LENGTH_CLASSES), 0.0
    cls = length_class(size)
    for n in range(LENGTH_CLASSES):
        here = cos[cls == n]
        if len(here) >= 5:
            last = REJECT * float(np.median(here))
        out[n] = last
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of different (lang, h): copies of a text go before they are shuffled."""
    seen: set[tuple[str, int]] = set()
    for b in batches:
        take = []
        for at, x in enumerate(zip(b.column("lang").to_pylist(), b.column("h").to_pylist())):
            if x not in seen:
                seen.add(x)
                take.append(at)
        if take:
            yield b.take(pa.array(take, pa.int64()))


def fit(train: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Model from rows of ``text`` and ``lang``; rows where either is null or the
    text has no letter don't count."""
    prepare(train.sparkSession)
    train = train.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(DIM, np.int64), {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if has_letter(text):
                    df[np.unique(grams(text))] += 1
                    docs[lang] = docs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at) + list(docs), pa.string()),
                                          pa.array([*at.tolist(), *[-1] * len(docs)], pa.int64()),
                                          pa.array([*df[at].tolist(), *docs.values()], pa.int64())],
                                         names=["lang", "bucket", "n"])

    # DIM rows and one for each language
    seen = train.mapInArrow(frequencies, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    docs = {r.lang: r.n for r in seen if r.bucket < 0}
    if not docs:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(DIM, np.float32), {})
    if len(docs) * clusters * DIM * 4 > MODEL_BYTES:
        raise ValueError(f"{len(docs)} languages make more than {MODEL_BYTES} bytes of centroids")
    df = np.zeros(DIM)
    for r in seen:
        if r.bucket >= 0:
            df[r.bucket] = r.n
    idf = (np.log((1 + sum(docs.values())) / (1 + df)) + 1).astype(np.float32)

    # different texts by the least hashes: as many as wanted, from about twice as
    # many candidates. Copies don't count: a language's share is that of its different texts
    top = (1 << 63) - 1
    h = train.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    distinct = {r.lang: r.n for r in h.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language

    def draw(part: dict[str, int]) -> DataFrame:
        limit = F.element_at(F.create_map(*[F.lit(x) for item in part.items() for x in item]), F.col("lang"))
        some = h.filter(F.abs(F.when(F.col("h") < -top, F.lit(top)).otherwise(F.col("h"))) <= limit)
        some = some.mapInArrow(_once, "text string, lang string, h long").dropDuplicates(["lang", "h"])
        some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample)
        return written(some, "langid-sample")

    limits = {lang: min(top, 2 * sample * top // max(n, 1)) for lang, n in distinct.items()}
    if not limits:
        return Model([], np.zeros((0, DIM), np.float32), idf, {})
    some = draw(limits)
    got = {r.lang: r.n for r in some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a cut language has more than `sample` different texts
    short = {lang: top for lang, n in limits.items() if n < top and got.get(lang, 0) < sample}
    if short:
        some = some.filter(~F.col("lang").isin(*short)).union(draw(short))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        lang = group["lang"].iloc[0]
        texts = [t for t in group.sort_values("h")["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroids": [], "floor": []})
        count, size = counts(texts)
        x = vectors(count, idf)
        c = spherical_kmeans(x, clusters).astype(np.float32)
        return pd.DataFrame({"lang": [lang], "centroids": [c.tobytes()], "floor": [floors((x @ c.T).max(axis=1), size).tobytes()]})

    rows = sorted(some.groupBy("lang").applyInPandas(one, "lang string, centroids binary, floor binary").collect(), key=lambda r: r.lang)
    if not rows:
        return Model([], np.zeros((0, DIM), np.float32), idf, {})
    c = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIM) for r in rows]
    return Model([r.lang for r, x in zip(rows, c) for _ in x], np.concatenate(c), idf, {r.lang: np.frombuffer(r.floor) for r in rows})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row."""
    def batch(b: pa.RecordBatch) -> dict:
        lang, score, bad = model.predict(b.column("text").to_pylist())
        return {"doc_id": b.column("doc_id"), "lang_pred": lang, "score": score, "rejected": bad}

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    "doc_id long, lang_pred string, score double, rejected boolean", batch)


def accepted(model: Model, text: Column) -> Column:
    """Whether the model knows the language of a text."""
    @F.pandas_udf("boolean")
    def known(t: pd.Series) -> pd.Series:
        return pd.Series(~model.predict([x if isinstance(x, str) else None for x in t])[2])

    return known(text)


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those with crc32(doc_id) mod 4 other than 2."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(F.col("lang").isNotNull() & (F.coalesce(remainder(), F.lit(0)) != 2)))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
