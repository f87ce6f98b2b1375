"""What each filter of a chain removes, by itself and because of the others.

Documents go through a chain of filters; what a filter removes depends on the
filters before it. All a chain's numbers follow from one small table: for each
part of the corpus and each set of filters a document fails, the number of
documents (all, good, toxic). ``fail_counts`` builds it with Spark, at most
``2 ** filters`` rows a part.

From it, ``v(S)`` is the number of documents that fail a filter of the coalition
S. ``v`` is the removal game of a part: a step that applies f after the filters
S removes ``v(S + f) - v(S)``. Its Hart-Mas-Colell potential P is the one
function on coalitions with P({}) = 0 and

    sum over f in S of (P(S) - P(S - f)) = v(S),

so P(S) = (v(S) + sum of P(S - f)) / |S|, a recursion over the coalitions by size;
a filter's Shapley value is P(all) - P(all - f). With P scaled by the number of
orders every step stays a whole number.

The filters of this audit, on whole texts (words: runs of other characters than
\\x20 and \\x09-\\x0D): A under 50 words; B fewer than 65 distinct words in 100;
C more than 5 of 100 characters are A-Z; D holds one of #$%&*|; E the same text
has a smaller doc_id somewhere in the table, whether that one is removed or not.

Defined results: null text is empty (fails A); a null source is the part ''; rows
that repeat a doc_id count one by one, and of equal texts with the smallest
doc_id none fails E; a row with a null doc_id never fails E, makes no other row
fail it, and has no label; a document is good or toxic if any of its labels says
1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import map_text, prepare, table, text_bytes, written

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_SHARE = 65
CAPITAL_SHARE = 5
#: fixed values: the characters of filters C and D
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = re.compile(rb"[#$%&*|]")
_SAME = 1 << FILTERS.index("E")


def text_failures(text: bytes, points: int) -> int:
    """Bit set of the filters A to D that a text (UTF-8, of so many code points) fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * len(words),
              100 * capitals > CAPITAL_SHARE * points, SYMBOLS.search(text) is not None)
    return sum(1 << k for k, x in enumerate(failed) if x)


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """``part, doc_id, failed`` (bits of A to D) and a 128-bit hash of the text, a row for each document."""
    import xxhash

    def batch(b: pa.RecordBatch) -> dict:
        texts = text_bytes(b.column("text"))
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), ">i8").reshape(-1, 2)
        points = [len(t.as_py() or "") for t in b.column("text")]
        return {"part": b.column("part"), "doc_id": b.column("doc_id"), "failed": [text_failures(t, n) for t, n in zip(texts, points)],
                "h1": pa.array(hashes[:, 0].astype(np.int64)), "h2": pa.array(hashes[:, 1].astype(np.int64))}

    named = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_text(named, "part string, doc_id long, failed int, h1 long, h2 long", batch)


def fail_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, failed, n, good, toxic``: documents by the set of filters they fail.

    The first of equal texts is found by an aggregate on the hash and joined back
    by (doc_id, hash), so a text that a third of all rows hold is no hot key."""
    rows = written(failures(docs, part), "audit-rows")
    known = rows.filter(F.col("doc_id").isNotNull())
    first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    named = (known.join(first, ["doc_id", "h1", "h2"], "left").join(marks, "doc_id", "left")
             .select("part", F.when(F.col("first"), F.col("failed")).otherwise(F.col("failed").bitwiseOR(F.lit(_SAME))).alias("failed"),
                     F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    no_id = rows.filter(F.col("doc_id").isNull()).select("part", "failed", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(no_id).groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """v(S) of every coalition S from documents by failed set; both along the last axis."""
    k = np.arange(counts.shape[-1])
    return counts @ ((k[:, None] & k) != 0).astype(counts.dtype)


def potentials(value: np.ndarray) -> np.ndarray:
    """The potential of every coalition times the number of orders, along the last axis."""
    size = value.shape[-1]
    players = size.bit_length() - 1
    scale, out = factorial(players), np.zeros_like(value)
    for s in sorted(range(1, size), key=int.bit_count):
        below = sum(out[..., s & ~(1 << f)] for f in range(players) if s >> f & 1)
        out[..., s] = (scale * value[..., s] + below) // s.bit_count()  # exact: P(S) is a sum of v(T) over |S|!
    return out


def shapley(value: np.ndarray) -> np.ndarray:
    """Every filter's Shapley value times the number of orders."""
    p, full = potentials(value), value.shape[-1] - 1
    return np.stack([p[..., full] - p[..., full & ~(1 << f)] for f in range(full.bit_length())], axis=-1)


_STEPS = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part's every order of ``filters``, a row for each step. ``counts``: as of
    ``fail_counts``, with bits in the order of ``filters``."""
    size = 1 << len(filters)
    orders = list(permutations(range(len(filters))))
    f = np.array(orders).reshape(-1)
    before = np.array([sum(1 << x for x in o[:k]) for o in orders for k in range(len(o))])
    after = before | 1 << f
    order = pa.array(["".join(filters[x] for x in o) for o in orders for _ in o])
    step = pa.array(np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders)))
    letter = pa.array([filters[x] for x in f.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets in zip(b.column("part").to_pylist(), b.column("sets").to_pylist()):
                table_ = np.zeros((3, size), np.int64)
                for s in sets:
                    table_[:, s["failed"]] = s["n"], s["good"], s["toxic"]
                all_, good, toxic = removal_game(table_)
                gone = all_[after] - all_[before]
                columns = (int(table_[0].sum()) - all_[after], gone, all_[1 << f] - gone, table_[0][1 << f],
                           good[after] - good[before], toxic[after] - toxic[before], shapley(all_)[f])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(f)), order, step, letter, *map(pa.array, columns)],
                    names=[c.split()[0] for c in _STEPS.split(", ")])

    # a part has at most `size` sets
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    return sets.mapInArrow(run, _STEPS)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters for every source, step by step, with Shapley values."""
    prepare(spark)
    return audit(written(fail_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "audit-counts"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP11_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT doc_id, part, t, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITAL_SHARE} * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS failed
    FROM w LEFT JOIN l USING (doc_id)
), c AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([1, 2, 4, 8, 16]) AS bit
), p AS (
    SELECT a.filter || b.filter || c.filter || d.filter || e.filter AS filter_order
    FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
    SELECT filter_order, step, filter, bit,
           coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS prior
    FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM p) q JOIN f ON substr(filter_order, step, 1) = filter
), r AS (
    SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (WHERE failed & (prior | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE failed & prior = 0 AND failed & bit > 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE failed & prior > 0 AND failed & bit > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE failed = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE failed & prior = 0 AND failed & bit > 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE failed & prior = 0 AND failed & bit > 0), 0) AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM r
"""
