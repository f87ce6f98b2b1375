"""Lines that many documents share, kept in one of them: levelled sorted runs of line hashes.

A line's key is the line without the white space at its ends, A-Z in lower case;
keys under ``SHORTEST`` code points are left alone. A key found in at least
``LEAST_DOCS`` documents loses all its lines except those of its *keeper*, the
largest doc_id that holds it.

``Runs`` holds what has been seen: sorted runs of (hash, documents, keeper), each
a table sorted by hash, which a batch meets in one merge join. Documents come in batches, newest (largest
doc_id) first. A batch's keys are aggregated, merged with every run, and the
keys that no run knows (the anti join) get their keeper from this batch; known
ones only add to the number of documents. The result is the batch's own run, on
level 0. ``FAN`` runs of a level are compacted into one of the next, so there are
at most ``FAN`` runs a level and a row is rewritten once a level.

The runs merged give the repeated keys. A line's place (document, position) is
joined to them by hash; a document's dropped positions are one list, and its
lines meet that list by a join on the document. Everything is DataFrame
functions. A hot line is one row in every run; its places are many, and the
join with the repeated keys is one whose large partitions Spark splits.

Hashes have 128 bits (two differently seeded 64-bit hashes).

Defined results: null or empty text is one empty line; rows that repeat a doc_id
count as one document and keep or lose the same keys, each row on its own; null
doc_ids count as one document, smaller than all others, that never keeps a
repeated key; texts that repeat inside a document count once; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, prepare, table, written
from iolens.session import scratch_path

SHORTEST = 20
LEAST_DOCS = 3
#: ranges of doc_id that a table is fed in, and runs of a level that are compacted into one
BATCHES = 4
FAN = 3
#: white space that a key loses at its ends (fixed value)
SPACE = " \t\n\x0b\x0c\r"
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """A line's key. ``lower`` changes A-Z only where a string has no other letters than ASCII's."""
    cut = F.trim(line, F.lit(SPACE))
    return (F.when(F.octet_length(cut) == F.length(cut), F.lower(cut))
            .otherwise(F.translate(cut, string.ascii_uppercase, string.ascii_lowercase)))


def places(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id``, ``row`` (a hash of the text), ``pos`` (from 0) and the hash of every line with a key long enough."""
    lines = doc_text(docs).select("doc_id", F.xxhash64("text").alias("row"),
                                  F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= shortest)
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class Runs:
    """Levelled sorted runs of line hashes: ``h1, h2, docs, keeper``. In all runs
    together a key has one row with a keeper; its other rows have null there."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.levels: list[list[DataFrame]] = []

    def __iter__(self) -> Iterator[DataFrame]:
        return (run for level in self.levels for run in level)

    def _write(self, rows: DataFrame) -> DataFrame:
        # dealt by hash already: the rows come out of an aggregate by hash
        return written(rows.sortWithinPartitions(*HASH), "line-run")

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of ``places``; returns its own run. The keeper of a key that no run knows is the batch's largest doc_id."""
        found = (batch.select(*HASH, "doc_id").distinct().groupBy(*HASH)
                 .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")))
        known = F.lit(False)
        for k, run in enumerate(self):
            found = found.join(run.select(*HASH, F.lit(True).alias(f"in{k}")), list(HASH), "left")
            known = known | F.col(f"in{k}").isNotNull()
        own = self._write(found.select(*HASH, "docs", F.when(~known, F.col("keeper")).alias("keeper")))
        self._push(0, own)
        return own

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            self._push(level + 1, self._write(self._merged(self.levels[level])))
            self.levels[level] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """``h1, h2, keeper`` of the keys that at least so many documents hold."""
        return self._merged(list(self)).filter(F.col("docs") >= least_docs).drop("docs")


def borders(docs: DataFrame, batches: int = BATCHES) -> list[int]:
    """Ascending doc_ids that cut the table into about equal batches."""
    cuts = [k / batches for k in range(1, batches)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), cuts).alias("cut")).first()["cut"] if cuts else None
    return sorted(set(got or []))


def dropped(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, shortest: int = SHORTEST, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, row, gone``: the dropped positions of every text that loses a line."""
    spark = docs.sparkSession
    cuts = borders(docs, batches)
    # batch 0 has the largest ids, the last the smallest and null
    batch = F.lit(len(cuts)) - sum((F.when(F.col("doc_id") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch_path(spark, "line-places")
    placed = places(docs, shortest).withColumn("batch", batch)
    placed.write.partitionBy("batch").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    runs = Runs(spark, fan)
    for k in range(len(cuts) + 1):
        runs.add(placed.filter(F.col("batch") == k))
    keys = written(runs.repeated(least_docs), "line-repeated")
    return (placed.join(keys, list(HASH)).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone")))


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every row's text without the lines it loses."""
    gone = dropped(docs, **parameters).withColumnsRenamed({"doc_id": "g_id", "row": "g_row"})
    lines = doc_text(docs).select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    both = lines.join(gone, lines["doc_id"].eqNullSafe(F.col("g_id")) & (F.col("row") == F.col("g_row")), "left")
    # array_except works by a hash set and keeps the order: linear in the text
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return both.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Drop the lines that three documents or more share, but for the largest doc_id's."""
    prepare(spark)
    return deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH d AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l
), r AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {SHORTEST}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), m AS (
    SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
