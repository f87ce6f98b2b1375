"""Token ids in Arrow stream files of equal-length sequences.

Layout. A corpus is a folder of shards; a shard is two Arrow IPC stream files:

* ``NAME.ids.arrow``: record batches of exactly ``BATCH_SEQUENCES`` rows (the
  last may be shorter) with two fixed-size lists of ``SEQUENCE`` items each:
  ``ids`` (uint16 if the vocabulary allows, else uint32) and ``mask`` (bool,
  false on the padding after the last document). Documents lie one after
  another, each with its end id, and cross sequence borders.
* ``NAME.docs.arrow``: ``doc_id``, ``start`` (ids before it in the shard),
  ``n_tokens``, in the order they were written.

A ``manifest`` (Parquet) lists the shards in ascending doc_id order with their
number of ids, so a document's place in the whole corpus is its shard's base
plus ``start``. Batches are uncompressed and equal in size: ``Shard`` maps the
file into memory and gives any sequence or token range as numpy views, without
copying, in constant time.

Writing is one Spark job over ranges of doc_id. A task streams its documents
into files with a name of its own, so a task that runs twice (lost executor,
speculation) leaves files that the manifest doesn't name, never a mixed one.

Defined results: null text counts as empty (the end id alone); rows that
repeat a doc_id are written one by one, in the order of their text; rows with a
null doc_id come first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, prepare, table, written
from iolens.llm.tokens import encoder, ids32, vocab_file
from iolens.session import scratch_path

SEQUENCE = 1024
BATCH_SEQUENCES = 64
END_ID = 0
VOCAB = "byte_bpe_50k.json"
_MANIFEST = "shard string, first_doc long, n_docs long, n_ids long, width int"


class Writer:
    """Streams documents into a shard's two files."""

    def __init__(self, store: fs.FileSystem, base: str, width: int, sequence: int = SEQUENCE, rows: int = BATCH_SEQUENCES):
        kind = pa.uint16() if width == 2 else pa.uint32()
        self.width, self.sequence, self.rows, self.kind = width, sequence, rows, kind
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [store.open_output_stream(f"{base}.{x}.arrow") for x in ("ids", "docs")]
        self.out, self.docs = ipc.new_stream(self.files[0], self.schema), ipc.new_stream(self.files[1], self.docs_schema)
        self.wait, self.rows_wait, self.n_ids, self.n_docs = bytearray(), [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.rows_wait.append((doc_id, self.n_ids, n))
        self.n_ids += n
        self.n_docs += 1
        self.wait += ids
        step = self.rows * self.sequence * self.width
        if len(self.wait) >= step:
            whole = len(self.wait) - len(self.wait) % step
            view = bytes(self.wait[:whole])
            del self.wait[:whole]
            for k in range(0, whole, step):
                self._ids(view[k:k + step], self.rows * self.sequence)
        if len(self.rows_wait) >= 10_000:
            self._docs()

    def _ids(self, data: bytes, n: int) -> None:
        size = len(data) // self.width
        ids = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(self.kind, size, [None, pa.py_buffer(data)]), self.sequence)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < n), self.sequence)
        self.out.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def _docs(self) -> None:
        cols = zip(*self.rows_wait)
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=self.docs_schema))
        self.rows_wait = []

    def close(self) -> None:
        n = len(self.wait) // self.width
        if n:
            full = -(-n // self.sequence) * self.sequence
            self._ids(bytes(self.wait) + b"\0" * ((full - n) * self.width), n)
        if self.rows_wait:
            self._docs()
        for x in (self.out, self.docs, *self.files):
            x.close()


class Shard:
    """Random access to a shard. ``uri`` is its path without the endings. A local
    file is mapped and its arrays are views of the mapping; from another store
    the file is read once."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(f"{path}.ids.arrow") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{path}.ids.arrow")
        stream = ipc.open_stream(source)
        self.sequence = stream.schema.field("ids").type.list_size
        self.batches = [b for b in stream]
        self.rows = self.batches[0].num_rows if self.batches else 0
        self.docs = ipc.open_stream(store.open_input_file(f"{path}.docs.arrow"))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _flat(self, batch: int) -> np.ndarray:
        return self.batches[batch].column("ids").flatten().to_numpy(zero_copy_only=True)

    def ids(self, row: int) -> np.ndarray:
        """The ids of a sequence, as a view."""
        b, r = divmod(row, self.rows)
        return self._flat(b)[r * self.sequence:(r + 1) * self.sequence]

    def mask(self, row: int) -> pa.BooleanArray:
        """The mask of a sequence, as a slice of the file's bits."""
        b, r = divmod(row, self.rows)
        return self.batches[b].column("mask")[r].values

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + n`` as views, one for each batch touched."""
        step = self.rows * self.sequence
        while n > 0:
            b, at = divmod(start, step)
            part = self._flat(b)[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write(docs: DataFrame, folder: str, vocab: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Write the corpus to ``folder`` (a URI of the shared file system) in
    ascending doc_id order; returns the manifest with each shard's base, the ids
    in all shards before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        end = np.array([end_id], enc.dtype).tobytes()
        store, path = fs.FileSystem.from_uri(folder)
        out = first = None
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if out is None:
                    name, first = uuid.uuid4().hex, doc
                    store.create_dir(path, recursive=True)
                    out = Writer(store, f"{path}/{name}", enc.width, sequence)
                out.add(doc, enc.bytes_of(text) + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (f"{folder}/{name}", pa.string()), (first, pa.int64()), (out.n_docs, pa.int64()), (out.n_ids, pa.int64()), (enc.width, pa.int32()))],
                names=["shard", "first_doc", "n_docs", "n_ids", "width"])

    dealt = doc_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    got = written(dealt.mapInArrow(run, _MANIFEST), "token-manifest")
    # one row a shard: a file of many documents, so their bases fit the driver
    rows = sorted(got.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0))
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r.n_ids
    spark = docs.sparkSession
    listed = spark.createDataFrame(out, f"{_MANIFEST}, base long")
    listed.write.parquet(f"{folder}/manifest")
    return spark.read.schema(f"{_MANIFEST}, base long").parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, width, base in zip(*(b.column(c).to_pylist() for c in ("shard", "width", "base"))):
                shard = Shard(uri)
                for d in shard.docs:
                    start, n = (d.column(c).to_numpy() for c in ("start", "n_tokens"))
                    crc = []
                    for s, k in zip(start.tolist(), n.tolist()):
                        c = 0
                        for part in shard.tokens(s, k):
                            c = zlib.crc32(ids32(part.tobytes(), width), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(start + base), d.column("n_tokens"), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row is a whole shard's work: deal them out evenly
    n = manifest.count()
    dealt = manifest.repartition(max(1, n), F.col("shard")) if n else manifest
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_id_output(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids as Arrow stream files and describe them as read back."""
    prepare(spark)
    folder = scratch_path(spark, "token-files")
    return read_documents(write(table(spark, sf_dir, "documents"), folder, vocab_file(VOCAB)))
