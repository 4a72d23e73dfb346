"""Token ids of whole texts in Arrow files of fixed-size-list batches.

A shard holds a run of documents in ascending doc_id order as one stream of ids, cut into sequences of equal length.
Column ``input_ids`` is a fixed-size list of unsigned integers, column ``mask`` one of booleans that are false on the
padding of a shard's last sequence. Equal lengths make sequence k of a memory-mapped shard a slice of its buffers, with
no copy. A second file beside it lists the shard's documents. The manifest names the files of each task attempt that
counted; those of a lost attempt are never read.

Rows: a null text is an empty one, of which only the end id is written; repeated doc_ids keep a row each, ordered by
text; a null doc_id comes first; an empty table gives no shard; other columns of any name are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, filesystem, lean, shared_dir, shuffle_partitions
from .tokens import encoder

LENGTH = 2048
#: Sequences in a batch of a file.
BATCH = 256
MANIFEST = "shard int, path string, index_path string, n_ids long, n_docs long"
#: Rows that are encoded together.
ROWS = 1000


class ShardWriter:
    def __init__(self, base: str, width, length: int, pad_id: int):
        self.fs, path = filesystem(base)
        self.fs.create_dir(path.rsplit("/", 1)[0])
        self.paths = [f"{path}.arrow", f"{path}.docs.arrow"]
        self.length, self.width, self.pad_id = length, width, pad_id
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("length", pa.int64())])
        self.sinks = [self.fs.open_output_stream(p) for p in self.paths]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index))]
        self.held, self.size, self.n_ids, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.files[1].write_batch(pa.record_batch([doc_ids, pa.array(lengths, pa.int64())], schema=self.index))
        self.n_docs += len(lengths)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.width)
        step, at = BATCH * self.length, 0
        while len(ids) - at >= step:
            self._write(ids[at : at + step], step)
            at += step
        if last and at < len(ids):
            real = len(ids) - at
            padded = np.full(-(-real // self.length) * self.length, self.pad_id, self.width)
            padded[:real] = ids[at:]
            self._write(padded, real)
            at = len(ids)
        self.held, self.size = [ids[at:]], len(ids) - at

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for f, s in zip(self.files, self.sinks):
            f.close()
            s.close()


class ShardReader:
    """Random access to the sequences of a shard; no copy where the file can be mapped."""

    def __init__(self, path: str):
        fs, where = filesystem(path)
        local = fs.type_name == "local"
        self.source = pa.memory_map(where) if local else fs.open_input_file(where)
        self.file = pa.ipc.open_file(self.source)

    def batches(self) -> Iterator[tuple[np.ndarray, int]]:
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            yield batch.column(0).flatten().to_numpy(zero_copy_only=True), int(batch.column(1).flatten().true_count)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(k // BATCH)
        return batch.column(0)[k % BATCH].values.to_numpy(zero_copy_only=True), batch.column(1)[k % BATCH].values.to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self.source.close()


def write_token_shards(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns their manifest, itself a written table."""
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    n = shuffle_partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, out = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), None
        base = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                out = out or ShardWriter(base, enc.width, length, end_id)
                ids, first = enc.encode([t or "" for t in batch.column(1).to_pylist()])
                out.add(batch.column(0), ids, np.diff(first))
        if out:
            out.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{base}.arrow", pa.string()), (f"{base}.docs.arrow", pa.string()), (out.n_ids, pa.int64()), (out.n_docs, pa.int64()))], names=["shard", "path", "index_path", "n_ids", "n_docs"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    with Workspace(spark, "token-manifest") as ws:
        return ws.keep(ordered.mapInArrow(lean(write), MANIFEST), "manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = ShardReader(row["index_path"])
                docs = index.file.read_all().combine_chunks()
                lengths = docs.column("length").to_numpy()
                stops = np.cumsum(lengths)
                crc, shard, done, k = [0] * len(stops), ShardReader(row["path"]), 0, 0
                for ids, real in shard.batches():
                    ids = ids[:real].astype("<u4")
                    view = memoryview(ids).cast("B")
                    while k < len(stops):
                        begin, end = max(stops[k] - lengths[k], done) - done, min(stops[k], done + real) - done
                        crc[k] = zlib.crc32(view[4 * begin : 4 * end], crc[k])
                        if stops[k] > done + real:
                            break
                        k += 1
                    done += real
                if done != row["n_ids"]:
                    raise ValueError(f"{row['path']} holds {done} ids, not {row['n_ids']}")
                yield pa.record_batch([docs.column("doc_id").combine_chunks(), pa.array(row["base"] + stops - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()
                index.close()

    # one row for each shard, so one task can hold them all
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", "index_path", "n_ids", base.alias("base"))
    return shards.repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
