"""Token ids in Arrow files of fixed-size lists, and their readers.

The ids of all documents, in ascending order of doc_id, form one stream. The documents are dealt out by
ranges of doc_id; each range writes one Arrow IPC file whose batches have two fixed-size-list columns,
``ids`` and ``mask`` (false on the padding behind a file's last id), so that sequence i of a file is a
slice of mapped memory, and one small Arrow file that says where each document's ids are. Files are
written under a name of the task attempt's own; the manifest, made from the attempts that ended well,
names those that count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, fresh_path

MANIFEST = "part int, ids_file string, docs_file string, n_ids bigint, n_docs bigint"


def _filesystem(uri: str):
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
    except Exception as e:
        raise ValueError(f"{uri}: pyarrow can't open this file system; name another folder") from e


def _reader(uri: str):
    """An Arrow file reader; over mapped memory where the file is local."""
    import pyarrow as pa

    system, path = _filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path))


class _Writer:
    def __init__(self, folder: str, name: str, length: int, dtype: str, batch_sequences: int = 512):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa, self.length, self.dtype = np, pa, length, dtype
        self.system, base = _filesystem(folder)
        self.ids_file, self.docs_file = f"{folder}/{name}.ids.arrow", f"{folder}/{name}.docs.arrow"
        kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.streams = [self.system.open_output_stream(f"{base}/{name}.{k}.arrow") for k in ("ids", "docs")]
        self.writer, self.docs_writer = (pa.ipc.new_file(s, k) for s, k in zip(self.streams, (self.schema, self.docs_schema)))
        self.room, self.parts, self.held, self.n_ids, self.n_docs = batch_sequences * length, [], 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        part = self.np.frombuffer(ids, "<u4").astype(self.dtype)
        self.rows.append((doc_id, self.n_ids, len(part)))
        self.n_ids += len(part)
        self.n_docs += 1
        while len(part):
            take = min(self.room - self.held, len(part))
            self.parts.append(part[:take])
            self.held += take
            part = part[take:]
            if self.held == self.room:
                self._flush()
        if len(self.rows) >= 65536:
            self._flush_rows()

    def _flush(self) -> None:
        flat = self.np.concatenate(self.parts)
        n = -(-len(flat) // self.length)
        mask = self.np.zeros(n * self.length, bool)
        mask[: len(flat)] = True
        values = self.np.zeros(n * self.length, self.dtype)
        values[: len(flat)] = flat
        lists = [self.pa.FixedSizeListArray.from_arrays(self.pa.array(x), self.length) for x in (values, mask)]
        self.writer.write_batch(self.pa.record_batch(lists, schema=self.schema))
        self.parts, self.held = [], 0

    def _flush_rows(self) -> None:
        self.docs_writer.write_batch(self.pa.record_batch([self.pa.array(x, self.pa.int64()) for x in zip(*self.rows)], schema=self.docs_schema))
        self.rows = []

    def close(self) -> None:
        if self.held:
            self._flush()
        if self.rows:
            self._flush_rows()
        for x in (self.writer, self.docs_writer, *self.streams):
            x.close()


def write_token_files(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest, one row for each range of doc_id in ascending order.

    A null or empty text has only the end id. Null doc_ids come first; rows that share a doc_id come in the
    order of their texts' hash, and all are written. An empty table gives an empty manifest. Other columns
    are ignored. folder: in the shared store; by default below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from quillspark.llm.word_tokens import WordEncoder

        import numpy as np

        encoder, part, writer = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 64):
                for key, ids in zip(keys[at : at + 64], encoder.encode(texts.slice(at, 64).to_pylist())):
                    writer = writer or _Writer(folder, f"{part:06d}-{uuid.uuid4().hex[:12]}", length, "<u2" if encoder.vocab_size <= 1 << 16 else "<u4")
                    writer.add(key, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_file": [writer.ids_file], "docs_file": [writer.docs_file], "n_ids": [writer.n_ids], "n_docs": [writer.n_docs]})

    ordered = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return cut(ordered.mapInArrow(run, MANIFEST))


def read_sequences(ids_file: str):
    """Zero-copy access: f(i) gives the ids and mask of the i-th sequence of a file; len(f) their number."""
    import numpy as np

    reader = _reader(ids_file)
    batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
    ends = np.cumsum([b.num_rows for b in batches])

    class Sequences:
        def __len__(self) -> int:
            return int(ends[-1]) if len(ends) else 0

        def __getitem__(self, i: int):
            k = int(np.searchsorted(ends, i, "right"))
            row = i - (int(ends[k - 1]) if k else 0)
            ids, mask = batches[k].column(0), batches[k].column(1)
            return ids[row].values.to_numpy(zero_copy_only=True), mask[row].values.to_numpy(zero_copy_only=False)

    return Sequences()


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit), read from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for files in batches:
            for ids_file, docs_file, base in zip(*(files.column(k).to_pylist() for k in ("ids_file", "docs_file", "base"))):
                ids_reader, at, low, flat = _reader(ids_file), -1, 0, np.zeros(0, "<u4")
                docs_reader = _reader(docs_file)
                for i in range(docs_reader.num_record_batches):
                    rows = docs_reader.get_batch(i)
                    for k in range(0, rows.num_rows, 1024):
                        some = rows.slice(k, 1024)
                        starts, ns = some.column(1).to_numpy(), some.column(2).to_numpy()
                        out = []
                        for start, n in zip(starts.tolist(), ns.tolist()):
                            parts = []
                            while n:
                                if start >= low + len(flat):
                                    at, low = at + 1, low + len(flat)
                                    flat = ids_reader.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                                take = min(n, low + len(flat) - start)
                                parts.append(flat[start - low : start - low + take])
                                start, n = start + take, n - take
                            out.append(b"".join(p.astype("<u4").tobytes() for p in parts))
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(starts + base), some.column(2), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
