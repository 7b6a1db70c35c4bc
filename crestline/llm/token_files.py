"""Token-id output in Arrow files of fixed-size-list batches, for zero-copy random access to equal-length sequences.

Layout. Documents are ordered by id (then text), dealt out by range, and each task writes its run of documents as
files of bounded size. `X.arrow` is an Arrow IPC file whose batches hold `ids: fixed_size_list<uint16 or uint32>[L]`
and `mask: fixed_size_list<bool>[L]`; the documents' ids follow each other through the sequences and only the last
sequence of a file is padded (mask false, id 0). `X.docs.arrow` holds a row per document: key, start in the file and
number of ids. The file's footer gives each batch's place, so sequence i is batch i // B, row i % B of a memory map.
A manifest table, written once, lists the files of the attempts that counted: a retried task's leftovers are ignored.

Encoding. The tokenizer drops white space and never merges across what its pattern cuts apart, so each part's ids come
from one library call and are kept in a bounded memo; a text's ids are its parts' ids in order.

Edge cases: a null or empty text yields the end id alone; null keys come first; repeated keys are ordered by text;
an empty table gives an empty manifest and result; extra columns are not read. A long text is never split over files.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, file_system, shared_dir, spread, text_or_empty

MEMO_LIMIT = 400_000
FILE_IDS = 16 << 20
BATCH_SEQUENCES = 256
# Letters, digits and white space of Latin-1.
_LETTERS, _DIGITS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
PIECE = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}{_BLANKS}]+")


class WordEncoder(dict):
    """Ids of whole texts as little-endian bytes; as a dict it is the bounded memo from word to its ids.

    The memo keeps the words that came first, among them the frequent ones; others are known for one call (`extra`).
    New words go to the library in one text, between marks that no other word holds.
    """

    MARK = "\x01"

    def __init__(self, tokenizer_json: str, dtype: str, memo: int = MEMO_LIMIT):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype, self.memo = Tokenizer.from_str(tokenizer_json), dtype, memo
        self[""] = b""
        self.mark = self.whole(self.MARK)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if self.MARK not in w]
        width = np.dtype(self.dtype).itemsize
        extra = {w: self.whole(w) for w in words if self.MARK in w}
        for a in range(0, len(new), 16384):
            some = new[a : a + 16384]
            raw = self.whole(f" {self.MARK} ".join(some))
            ends = (np.flatnonzero(np.frombuffer(raw, self.dtype) == np.frombuffer(self.mark, self.dtype)[0]) * width).tolist() if len(self.mark) == width else []
            if len(ends) != len(some) - 1:
                extra.update((w, self.whole(w)) for w in some)
                continue
            start = 0
            for w, end in zip(some, [*ends, len(raw)]):
                extra[w] = raw[start:end]
                start = end + width
        self.extra = extra
        if len(self) < self.memo:
            self.update(extra)

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]

    def words(self, text: str) -> list[str]:
        """Parts whose ids, in order, are the text's ids.

        A Latin-1 text without apostrophes or special tokens is lowered (which touches no other character) and cut as
        the tokenizer's pattern cuts it: runs of letters, single digits, runs of anything else but white space. Any
        other text is cut at blanks and line ends only, and the library handles what is inside a word.
        """
        if "'" not in text and "<|" not in text:
            try:
                text.encode("latin-1")
                return PIECE.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.words(t) for t in texts]
        self.learn(set().union(*words) - self.keys())
        return [b"".join(map(self.__getitem__, w)) for w in words]


_encoders: dict[tuple, WordEncoder] = {}


def encoder_of(shared) -> WordEncoder:
    name, *parts = shared.value
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(*parts)
    return _encoders[name]


class FileWriter:
    """Writes one file of sequences and its document table; sequences leave memory a batch at a time."""

    def __init__(self, stem: str, length: int, dtype: str, key_type: pa.DataType):
        self.length, self.kind, self.width = length, pa.from_numpy_dtype(np.dtype(dtype)), np.dtype(dtype).itemsize
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("key", key_type), ("start", pa.int64()), ("n", pa.int64())])
        fs, path = file_system(stem)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = pa.ipc.new_file(fs.open_output_stream(f"{path}.arrow"), self.schema)
        self.doc_out = pa.ipc.new_file(fs.open_output_stream(f"{path}.docs.arrow"), self.doc_schema)
        self.stem, self.pending, self.pending_bytes, self.total, self.docs = stem, [], 0, 0, []
        self.n_docs = 0

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // self.width
        self.docs.append((key, self.total, n))
        self.total += n
        self.n_docs += 1
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= BATCH_SEQUENCES * self.length * self.width:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        data = b"".join(self.pending)
        per = self.length * self.width
        size = BATCH_SEQUENCES * per
        at = 0
        while len(data) - at >= size or last and at < len(data):
            part = data[at : at + size]
            at += size
            full = len(part) // self.width
            rows = -(-full // self.length)
            mask = np.zeros(rows * self.length, bool)
            mask[:full] = True
            part = part.ljust(rows * per, b"\0")
            ids = pa.Array.from_buffers(self.kind, rows * self.length, [None, pa.py_buffer(part)])
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(ids, self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.pending = [data[at:]]
        self.pending_bytes = len(data) - min(at, len(data))
        if self.docs and (last or len(self.docs) >= 4096):
            self.doc_out.write_batch(pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*self.docs), self.doc_schema)], schema=self.doc_schema))
            self.docs = []

    def close(self) -> None:
        self._flush(last=True)
        self.out.close()
        self.doc_out.close()


def write(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files and return the manifest: stem, part, seq, n_docs, n_ids and base (ids before the file).

    The manifest has a row per file, so the running sum over it in one task stays small: 100 TB of text make a few
    hundred thousand files of `file_ids` ids.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    dtype = "<u2" if max(end_id + 1, Tokenizer.from_str(spec).get_vocab_size(True)) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(((tokenizer_path, len(spec), dtype), spec, dtype))
    end = np.array([end_id], dtype).tobytes()
    ordered = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, writer = encoder_of(shared), TaskContext.get().partitionId(), 0, None
        done = []
        for batch in chunks(batches, "text", 3 << 20):
            for key, ids in zip(batch.column("key").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                if writer is None:
                    writer = FileWriter(f"{folder}/tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}", length, dtype, batch.column("key").type)
                writer.add(key, ids + end)
                if writer.total >= file_ids:
                    writer.close()
                    done.append((writer.stem, part, seq, writer.n_docs, writer.total))
                    writer, seq = None, seq + 1
        if writer is not None:
            writer.close()
            done.append((writer.stem, part, seq, writer.n_docs, writer.total))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["stem", "part", "seq", "n_docs", "n_ids"])

    # A row a file: few enough to be written by few tasks, each of which costs its files and folders.
    files = cut(ordered.mapInArrow(run, "stem string, part long, seq long, n_docs long, n_ids long").hint("rebalance"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Sequences:
    """Random access to one file: `ids(i)` and `mask(i)` are views into the memory map (or the fetched buffer)."""

    def __init__(self, stem: str):
        fs, path = file_system(stem)
        local = fs.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(f"{path}.arrow") if local else fs.open_input_file(f"{path}.arrow"))
        self.docs = pa.ipc.open_file(pa.memory_map(f"{path}.docs.arrow") if local else fs.open_input_file(f"{path}.docs.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size

    def _at(self, i: int, column: int) -> pa.Array:
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        start = i % BATCH_SEQUENCES * self.length
        return batch.column(column).values.slice(start, self.length)

    def ids(self, i: int) -> np.ndarray:
        return self._at(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        return self._at(i, 1).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """Key, start in the file and ids of each document, in order; one batch of sequences is mapped at a time."""
        size = BATCH_SEQUENCES * self.length
        values: dict[int, np.ndarray] = {}
        for k in range(self.docs.num_record_batches):
            table = self.docs.get_batch(k)
            for key, start, n in zip(*(c.to_pylist() for c in table.columns)):
                first, last = start // size, max(start, start + n - 1) // size
                values = {b: values[b] if b in values else self.reader.get_batch(b).column(0).values.to_numpy(zero_copy_only=True) for b in range(first, last + 1)}
                parts = [values[b][max(0, start - b * size) : start + n - b * size] for b in range(first, last + 1)]
                yield key, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def read(manifest: DataFrame, key_type: str, id_col: str = "doc_id") -> DataFrame:
    """Each document read back from the files: id_col, start, n_tokens and ids (its ids, end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist()):
                rows, held = [], 0
                for key, start, ids in Sequences(stem).documents():
                    rows.append((key, base + start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(rows[-1][3])
                    if held >= 4 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        keys, starts, counts, ids = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])

    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(key_type)
    files, n_ids = manifest.agg(F.count("*"), F.sum("n_ids")).first()
    # A task for each FILE_IDS / 8 ids, so that small files do not cost a task each; two for each core at least.
    tasks = min(files, max(-(-8 * (n_ids or 0) // FILE_IDS), 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    files = spread(manifest.select("stem", "base"), tasks)
    return files.mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids binary").withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Write every document's ids in doc_id order, then read the files back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    back = read(manifest, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
