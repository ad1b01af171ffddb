"""Token ids in sorted-string-table shards.

One shard file: data blocks, a sparse block index, a Bloom filter, a footer.

* key: 8 bytes, the document id with its sign bit flipped, big-endian, so that byte order is numeric
  order; a null id has the empty key and sorts first;
* data block: up to ``BLOCK`` entries; per entry one byte of prefix shared with the previous key, one of
  suffix length, four of id count, then the suffix and the ids (2 or 4 little-endian bytes each);
* index: per block its last key (length-prefixed), offset and size;
* Bloom filter over the keys: 10 bits a key, 7 probes;
* footer: offsets, counts, id width and a magic number, of fixed size.

A lookup reads the footer, asks the Bloom filter, finds the block by binary search and scans one block.
"""

from __future__ import annotations

import bisect
import gc
import itertools
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_caches, scratch_dir, small_batches, worker_cache

MAGIC = b"QWSST001"
FOOTER = struct.Struct("<QQQQQQQI8s")
BLOCK = 64
SIGN = 1 << 63
#: Entries of either of a worker's two memos of encoded pieces.
MEMO = 300_000
_RUN = re.compile(r"\s\s")
_STEM = re.compile(r"[^\W\d_]+")
FIRST = "\0"
_LINE = "\n" + FIRST
_FIRST_LINE = FIRST + "\n"
_POINTS = ".,;:!?)"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (int(doc_id) + SIGN).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - SIGN if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [((a + i * b) * 0x9E3779B97F4A7C15 >> 11) % bits for i in range(7)]


class Writer:
    """Streams sorted entries to an open binary sink; memory holds one block, the index and the keys."""

    def __init__(self, sink, width: int = 2):
        self.sink, self.width, self.at = sink, width, 0
        self.block: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.last, self.entries, self.tokens = b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes())
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.block = []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", o, n) for k, o, n in self.index))
        bloom_at, bits = self.at, max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom), bits, self.entries, self.tokens, self.width, MAGIC))
        self.sink.close()


class Reader:
    """Reads one shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.bits, self.entries, self.tokens, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self._bloom_at, self._bloom_n, self._bloom = bloom_at, bloom_n, None
        raw, at, self.index = self._read(index_at, index_n), 0, []
        while at < len(raw):
            n = raw[at]
            key = raw[at + 1 : at + 1 + n]
            self.index.append((key, *struct.unpack_from("<QQ", raw, at + 1 + n)))
            at += n + 17

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, at: int, n: int):
        raw, p, key = self._read(at, n), 0, b""
        while p < n:
            shared, more, count = struct.unpack_from("<BBI", raw, p)
            p += 6
            key = key[:shared] + raw[p : p + more]
            p += more
            yield key, np.frombuffer(raw, f"<u{self.width}", count, p)
            p += count * self.width

    def __iter__(self):
        for _, at, n in self.index:
            yield from self._entries(at, n)

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self._read(self._bloom_at, self._bloom_n)
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry under this key, in file order."""
        key, out = key_of(doc_id), []
        if self.may_hold(key):
            for _, at, n in self.index[bisect.bisect_left(self.index, key, key=lambda x: x[0]) :]:
                found = [(k, v) for k, v in self._entries(at, n)]
                out += [v for k, v in found if k == key]
                if found[-1][0] > key:
                    break
        return out


class Encoder:
    """Encodes texts with a tokenizers file, memoizing the pieces between spaces and line ends.

    The byte-level pre-tokenizer joins a space only to what follows it, and letters never to what is none.
    In a text without two white-space characters in a row, cuts before each space, around each line end and
    after a piece's leading letters therefore change no token; other texts, and those that hold an added token's
    string, are encoded whole.

    A piece's key tells what stands before it: ``FIRST`` nothing, a line end and ``FIRST`` a line end, else a
    space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}  # pieces that came again
        self.young: dict[str, bytes] = {}  # pieces that came once of late
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        if len(self.memo) > MEMO:  # what came again first is likely to be common
            self.memo = dict(itertools.islice(self.memo.items(), MEMO // 2))
        if len(self.young) > MEMO // 3:
            self.older, self.young = self.young, {}
        memo, young, seen, older = self.memo, self.young, self.young.get, self.older.get
        found: dict[str, bytes] = {}
        once = [x for x in pieces if x not in young]
        for x in pieces.difference(once):  # twice now
            memo[x] = found[x] = young[x]
        # letters and what follows them are learned apart and put together
        alone, made, parts = [], [], {_FIRST_LINE}
        for x in once:
            if x.isalpha():
                alone.append(x)
                continue
            at = 2 if x[:2] == _LINE else 1 if x[:1] == FIRST else 0
            stem = x.rstrip(_POINTS)
            to = len(stem)
            if at or not stem.isalpha():
                m = _STEM.match(x, at)
                to = m.end() if m and m[0].isalpha() else at
            if to == len(x) or to == at:
                body, tail = x[at - 1 :] if at == 2 else x, None
            else:
                body, tail = x[at - 1 : to] if at else x[:to], FIRST + x[to:]
                parts.add(tail)
            parts.add(body)
            made.append((x, at, body, tail))
        parts.update(alone)
        known, fresh = {}, []
        for key in parts:
            ids = memo.get(key) or seen(key) or older(key)
            if ids is None:
                fresh.append(key)
            else:
                known[key] = memo[key] = ids
        learned = dict(zip(fresh, self._whole([k[1:] if k[:1] == FIRST else " " + k for k in fresh])))
        young.update(learned)
        known.update(learned)
        line = known[_FIRST_LINE]
        for x in alone:
            found[x] = known[x]
        for x, at, body, tail in made:
            ids = known[body] if tail is None else known[body] + known[tail]
            found[x] = young[x] = line + ids if at == 2 else ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short strings without cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out, open_, whole, new = [b""] * len(texts), [], [], set()
        get = self.memo.get
        for i, text in enumerate(texts):
            if FIRST in text or _RUN.search(text) or any(x in text for x in self.added):
                whole.append(i)
            elif text:
                pieces = (FIRST + text.replace("\n", " " + _LINE)).split(" ")
                ids = list(map(get, pieces))
                if None in ids:
                    miss = [j for j, x in enumerate(ids) if x is None]
                    new.update([pieces[j] for j in miss])
                    open_.append((i, pieces, ids, miss))
                else:
                    out[i] = b"".join(ids)
        found = self._learn(new)
        for i, pieces, ids, miss in open_:
            for j in miss:
                ids[j] = found[pieces[j]]
            out[i] = b"".join(ids)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = worker_cache()


def encoder(path: str) -> Encoder:
    """One a worker process: the next task goes on with what the last one learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:", "file://", 1))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def width_for(path: str, end_id: int, width: int | None = None) -> int:
    """Bytes that hold every id of a tokenizers file and the end id."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    width = width or (2 if most < 1 << 16 else 4)
    if most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} do not fit {width} bytes")
    return width


def _text_bytes(docs: DataFrame) -> int:
    """About the bytes of text, from the size of the files that are read where Spark knows it, else counted."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return 2 * size  # files are compressed
    return docs.select(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 16 << 20, width: int | None = None) -> list:
    """Encode ``docs`` (doc_id, text; null text is empty) and write shards in ascending doc_id order.

    Rows are range-partitioned by (doc_id, a hash of the text), so a repeated id can be split; each
    partition streams to files of about ``shard_bytes``. Rows of one id go by that hash, so their order is
    fixed. ``width`` is the bytes of an id: by default 2, or 4 where the vocabulary needs them; too narrow a
    one is refused. A file's name holds its task attempt: only files
    in the returned manifest count, so a retried task leaves no wrong rows. Repeated ids keep all rows.
    Returns rows (part, seq, path, n_docs, n_tokens, min_id, max_id), one a file, in key order.
    """
    small_batches(docs.sparkSession)
    width = width_for(tokenizer_path(tokenizer), end_id, width)
    n = max(1, -(-_text_bytes(docs) // (2 * shard_bytes)), docs.sparkSession.sparkContext.defaultParallelism)

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        context, seq, files = TaskContext.get(), 0, []
        encode, fs, base = encoder(tokenizer_path(tokenizer)).encode, *_filesystem(folder)
        end, writer = np.array([end_id], "<u4").tobytes(), None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids), 4000):
                texts = [x or "" for x in batch.column("text").slice(lo, 4000).to_pylist()]
                for doc, raw in zip(ids[lo : lo + 4000], encode(texts)):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        name = f"part-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.sst"
                        writer, files = Writer(fs.open_output_stream(f"{base}/{name}"), width), [*files, [name, doc]]
                    writer.add(key_of(doc), np.frombuffer(raw + end, "<u4"))
                    if writer.at >= shard_bytes:
                        writer.close()
                        files[-1] += [seq, writer.entries, writer.tokens, doc]
                        writer, seq = None, seq + 1
            last = ids[-1] if ids else None
        if writer is not None:
            writer.close()
            files[-1] += [seq, writer.entries, writer.tokens, last]
        yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "seq": s, "path": f"{base}/{f}", "n_docs": d, "n_tokens": t, "min_id": a, "max_id": b} for f, a, s, d, t, b in files], schema=_MANIFEST)

    ranged = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = ranged.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long, min_id long, max_id long").collect()  # a row a file
    return sorted(rows, key=lambda r: (r["part"], r["seq"]))


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("min_id", pa.int64()), ("max_id", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string())])


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, shard), read block by block from the files of a manifest."""
    starts, files = 0, []
    for r in manifest:
        files.append((r["path"], starts))
        starts += r["n_tokens"]

    def read(batches):
        drop_caches()  # the encoders have done their work
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = {k: [] for k in _ROWS.names}
                with fs.open_input_file(path) as source:
                    for key, ids in Reader(source):
                        raw = ids.astype("<u4").tobytes()
                        for k, v in zip(_ROWS.names, (id_of(key), start, len(ids), zlib.crc32(raw), path.rpartition("/")[2])):
                            rows[k].append(v)
                        start += len(ids)
                        if len(rows["doc_id"]) >= 4000:
                            yield pa.RecordBatch.from_pydict(rows, schema=_ROWS)
                            rows = {k: [] for k in _ROWS.names}
                if rows["doc_id"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=_ROWS)

    df = spark.createDataFrame(files, "path string, start long")
    return df.repartition(max(1, min(len(files), 4096))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shard_bytes: int = 16 << 20, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token-id shards and return one row per document read back from the files.

    Null and empty texts hold the end id alone; repeated rows stay; an empty table gives no rows; other
    columns are ignored. ``tokenizer`` names a file of the installed public tokenizers.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "tokens")
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer, end_id, shard_bytes))
