"""Token ids in a bit-plane file format: fixed-size blocks of ids, transposed into planes, each plane compressed.

A shard file holds, in this order: the magic bytes; for each block of `block_ids` ids its planes,
each a zstandard frame; the index (zstandard-compressed JSON: ids in all, block size, kind of plane,
offset and length of every plane's frame, and each document's key and id count); the index's length
as 8 little-endian bytes. Byte planes hold byte k of every id together, bit planes bit k; for ids below
65,536 the upper planes are constant and cost a few bytes. The index lets a reader fetch any range of
ids by reading only the blocks that hold it.

Spark range-partitions the documents by key; each task writes one shard to the shared folder and returns
one manifest row. A task that is run again writes a file of another name, and the manifest names the
files of the runs that counted.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from handspan.llm.packed import frees_memory
from handspan.llm.shared import file_system, new_folder, stored
from handspan.llm.text import blocks
from handspan.llm.token_counts import BLOCK_BYTES, units

MAGIC = b"HSPLANE1"
BLOCK_IDS = 1 << 16
#: Ids of documents that a reader holds together; a longer document is held alone.
BATCH_IDS = 1 << 20


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes or 32 bit planes."""
    flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(flat[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(flat, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids that `to_planes` was given."""
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard; memory is bounded by a block and the document table."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.size = [], 0
        self.at, self.total = len(MAGIC), 0
        self.frames: list[list[list[int]]] = []
        self.keys: list = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, key, ids: bytes) -> None:
        """One document's ids as little-endian unsigned 32-bit integers."""
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.block_ids:
            data = b"".join(self.held)
            step = 4 * self.block_ids
            whole = len(data) // step * step
            for i in range(0, whole, step):
                self._block(data[i : i + step])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        self.total += len(ids)
        frames = []
        for plane in to_planes(ids, self.kind):
            z = self.zip.compress(plane)
            self.out.write(z)
            frames.append([self.at, len(z)])
            self.at += len(z)
        self.frames.append(frames)

    def close(self) -> int:
        """Ends the file; the number of ids in it."""
        if self.size:
            self._block(b"".join(self.held))
        index = {"ids": self.total, "block": self.block_ids, "kind": self.kind, "frames": self.frames, "keys": self.keys, "counts": self.counts}
        z = self.zip.compress(json.dumps(index).encode())
        self.out.write(z + len(z).to_bytes(8, "little"))
        return self.total


class ShardReader:
    """Reads ranges of ids of a shard by its index."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        end = source.size()
        source.seek(end - 8)
        n = int.from_bytes(source.read(8), "little")
        source.seek(end - 8 - n)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))
        self.have: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.have[0] != k:
            x, planes = self.index, []
            n = min(x["block"], x["ids"] - k * x["block"])
            unzip = zstandard.ZstdDecompressor()
            for at, size in x["frames"][k]:
                self.source.seek(at)
                planes.append(unzip.decompress(self.source.read(size)))
            self.have = (k, from_planes(planes, n, x["kind"]))
        return self.have[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids start .. start + n of the shard."""
        size, parts = self.index["block"], []
        while n > 0:
            k, at = divmod(start, size)
            part = self.block(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, kind: str = "byte") -> DataFrame:
    """Encodes every whole text, appends end_id to each and writes shards in ascending order of key.

    Returns the manifest: shard (ascending with the keys), path, n_docs, n_ids, start (ids of all shards
    before it). Equal keys are ordered by their texts' hash and may stand in neighbouring shards; null
    keys come first; null and empty texts give the end id only; a very long text is written whole, block by block;
    repeated rows are written each; an empty table gives no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")

    def write(batches):
        from pyspark import TaskContext

        store, top = file_system(folder)
        shard = TaskContext.get().partitionId()
        writer = name = None
        docs_seen = 0
        u = units(tokenizer)
        tail = int(end_id).to_bytes(4, "little")
        for b in batches:
            if writer is None:
                store.create_dir(top, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}.ids"
                writer = ShardWriter(store.open_output_stream(f"{top}/{name}"), kind)
            keys = b.column(0).to_pylist()
            for row, _, data, offsets in blocks(b, "_text", BLOCK_BYTES):
                start, end = u.borders(data, offsets)
                slot = u.look_up(data, start, end)
                ids = u.ids(slot).astype("<u4").tobytes()
                total = np.concatenate([[0], np.cumsum(u.n[slot], dtype=np.int64)])
                cut = (4 * total[np.searchsorted(start, offsets)]).tolist()
                for i in range(len(offsets) - 1):
                    writer.add(keys[row + i], ids[cut[i] : cut[i + 1]] + tail)
                    docs_seen += 1
        if writer is not None:
            total = writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([docs_seen], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    sorted_docs = (
        docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
        .withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange("_key", "_tie")
        .sortWithinPartitions("_key", "_tie")
        .select("_key", "_text")
    )
    manifest = stored(sorted_docs.mapInArrow(frees_memory(write), "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_shards(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """One row per document, read back from the files: key, start, n_tokens, ids."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, inner = file_system(path)
                with store.open_input_file(inner) as f:
                    r = ShardReader(f)
                    at = 0
                    keys, counts = r.index["keys"], r.index["counts"]
                    ends, i = np.cumsum(counts, dtype=np.int64), 0
                    while i < len(keys):
                        z = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_IDS, "right")))
                        rows = {"key": keys[i:z], "start": [], "n_tokens": counts[i:z], "ids": []}
                        i, own = z, counts[i:z]
                        for n in own:
                            rows["start"].append(start + at)
                            rows["ids"].append(r.ids(at, n).tobytes())
                            at += n
                        yield pa.RecordBatch.from_pydict({"key": pa.array(rows["key"], pa.int64() if key_type == "long" else pa.string()), "start": pa.array(rows["start"], pa.int64()), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids": pa.array(rows["ids"], pa.binary())})

    return manifest.select("path", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(frees_memory(read), f"key {key_type}, start long, n_tokens long, ids binary")


def token_digest(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_token_shards(manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
