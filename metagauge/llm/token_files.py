"""Token ids in packed binary files.

A file holds the ids of a range of documents, in blocks of a fixed number of ids, each id in the fewest bits that hold the
vocabulary. Layout, little-endian throughout::

    blocks       each a whole number of 64-bit words; id j of a block fills bits j*width to (j+1)*width - 1
    block_at     one u64 per block and one more: where it begins, and where the last ends
    doc_ids      one i64 per document; the smallest i64 stands for a null id
    n_tokens     one u64 per document
    trailer      8 bytes of magic, then u32 width, u32 ids per block, u64 n_ids, u64 n_docs, u64 n_blocks

Any range of ids is read by seeking to the blocks that hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metagauge.llm.encoding import Encoder, byte_level_pieces, sums, vocabulary_size
from metagauge.llm.tables import FIRST_KEY, order_key, partitions
from metagauge.llm.words import steps, text_bytes

MAGIC = b"IDPACK01"
_TRAILER = struct.Struct("<8sIIQQQ")
#: A multiple of 64, so that a full block is a whole number of words whatever the width.
BLOCK_IDS = 65_536
_KNOWN: dict[str, Encoder] = {}


def width_of(n_ids: int) -> int:
    """The fewest bits that hold every id below ``n_ids``."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids at a time fill ``width`` words; the work runs over all groups of 64 at once."""
    groups = -(-len(ids) // 64)
    rows = np.zeros((groups, 64), dtype=np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, width), dtype="<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    rows = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        rows[:, j] = value & mask
    return rows.reshape(-1)[:n]


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Writer:
    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.rest, self.waiting = [], 0
        self.block_at, self.doc_ids, self.n_tokens = [0], [], []

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            ids = np.concatenate(self.rest)
            full = len(ids) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, full, BLOCK_IDS):
                self._block(ids[at : at + BLOCK_IDS])
            self.rest, self.waiting = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.width)
        self.out.write(packed)
        self.block_at.append(self.block_at[-1] + len(packed))

    def end(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array(self.block_at, "<u8").tobytes())
        keys, n = np.concatenate(self.doc_ids), np.concatenate(self.n_tokens)
        self.n_docs, self.n_ids = len(keys), int(n.sum())
        self.out.write(keys.astype("<i8").tobytes())
        self.out.write(n.astype("<u8").tobytes())
        self.out.write(_TRAILER.pack(MAGIC, self.width, BLOCK_IDS, self.n_ids, self.n_docs, len(self.block_at) - 1))


class TokenFile:
    """Random access to one file."""

    def __init__(self, place, path: str):
        size = place.get_file_info(path).size
        self.file = place.open_input_file(path)
        magic, self.width, self.block_ids, self.n_ids, self.n_docs, n_blocks = _TRAILER.unpack(
            self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        at = size - _TRAILER.size - 8 * (2 * self.n_docs + n_blocks + 1)
        table = lambda n, skip, kind: np.frombuffer(self.file.read_at(8 * n, at + 8 * skip), kind)
        self.block_at = table(n_blocks + 1, 0, "<u8").astype(np.int64)
        self.doc_ids = table(self.n_docs, n_blocks + 1, "<i8")
        self.n_tokens = table(self.n_docs, n_blocks + 1 + self.n_docs, "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        found = []
        for b in range(first, last + 1):
            data = self.file.read_at(int(self.block_at[b + 1] - self.block_at[b]), int(self.block_at[b]))
            found.append(unpack(data, self.width, min(self.block_ids, self.n_ids - b * self.block_ids)))
        skip = first * self.block_ids
        return np.concatenate(found)[start - skip : stop - skip]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` to each, and writes the ids in ascending ``doc_id`` order.

    One file per range of ids, in a folder that all executors reach. A task writes under a name of its own and renames at the
    end, so a task that runs again replaces a file by an equal one. Returns the index, ``shard, path, n_docs, n_ids, start``,
    which is also kept in the folder; ``start`` counts the ids of all files before. Null and empty texts have the end id
    alone; null ids come first; equal ids are ordered by their texts; columns other than ``doc_id`` and ``text`` are not
    read; an empty table gives an index without rows.
    """
    spark = docs.sparkSession
    width = width_of(max(vocabulary_size(vocabulary), end_id + 1))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(vocabulary, Encoder(vocabulary))
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for part in steps(batch, "text"):
                if writer is None:
                    place, root = _place(folder)
                    path = f"{root}/ids-{shard:06d}.bin"
                    own = f"{path}.{uuid.uuid4().hex}"
                    place.create_dir(root, recursive=True)
                    out = place.open_output_stream(own)
                    writer = _Writer(out, width)
                data, borders = text_bytes(part.column("text"))
                starts, ends, first = byte_level_pieces(data, borders, vocabulary)
                at, n = known.find(data, starts, ends)
                per_text = sums(n, first)
                ids = np.insert(known.table.gather(at, n), np.cumsum(per_text), end_id)
                writer.add(ids)
                writer.doc_ids.append(part.column("key").to_numpy())
                writer.n_tokens.append(per_text + 1)
        if writer is not None:
            writer.end()
            out.close()
            place.move(own, path)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}
            )

    ordered = docs.select(order_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "text")
    start, rows = 0, []
    for r in sorted(ordered.mapInArrow(written, "shard long, path string, n_docs long, n_ids long").collect()):
        rows.append((*r, start))
        start += r.n_ids
    index = spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, start long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return index


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, _ = _place(folder)
                file = TokenFile(place, row["path"])
                stop = np.cumsum(file.n_tokens)
                at, step = 0, 16 * file.block_ids
                while at < file.n_docs:
                    begin = int(stop[at] - file.n_tokens[at])
                    end = max(at + 1, int(np.searchsorted(stop, begin + step, "right")))
                    ids = file.ids(begin, int(stop[end - 1])).astype("<u4")
                    cuts = (stop[at:end] - begin)[:-1]
                    keys = file.doc_ids[at:end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, mask=keys == FIRST_KEY),
                            pa.array(row["start"] + stop[at:end] - file.n_tokens[at:end]),
                            pa.array(file.n_tokens[at:end]),
                            pa.array([zlib.crc32(x.tobytes()) for x in np.split(ids, cuts)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = end

    index = spark.read.schema("shard long, path string, n_docs long, n_ids long, start long").parquet(f"{folder}/index")
    spread = index.repartition(max(1, min(partitions(spark), index.count())))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
