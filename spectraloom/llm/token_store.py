"""Token ids as a table of directly addressable codes.

An id is split into chunks, least significant first.  A block's first level holds the lowest
chunk of every id, and one bit per id tells whether more follow; the next level holds the next
chunk of just those ids, and so on.  The place of an id in the next level is the number of set bits
before it, which a rank directory (one count per 512 bits) gives without decoding: any token of any
document is read by a few array accesses (``token_at``).

File format: a Parquet table in ascending ``doc_id`` order, one row per block of whole documents.
``shard`` numbers the sorted partitions, ``block`` the blocks of a shard, ``at`` counts the shard's
ids before the block, ``doc_ids`` and ``sizes`` are its documents and ``levels`` the codes,
all numbers little-endian.  A shard's writer knows only its own counts, so that a lost task is
simply run again; global positions follow from the shards' totals when the files are read.

Edge cases: a null text is empty and has the end id alone; documents without id come first; rows
with the same id follow each other in the order of their text hashes; an empty table gives an
empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ..session import written
from .text import pieces

END = 2
WIDTHS = (8, 8, 16)
BLOCK_IDS = 262_144
#: Bits per entry of a rank directory.
RANK_BITS = 512

LEVEL = pa.struct([("width", pa.int32()), ("values", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
STORE = (
    "shard int, block int, at bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, "
    "levels array<struct<width:int,values:binary,more:binary,ranks:binary>>"
)


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[dict]:
    """The levels of a block; as many as its largest id needs."""
    levels, rest = [], ids.astype(np.uint32)
    for width in widths:
        values = (rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint32(width)
        more = rest != 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append({"width": width, "values": values.tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more]
        if not len(rest):
            return levels
    raise ValueError(f"an id needs more than {sum(widths)} bits")


def decode_levels(levels: list[dict], n: int) -> np.ndarray:
    """All ids of a block."""
    ids, place, shift = np.zeros(n, dtype="<u4"), np.arange(n), 0
    for level in levels:
        values = np.frombuffer(level["values"], dtype=f"<u{level['width'] // 8}")
        ids[place] |= values.astype(np.uint32) << np.uint32(shift)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(place), bitorder="little")
        place, shift = place[more.view(bool)], shift + level["width"]
    return ids


def token_at(levels: list[dict], i: int) -> int:
    """The i-th id of a block: one value, one bit and one rank a level."""
    out = shift = 0
    for level in levels:
        size = level["width"] // 8
        out |= int.from_bytes(level["values"][i * size : (i + 1) * size], "little") << shift
        if not level["more"][i >> 3] >> (i & 7) & 1:
            return out
        entry = i // RANK_BITS
        before = int.from_bytes(level["ranks"][4 * entry : 4 * entry + 4], "little")
        start = entry * RANK_BITS // 8
        bits = int.from_bytes(level["more"][start : i // 8 + 1], "little")
        i = before + (bits & ((1 << (i - entry * RANK_BITS)) - 1)).bit_count()
        shift += level["width"]
    raise ValueError("a code does not end")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(
    docs: DataFrame, vocabulary: str | None = None, end: int = END, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """The blocks of all documents, sorted by id across and within shards."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.library_encoder(path), TaskContext.get().partitionId()
        block, at, size, held, names = 0, 0, 0, [], []

        def cut() -> pa.RecordBatch:
            sizes, ids = [len(x) for x in held], np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([at], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([encode_levels(ids)], pa.list_(LEVEL)),
                ],
                ["shard", "block", "at", "n_ids", "doc_ids", "sizes", "levels"],
            )

        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1).to_pylist())):
                held.append(np.append(ids, np.uint32(end)))
                names.append(doc_id)
                size += len(held[-1])
                if size >= block_ids:
                    yield cut()
                    block, at, size, held, names = block + 1, at + size, 0, [], []
        if held:
            yield cut()

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return ordered.mapInArrow(run, STORE)


def write_store(docs: DataFrame, **settings) -> DataFrame:
    """Encode, write the files, and give the store as read from them.  Values stay uncompressed."""
    return written(encoded(docs, **settings), compression="none")


def documents_of(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the store."""
    totals = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per sorted partition: the bound of this window and of the broadcast below
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    placed = store.join(F.broadcast(bases), "shard").select(
        (F.col("base") + F.col("at")).alias("start"), "n_ids", "doc_ids", "sizes", "levels"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row = batch.to_pylist()[0]
            data = decode_levels(row["levels"], row["n_ids"]).tobytes()
            sizes = np.array(row["sizes"], dtype=np.int64)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - sizes),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
