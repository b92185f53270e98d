"""Documents in packed parts, and number arrays as compressed bytes, for exchanges between parts.

An operator that asks "where else does this occur" puts documents into parts by a hash, lets every
part send sorted arrays of keys to blocks of the key space, and sends the answers back. A part
names a key once however often it has it, so no key gathers rows: neither a common line nor a
group of copies makes a block larger than the others.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 8 << 20
_DTYPES = (np.uint8, np.uint16, np.uint32, np.uint64)
MESSAGE = "pid long, row int, block long, blob binary"


def enc(values: np.ndarray, deltas: bool = False) -> bytes:
    """Unsigned numbers as compressed byte planes; ``deltas`` for sorted ones."""
    values = np.asarray(values).astype(np.uint64)
    if deltas and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    top = int(values.max()) if len(values) else 0
    kind = next(i for i, d in enumerate(_DTYPES) if top <= np.iinfo(d).max)
    width = 1 << kind
    planes = np.ascontiguousarray(values.astype(_DTYPES[kind]).view(np.uint8).reshape(-1, width).T)
    return bytes([kind, deltas]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def dec(blob: bytes) -> np.ndarray:
    width = 1 << blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(_DTYPES[blob[0]]).astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if blob[1] else values


def join(*blobs: bytes) -> bytes:
    """Several arrays in one blob."""
    return np.array([len(blobs), *map(len, blobs)], np.uint32).tobytes() + b"".join(blobs)


def split(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    size = np.frombuffer(blob, np.uint32, n, 4)
    at, out = 4 + 4 * n, []
    for s in size.tolist():
        out.append(blob[at : at + s])
        at += s
    return out


def pack_docs(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(pid, blob): the documents of each part, compressed on the way to the shuffle.

    The part is a hash of id and text, so equal rows share one and any order of arrival is fine.
    """
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).alias("pid"),
        F.col(id_col).try_cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def pack(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            pid = b.column("pid").to_numpy(zero_copy_only=False)
            order = np.argsort(pid, kind="stable")
            ids, text = b.column("id"), b.column("text")
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(pid[order])) + 1
            out = []
            for rows in np.split(order, cut) if len(order) else []:
                mine = [text[int(r)].as_py() for r in rows]
                head = np.array([len(rows)], np.int64).tobytes() + ids[rows].astype(np.int64).tobytes() + null[rows].astype(np.uint8).tobytes()
                sizes = np.array([len(t) for t in mine], np.int64).tobytes()
                out.append((int(pid[rows[0]]), zstandard.ZstdCompressor(level=3).compress(head + sizes + b"".join(mine))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["pid", "blob"])

    return rows.mapInArrow(pack, "pid long, blob binary")


def unpack(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, null ids, bytes, offsets) of a part."""
    ids, null, size, data = [], [], [], []
    for b in blobs:
        raw = zstandard.ZstdDecompressor().decompress(b.as_py())
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids.append(np.frombuffer(raw, np.int64, n, 8))
        null.append(np.frombuffer(raw, np.uint8, n, 8 + 8 * n))
        size.append(np.frombuffer(raw, np.int64, n, 8 + 9 * n))
        data.append(np.frombuffer(raw, np.uint8, offset=8 + 17 * n))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate(null).astype(bool), np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(size))])


def messages(pid: int, found: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    """Rows of MESSAGE from (row, block, blob)."""
    found = list(found)
    return pa.table({
        "pid": pa.array([pid] * len(found), pa.int64()),
        "row": pa.array([f[0] for f in found], pa.int32()),
        "block": pa.array([f[1] for f in found], pa.int64()),
        "blob": pa.array([f[2] for f in found], pa.binary()),
    })


def received(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """Answers as row -> block -> blob."""
    out: dict[int, dict[int, bytes]] = {}
    for row, block, blob in zip(*(table.column(c).to_pylist() for c in ("row", "block", "blob")), strict=True):
        out.setdefault(row, {})[block] = blob
    return out


def blocks_of(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(block numbers present, bounds of their ranges) of sorted keys."""
    block = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return block[start], np.append(start, len(keys))


def bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


def power(n: float) -> int:
    """Least b with 2**b >= n."""
    return max(0, int(np.ceil(np.log2(max(n, 1)))))
