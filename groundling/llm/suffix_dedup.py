"""Exact removal of byte strings that occur more than once, by bounded interval expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._bwt import long_prefixes
from ._hash import BASES, TABLES, _inverse, chunks, gram_hashes, mix, powers, tidy
from ._pack import MESSAGE, PART_BYTES, bits, blocks_of, dec, enc, join, messages, pack_docs, power, received, split, unbits, unpack
from ._spark import text_bytes

ANCHORS, CONTEXTS, WINDOWS = 0, 1, 2  # message rows
#: Occurrences of an anchor beyond which its strings are compared one by one, spread over all blocks.
HOT = 4_000
#: Bytes of texts in a transform, those that are there twice counted twice: some 60 bytes of arrays for each.
TRANSFORM_BYTES = 1 << 19
INDEX_BITS = np.uint64(30)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


class Part:
    """Anchors of a part's documents: every string of ``least`` bytes belongs to the least of its n-grams.

    An occurrence is (hash of the n-gram, first and last start of the strings that belong to it). Equal
    strings choose the same n-gram at the same place in them, wherever they stand.
    """

    def __init__(self, blobs: pa.ChunkedArray, least: int, gram: int):
        self.ids, self.null, self.data, self.off = unpack(blobs)
        self.least = least
        keys, first, last = [], [], []
        low = (np.uint64(1) << INDEX_BITS) - np.uint64(1)
        for lo, hi in chunks(self.off):
            base = int(self.off[lo])
            data = self.data[base : self.off[hi]]
            if len(data) < least:
                continue
            h = gram_hashes(data, gram)
            key = h & ~low
            key |= np.arange(len(h), dtype=np.uint64)
            at = (sliding_min(key, least - gram + 1) & low).astype(np.int64)
            # strings that stay in one document
            end = np.repeat(self.off[lo + 1 : hi + 1] - base, np.diff(self.off[lo : hi + 1]))[: len(at)]
            ok = np.arange(len(at)) + least <= end
            new = ok.copy()
            new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
            stop = ok.copy()
            stop[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
            a, b = np.flatnonzero(new), np.flatnonzero(stop)
            keys.append(h[at[a]])
            first.append(base + a)
            last.append(base + b)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.key, self.first, self.last = cat(keys, np.uint64), cat(first, np.int64), cat(last, np.int64)
        self.unique, self.place, self.count = np.unique(self.key, return_inverse=True, return_counts=True)

    def codes(self, got: dict[int, bytes], shift: int) -> np.ndarray:
        """By occurrence: 0 for an anchor that stands alone, 1 for a repeated one, 2 for a hot one."""
        out = np.zeros(len(self.unique), np.int64)
        for block, a, b in _ranges(self.unique, shift):
            out[a:b] = dec(got[block])
        return out[self.place] if len(out) else out

    def contexts(self, codes: np.ndarray) -> tuple[list[tuple[int, bytes]], dict[tuple[int, bytes], list[int]]]:
        """Distinct texts around repeated anchors in a fixed order, and their occurrences."""
        raw = self.data
        held: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(codes == 1).tolist():
            text = raw[self.first[i] : self.last[i] + self.least].tobytes()
            held.setdefault((int(self.key[i]), text), []).append(i)
        return sorted(held), held

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings of hot anchors: sorted identities (two arrays), whether each occurs twice here, all starts, and each start's identity."""
        hot = np.flatnonzero(codes == 2)
        starts = np.concatenate([np.arange(self.first[i], self.last[i] + 1) for i in hot]) if len(hot) else np.zeros(0, np.int64)
        h = [np.zeros(len(starts), np.uint64) for _ in BASES]
        for lo, hi in chunks(self.off) if len(hot) else ():
            base, stop = int(self.off[lo]), int(self.off[hi])
            mine = np.flatnonzero((starts >= base) & (starts < stop))
            if len(mine):
                data, at = self.data[base:stop], starts[mine] - base
                for i in range(len(BASES)):
                    total = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(TABLES[i][data] * powers(BASES[i], len(data)), out=total[1:])
                    h[i][mine] = mix((total[at + self.least] - total[at]) * powers(_inverse(BASES[i]), len(data))[at])
        second = h[1] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((second, h[0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (second[order][1:] != second[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        pick = order[new]
        return h[0][pick], second[pick], np.bincount(group, minlength=len(pick)) > 1, starts, group


def _ranges(keys: np.ndarray, shift: int):
    blocks, bound = blocks_of(keys, shift)
    return zip(blocks.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True)


def _send_contexts(order: list[tuple[int, bytes]], held: dict, shift: int):
    blocks, bound = blocks_of(np.array([k for k, _ in order], np.uint64), shift)
    for block, a, b in zip(blocks.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        mine = order[a:b]
        yield CONTEXTS, block, join(
            enc(np.array([k for k, _ in mine], np.uint64), deltas=True), enc(np.array([len(t) for _, t in mine])),
            bits(np.array([len(held[x]) > 1 for x in mine])), zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in mine)),
        )


def _expand(sent: list[tuple[int, bytes]], block: int, least: int) -> pa.Table:
    """Answers for the contexts that parts have sent to a block: runs of starts of repeated strings."""
    texts: list[bytes] = []
    number: dict[bytes, int] = {}
    times: list[int] = []
    anchor: list[int] = []
    asked = []
    for pid, blob in sent:
        key, size, twice, raw = split(blob)
        key, size = dec(key), dec(size).astype(np.int64)
        raw, twice = zstandard.ZstdDecompressor().decompress(raw), unbits(twice, len(key))
        end = np.cumsum(size).tolist()
        mine = []
        for k, a, b, t in zip(key.tolist(), [0, *end[:-1]], end, twice.tolist(), strict=True):
            text = raw[a:b]
            i = number.setdefault(text, len(texts))
            if i == len(texts):
                texts.append(text)
                times.append(0)
                anchor.append(k)
            times[i] += 1 + t
            mine.append(i)
        asked.append((pid, mine))
    starts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    members: dict[int, list[int]] = {}
    for i, k in enumerate(anchor):
        members.setdefault(k, []).append(i)
    batch: list[int] = []
    held = 0
    for group in [*members.values(), None]:
        more = group and sum(len(texts[i]) * min(times[i], 2) for i in group)
        if group is None or held + more > TRANSFORM_BYTES:
            for i, found in zip(batch, long_prefixes([texts[i] for i in batch], least, [min(times[i], 2) for i in batch]) if batch else [], strict=True):
                starts[i] = found
            tidy()
            batch, held = [], 0
        if group and (len(group) > 1 or times[group[0]] > 1):
            batch += group
            held += more
    runs = []
    for s in starts:
        cut = np.flatnonzero(np.diff(s) > 1) + 1
        runs.append([(int(x[0]), len(x)) for x in np.split(s, cut) if len(x)])
    out = []
    for pid, mine in asked:
        flat = [r for i in mine for r in runs[i]]
        out.append(messages(pid, [(CONTEXTS, block, join(enc(np.array([len(runs[i]) for i in mine])), enc(np.array([r[0] for r in flat])), enc(np.array([r[1] for r in flat]))))]))
    return pa.concat_tables(out)


def remove_repeated_bytes(
    docs: DataFrame, least: int = 200, gram: int = 50, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, block_entries: int = 1 << 18, hot: int = HOT
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept, spans): bytes covered by a string of ``least`` bytes that starts anywhere else too are removed.

    kept is binary: the remaining bytes of the UTF-8 text, one after the other; spans are the maximal removed
    runs (start, end). Overlaps count, strings do not cross documents and are judged on the input.

    Every string belongs to an anchor, the least ``gram``-byte n-gram in it. Parts of the documents send
    their anchors to blocks and learn which stand elsewhere too. Around those, the texts that hold their
    strings go to the block of the anchor, equal ones once; there a Burrows-Wheeler transform of the
    distinct texts is expanded backward, breadth first, up to ``least``. Anchors with more than ``hot``
    occurrences send each string by its own 96-bit identity instead, so that no block grows with one key.

    Null or empty text, or one shorter than ``least``: nothing removed. Null ids and repeated rows: documents like all others, and their texts
    repeat each other. Very long texts: whole, in one part each. Ids are whole numbers; one that is not counts as null. Empty table: no rows. Other columns are left out, whatever their names.
    """
    total = text_bytes(docs, text_col)
    parts = max(1, -(-total // part_bytes))
    spacing = (least - gram + 2) / 2
    anchor_shift = 64 - power(total / spacing / block_entries)
    context_shift = 64 - power(4 * total / block_entries / 32)
    packed = pack_docs(docs, id_col, text_col, parts)

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = Part(table.column("blob"), least, gram)
        return messages(key[0].as_py(), ((ANCHORS, block, join(enc(part.unique[a:b], deltas=True), enc(part.count[a:b]))) for block, a, b in _ranges(part.unique, anchor_shift)))

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = [(p, *map(dec, split(b))) for p, b in zip(table.column("pid").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        _, place = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([s[2] for s in sent]).astype(float))
        code = ((times > 1).astype(np.int64) + (times > hot))[place]
        cut = np.cumsum([len(s[1]) for s in sent])[:-1]
        return pa.concat_tables([messages(s[0], [(ANCHORS, key[0].as_py(), enc(c))]) for s, c in zip(sent, np.split(code, cut), strict=True)])

    def contexts(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column("blob"), least, gram)
        codes = part.codes(received(right).get(ANCHORS, {}), anchor_shift)
        order, held = part.contexts(codes)
        first, second, twice, _, _ = part.windows(codes)
        found = list(_send_contexts(order, held, context_shift))
        found += [(WINDOWS, block, join(enc(first[a:b], deltas=True), enc(second[a:b]), bits(twice[a:b]))) for block, a, b in _ranges(first, context_shift)]
        return messages(key[0].as_py(), found)

    def expand(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, block = key[0].as_py(), key[1].as_py()
        sent = list(zip(table.column("pid").to_pylist(), table.column("blob").to_pylist(), strict=True))
        if row == CONTEXTS:
            return _expand(sent, block, least)
        got = [(p, *split(b)) for p, b in sent]
        first, second = (np.concatenate([dec(g[i]) for g in got]) for i in (1, 2))
        size = [len(dec(g[1])) for g in got]
        times = np.concatenate([1 + unbits(g[3], n).astype(np.int64) for g, n in zip(got, size, strict=True)])
        order = np.lexsort((second, first))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        again = np.empty(len(order), dtype=bool)
        again[order] = (np.add.reduceat(times[order], np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
        return pa.concat_tables([messages(g[0], [(WINDOWS, block, bits(a))]) for g, a in zip(got, np.split(again, np.cumsum(size)[:-1]), strict=True)])

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column("blob"), least, gram)
        got = received(right)
        codes = part.codes(got.get(ANCHORS, {}), anchor_shift)
        order, held = part.contexts(codes)
        begin, end = [], []
        for block, a, b in _ranges(np.array([k for k, _ in order], np.uint64), context_shift):
            n_runs, at, many = (dec(x).astype(np.int64).tolist() for x in split(got[CONTEXTS][block]))
            r = 0
            for x, n in zip(order[a:b], n_runs, strict=True):
                for j in range(r, r + n):
                    for i in held[x]:
                        begin.append(part.first[i] + at[j])
                        end.append(part.first[i] + at[j] + many[j] - 1 + least)
                r += n
        first, _, _, starts, group = part.windows(codes)
        again = np.zeros(len(first), dtype=bool)
        for block, a, b in _ranges(first, context_shift):
            again[a:b] = unbits(got[WINDOWS][block], b - a)
        hit = starts[again[group]] if len(first) else starts
        n = len(part.data)
        edge = np.bincount(np.concatenate([np.array(begin, np.int64), hit]), minlength=n + 1) - np.bincount(np.concatenate([np.array(end, np.int64), hit + least]), minlength=n + 1)
        gone = np.cumsum(edge)[:n] > 0
        change = np.zeros(n + 1, dtype=bool)
        change[1:n] = gone[1:] != gone[:-1]
        change[part.off] = True
        bound = np.flatnonzero(change)
        begin, end = bound[:-1], bound[1:]
        owner = np.searchsorted(part.off, begin, "right") - 1
        removed = gone[begin] if n else np.zeros(0, bool)
        kept: list[list[bytes]] = [[] for _ in part.ids]
        spans: list[list[tuple[int, int]]] = [[] for _ in part.ids]
        raw = part.data.tobytes()
        for d, a, b, r in zip(owner.tolist(), begin.tolist(), end.tolist(), removed.tolist(), strict=True):
            if r:
                spans[d].append((a - int(part.off[d]), b - int(part.off[d])))
            else:
                kept[d].append(raw[a:b])
        flat = [s for x in spans for s in x]
        pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64())], names=["start", "end"])
        return pa.table({
            id_col: pa.array(part.ids, pa.int64(), mask=part.null), "n_bytes": pa.array(np.diff(part.off), pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()),
            "kept": pa.array([b"".join(x) for x in kept], pa.binary()),
            "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)), pairs),
        })

    by_pid = packed.groupBy("pid")
    codes = by_pid.applyInArrow(anchors, MESSAGE).groupBy("block").applyInArrow(count, MESSAGE)
    asked = by_pid.cogroup(codes.groupBy("pid")).applyInArrow(contexts, MESSAGE)
    answered = asked.groupBy("row", "block").applyInArrow(expand, MESSAGE)
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    return by_pid.cogroup(codes.union(answered).groupBy("pid")).applyInArrow(finish, schema)
