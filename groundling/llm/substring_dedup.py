"""Removal of word windows seen in an earlier document: count-min prefilter, then exact groups."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._hash import Words, chunks, covered
from ._pack import MESSAGE, PART_BYTES, bits, blocks_of, dec, enc, join, messages, pack_docs, power, received, split, unbits, unpack
from ._spark import text_bytes

ROWS = 2  # of the sketch; each with its own hash
CELLS_PER_WINDOW = 4
BLOCK_BITS = 22
ENTRIES_PER_BLOCK = 1 << 17
EXACT = ROWS  # message row of the second pass


class Part:
    """Windows of a part's documents in a fixed order: by hash, equal ones together."""

    def __init__(self, blobs: pa.ChunkedArray, window: int):
        self.ids, self.null, self.data, self.off = unpack(blobs)
        h, doc, at = [[], []], [], []
        self.words_before = np.zeros(len(self.off), np.int64)
        base = 0
        for lo, hi in chunks(self.off):
            w = Words(self.data[self.off[lo] : self.off[hi]], self.off[lo : hi + 1] - self.off[lo])
            self.words_before[lo + 1 : hi + 1] = base + np.cumsum(np.bincount(w.doc, minlength=hi - lo))
            place, hashes = w.windows(window)
            real = ~self.null[lo + w.doc[place]]  # rows without an id neither give nor lose windows
            for i in range(ROWS):
                h[i].append(hashes[i][real])
            doc.append(lo + w.doc[place][real])
            at.append(base + place[real])
            base += len(w.start)
        self.h = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in h]
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(self.h[0], kind="stable")
        first, second = self.h[0][order], (self.h[1] & np.uint64(0xFFFFFFFF))[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        if len(order) and not (first[1:][new[1:]] > first[:-1][new[1:]]).all():  # two windows under one first hash
            order = np.lexsort((self.h[1] & np.uint64(0xFFFFFFFF), self.h[0]))
            first, second = self.h[0][order], (self.h[1] & np.uint64(0xFFFFFFFF))[order]
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        start = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.key, self.low = first[start], second[start]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], start) if len(start) else np.zeros(0, np.int64)
        self.pick = order[start]  # a window of each group

    def cells(self, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct cells of a sketch row, and each group's place among them."""
        shift = np.uint64(64 - width)
        return np.unique(self.h[row][self.pick] >> shift, return_inverse=True)

    def elsewhere(self, got: dict[int, dict[int, bytes]], width: int, block_bits: int) -> np.ndarray:
        """Groups whose every cell some other part has touched."""
        out = np.ones(len(self.key), dtype=bool)
        for row in range(ROWS):
            cells, place = self.cells(row, width)
            flags = np.zeros(len(cells), dtype=bool)
            for block, a, b in _ranges(cells, block_bits):
                flags[a:b] = unbits(got[row][block], b - a)
            out &= flags[place] if len(place) else out
        return out


def _ranges(keys: np.ndarray, shift: int):
    blocks, bound = blocks_of(keys, shift)
    return zip(blocks.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True)


def remove_seen_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, block_bits: int = BLOCK_BITS, block_entries: int = ENTRIES_PER_BLOCK) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text): words covered by a ``window``-word window whose words also start
    in a document with a smaller id are removed, judged on the input; kept words are joined by one space.

    First pass: every part of the documents makes a count-min sketch of its windows, sparse, as many
    cells wide as the input has windows (times CELLS_PER_WINDOW). The sketches are merged block by block, and every part learns which of its own
    cells other parts have touched. Second pass: windows whose every cell was touched go, by hash range, to
    exact groups of 96-bit window identities that return the least id; all others are settled inside their part.
    A sketch only overestimates, so no repeated window is missed.

    Null or empty text: no words, empty kept_text. Null id: kept whole, and no source for others. Equal ids:
    neither is smaller, so nothing goes between them. Repeated rows: rows of their own. Very long texts: whole, in one part each. Ids are whole numbers; one that is not counts as null. Empty table: no rows. Other columns are left out, whatever their names.
    """
    total = text_bytes(docs, text_col)
    parts = max(1, -(-total // part_bytes))
    width = max(block_bits, power(CELLS_PER_WINDOW * total / 6))
    exact_shift = 64 - power(total / 6 / block_entries / 2)
    packed = pack_docs(docs, id_col, text_col, parts)

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = Part(table.column("blob"), window)

        def found():
            for row in range(ROWS):
                cells, _ = part.cells(row, width)
                for block, a, b in _ranges(cells, block_bits):
                    yield row, block, enc(cells[a:b] - np.uint64(block << block_bits), deltas=True)

        return messages(key[0].as_py(), found())

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        touched = np.zeros(1 << block_bits, np.uint32)
        sent = [(p, dec(b)) for p, b in zip(table.column("pid").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        for _, cells in sent:
            touched[cells] += 1
        row, block = key[0].as_py(), key[1].as_py()
        return pa.concat_tables([messages(p, [(row, block, bits(touched[cells] > 1))]) for p, cells in sent])

    def candidates(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column("blob"), window)
        chosen = part.elsewhere(received(right), width, block_bits)
        first, low, least = part.key[chosen], part.low[chosen], part.least[chosen]

        def found():
            for block, a, b in _ranges(first, exact_shift):
                signed = least[a:b].astype(np.uint64) ^ np.uint64(1 << 63)
                yield EXACT, block, join(enc(first[a:b], deltas=True), enc(low[a:b]), enc(signed - signed.min()), enc(signed.min()[None]))

        return messages(key[0].as_py(), found())

    def exact(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = []
        for p, blob in zip(table.column("pid").to_pylist(), table.column("blob").to_pylist(), strict=True):
            first, low, above, floor = map(dec, split(blob))
            sent.append((p, first, low, above + floor[0]))
        first, low, least = (np.concatenate([s[i] for s in sent]) for i in (1, 2, 3))
        order = np.lexsort((low, first))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (low[order][1:] != low[order][:-1])
        answer = np.empty(len(order), np.uint64)
        answer[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out, at = [], 0
        for p, f, _, own in sent:
            mine = answer[at : at + len(f)]
            at += len(f)
            less = mine < own
            low_id = mine[less].min() if less.any() else np.uint64(0)
            out.append(messages(p, [(EXACT, key[0].as_py(), join(bits(less), enc(mine[less] - low_id), enc(low_id[None])))]))
        return pa.concat_tables(out)

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column("blob"), window)
        got = received(right)
        chosen = np.flatnonzero(part.elsewhere(got, width, block_bits))
        least = part.least.copy()
        for block, a, b in _ranges(part.key[chosen], exact_shift):
            less, above, floor = split(got[EXACT][block])
            less = unbits(less, b - a)
            least[chosen[a:b][less]] = ((dec(above) + dec(floor)[0]) ^ np.uint64(1 << 63)).astype(np.int64)
        seen = least[part.group] < part.ids[part.doc]
        gone = covered(int(part.words_before[-1]), part.at[seen], window)
        raw, n_words, n_removed, kept = part.data.tobytes(), [], [], []
        for i in range(len(part.ids)):
            words = raw[part.off[i] : part.off[i + 1]].split()
            mask = gone[part.words_before[i] : part.words_before[i + 1]]
            n_words.append(len(words))
            n_removed.append(int(mask.sum()))
            kept.append(b" ".join(compress(words, ~mask)) if n_removed[-1] else b" ".join(words))
        return pa.table({
            id_col: pa.array(part.ids, pa.int64(), mask=part.null), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    by_pid = packed.groupBy("pid")
    touched = by_pid.applyInArrow(sketch, MESSAGE).groupBy("row", "block").applyInArrow(merge, MESSAGE)
    asked = by_pid.cogroup(touched.groupBy("pid")).applyInArrow(candidates, MESSAGE)
    answered = asked.groupBy("block").applyInArrow(exact, MESSAGE)
    return by_pid.cogroup(touched.union(answered).groupBy("pid")).applyInArrow(finish, f"`{id_col}` long, n_words long, n_removed long, kept_text string")
