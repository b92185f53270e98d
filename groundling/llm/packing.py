"""Packing of tokenised documents into fixed-length sequences by linear grouping and best fit.

Only two things leave the executors: a histogram of piece lengths (at most ``capacity`` rows) and,
back to them, runs that place many pieces of one length at once. Both are bounded by the
capacity, whatever the number of documents.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hash import SPACE, TABLES, BASES, _inverse, buffers, chunks, mix, powers, tidy
from ._spark import written

END_ID = 1
#: Pieces of one length that are ranked in one task.
RANK_ROWS = 500_000
#: Word parts that a worker remembers, and how many of them are tokenised at a time: workers live on beside the JVM, so both are small.
CACHE_WORDS, LEARN_WORDS = 1_000_000, 10_000
#: Bytes of texts that are tokenised at a time.
TOKEN_BYTES = 300_000
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters outside ASCII and apostrophes, 2 ASCII letters, 3 other ASCII
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[:128] = 3
_CLASS[SPACE] = 0
_CLASS[39] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CUT = np.zeros(16, dtype=bool)  # by 4 x class before + class after
_CUT[[1, 2, 3, 4, 8, 12, 4 * 2 + 3, 4 * 3 + 2]] = True
_LOWER_TABLE = TABLES[0][_LOWER]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of texts through a cache of word parts.

    The vocabulary's pre-tokeniser drops white space, lower-cases and ends a token wherever an ASCII letter
    meets ASCII punctuation or a digit (an apostrophe aside), so parts between such places are
    tokenised once a process and gathered as arrays. A text with a special token's string goes whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # entry 0 is the end id
        self.count = np.ones(1, np.int64)
        self.ids = np.full(1 << 20, END_ID, np.uint32)
        self.used = 1

    def _learn(self, parts: list[str]) -> np.ndarray:
        """New entries; their numbers."""
        return np.concatenate([self._learn_some(parts[i : i + LEARN_WORDS]) for i in range(0, len(parts), LEARN_WORDS)])

    def _learn_some(self, parts: list[str]) -> np.ndarray:
        got = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        count = np.fromiter((len(e.ids) for e in got), np.int64, len(got))
        total = int(count.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if total:
            self.ids[self.used : self.used + total] = np.concatenate([np.asarray(e.ids, np.uint32) for e in got])
        number = len(self.count) + np.arange(len(got))
        self.first = np.concatenate([self.first, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += total
        return number

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document); every document ends with END_ID."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        n = len(data)
        kind = _CLASS[data]
        cut = np.zeros(n + 1, dtype=bool)
        if n > 1:
            cut[1:n] = _CUT[(kind[:-1] << 2) | kind[1:]]
        cut[off] = True
        bound = np.flatnonzero(cut)
        real = kind[bound[:-1]] > 0 if n else np.zeros(0, bool)
        start, end = bound[:-1][real], bound[1:][real]
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LOWER_TABLE[data] * powers(BASES[0], n), out=total[1:])
        key = mix((total[end] - total[start]) * powers(_inverse(BASES[0]), n + 1)[start] + (end - start).astype(np.uint64))
        unique, pick, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        have = at < len(self.known)
        have[have] = self.known[at[have]] == unique[have]
        number = np.zeros(len(unique), np.int64)
        number[have] = self.place[at[have]]
        raw = data.tobytes().lower()  # ASCII letters only
        if not have.all():
            new = np.flatnonzero(~have)
            number[new] = self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[pick[new]], end[pick[new]], strict=True)])
            self.known = np.insert(self.known, at[new], unique[new])
            self.place = np.insert(self.place, at[new], number[new])
        codes = number[back]
        doc_end = np.searchsorted(start, off[1:], "left")
        codes = np.insert(codes, doc_end, 0)
        doc_end = doc_end + np.arange(1, len(off))
        count = self.count[codes]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[codes] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop[doc_end - 1]]) if len(off) > 1 else np.zeros(1, np.int64)
        if any(s in raw for s in SPECIAL):
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in range(len(off) - 1):
                text = raw[off[i] : off[i + 1]]
                if any(s in text for s in SPECIAL):
                    parts[i] = np.array([*self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, END_ID], np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One cache a worker process: called by name, so it outlives the task."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def token_pieces(text_col: str, capacity: int, vocabulary: str):
    """Column of PIECES: a document's ids and END_ID, cut into pieces of ``capacity``."""

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        tokens = word_tokens(vocabulary)
        data, off = buffers(texts)
        lists, piece, start, length, crc = [0], [], [], [], []
        for lo, hi in chunks(off, TOKEN_BYTES):
            ids, bounds = tokens.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k, s in enumerate(range(a, b, capacity)):
                    e = min(b, s + capacity)
                    piece.append(k)
                    start.append(s - a)
                    length.append(e - s)
                    crc.append(zlib.crc32(view[4 * s : 4 * e]))
                lists.append(len(piece))
        fields = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        tidy()
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(fields, names=["piece", "start", "length", "ids_crc32"]))

    return cut(F.col(text_col))


def configurations(sizes: list[int], demand: list[int], capacity: int, most_rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Patterns over few sizes and how often to use each: the cutting-stock programme solved by
    column generation (revised simplex, knapsack pricing), rounded down. What is left over is at most one
    sequence a pattern and is packed by best fit afterwards."""
    m = len(sizes)
    cols = [tuple(int(i == j) * (capacity // sizes[j]) for i in range(m)) for j in range(m)]
    d = np.array(demand, float)
    x = np.zeros(m)
    for _ in range(most_rounds):
        basis = np.array(cols, float).T
        x = np.linalg.solve(basis, d)
        dual = np.linalg.solve(basis.T, np.ones(m))
        best = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for j in range(m):  # unbounded knapsack over the few sizes
            s, v = sizes[j], dual[j]
            if v <= 1e-9:
                continue
            for times in range(capacity // s):
                better = np.zeros(capacity + 1, dtype=bool)
                better[s:] = best[:-s] + v > best[s:] + 1e-12
                if not better.any():
                    break
                shifted = np.concatenate([np.zeros(s), best[:-s] + v])
                best = np.where(better, shifted, best)
                pick = np.where(better, j, pick)
        if best[capacity] <= 1 + 1e-7:
            break
        col, left = np.zeros(m), capacity
        while pick[left] >= 0 and left > 0:
            col[pick[left]] += 1
            left -= sizes[pick[left]]
        if col @ dual <= 1 + 1e-7 or col @ np.array(sizes) > capacity:
            break
        step = np.linalg.solve(basis, col)
        ratio = [(max(x[i], 0) / step[i], i) for i in range(m) if step[i] > 1e-9]
        if not ratio:
            break
        cols[min(ratio)[1]] = tuple(int(v) for v in col)
    x = np.maximum(np.linalg.solve(np.array(cols, float).T, d), 0)
    return [(c, int(v + 1e-6)) for c, v in zip(cols, x, strict=True) if v + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = 24, large: float = 1 / 8) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, pieces in each sequence, offset there) and the number of sequences.

    Lengths above ``large`` x capacity form ``groups`` groups of equal numbers of pieces, each rounded up to its largest
    length; configurations of these few sizes are optimised, then real pieces take the places,
    each at its own length. The rest goes, longest first, where it leaves the least room.
    Sequences that are filled alike are handled together, so the work follows the number of
    lengths, not of pieces.
    """
    left = {k: v for k, v in histogram.items() if v}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)
    rooms: list[int] = []
    n_seq = 0

    def keep(first: int, many: int, used: int) -> None:
        if many and used < capacity:
            if not open_[capacity - used]:
                heappush(rooms, capacity - used)
            open_[capacity - used].append((first, many))

    def use(length: int, many: int, seq: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], many, seq, each, offset))
        taken[length] += many
        left[length] -= many

    big = sorted((k for k in left if k > large * capacity and k < capacity), reverse=True)
    total = sum(left[k] for k in big)
    if total:
        per = max(1, -(-total // groups))
        members: list[list[list[int]]] = [[]]
        have = 0
        for k in big:
            rest = left[k]
            while rest:
                n = min(rest, per - have)
                members[-1].append([k, n])
                rest, have = rest - n, have + n
                if have == per:
                    members.append([])
                    have = 0
        members = [g for g in members if g]
        merged: dict[int, list[list[int]]] = {}
        for g in members:  # groups whose largest lengths agree are one size
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [s for s, a in zip(sizes, pattern, strict=True) for _ in range(a)]
            times = min([times, *(sum(n for _, n in merged[s]) // a for s, a in zip(sizes, pattern, strict=True) if a)])
            if not times:
                continue
            entries = [(n_seq, times, 0)]
            n_seq += times
            for s in slots:
                split = []
                for first, many, used in entries:
                    while many:
                        item = merged[s][0]
                        n = min(many, item[1])
                        use(item[0], n, first, 1, used)
                        split.append((first, n, used + item[0]))
                        first, many, item[1] = first + n, many - n, item[1] - n
                        if not item[1]:
                            merged[s].pop(0)
                entries = split
            for first, many, used in entries:
                keep(first, many, used)
    for length in sorted(left, reverse=True):
        while left[length]:
            fit, later = None, []
            while rooms:
                room = heappop(rooms)
                if not open_[room]:
                    continue
                if room >= length:
                    fit = room
                    break
                later.append(room)
            # rooms below this length stay for shorter pieces
            for room in later:
                heappush(rooms, room)
            if fit is None:
                each = capacity // length
                many = -(-left[length] // each)
                full = left[length] // each
                if full:
                    use(length, full * each, n_seq, each, 0)
                    keep(n_seq, full, each * length)
                if many > full:
                    n = left[length]
                    use(length, n, n_seq + full, n, 0)
                    keep(n_seq + full, 1, n * length)
                n_seq += many
                continue
            first, many = open_[fit].pop()
            if open_[fit]:
                heappush(rooms, fit)
            each = fit // length
            full = min(many, left[length] // each)
            if full:
                use(length, full * each, first, each, capacity - fit)
                keep(first, full, capacity - fit + each * length)
                keep(first + full, many - full, capacity - fit)
            else:
                n = left[length]
                use(length, n, first, n, capacity - fit)
                keep(first, 1, capacity - fit + n * length)
                keep(first + 1, many - 1, capacity - fit)
    return runs, n_seq


def pack_sequences(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and END_ID; only longer ones are cut, into pieces of
    ``capacity``. Pieces of one length are ranked in parts of about ``rank_rows``, as many as the histogram asks for, so that
    a hot length (whole pieces are one) is no larger a task on more data; the runs of ``plan`` say where the pieces of a
    length with given ranks go. Null text: as empty, so END_ID alone. Very long texts: many pieces. Repeated rows and null ids: documents of their
    own. Empty table: no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    names = [f"_k{i}" for i in range(len(keep))]
    pieces = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], token_pieces(text_col, capacity, vocabulary or vocabulary_path()).alias("_p"))
    pieces = pieces.select(*names, F.monotonically_increasing_id().alias("_row"), F.explode_outer("_p").alias("_p")).select(*names, "_row", "_p.*")  # outer: a filter on the pieces would tokenise twice
    pieces = written(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    salts = spark.createDataFrame([(k, -(-n // rank_rows)) for k, n in histogram.items()], "length long, _salts long")  # at most capacity rows
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.col("_salts")))
    by_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("_before"))
    schema = "length long, _rank0 long, _many long, _seq long, _each long, _offset long"
    table = spark.createDataFrame(runs, schema)
    place = Window.partitionBy("length", "_salt").orderBy("_row", "piece")
    ranked = pieces.withColumn("_n", F.row_number().over(place) - 1).join(parts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_n"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_rank0")) & (F.col("_rank") < F.col("_rank0") + F.col("_many")))
    step = F.col("_rank") - F.col("_rank0")
    return placed.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "piece",
        "start",
        ranked["length"].alias("length"),
        "ids_crc32",
        (F.col("_seq") + F.expr("(_rank - _rank0) div _each")).alias("sequence_id"),
        (F.col("_offset") + (step % F.col("_each")) * ranked["length"]).alias("offset"),
    )
