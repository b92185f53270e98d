"""N-gram Jaccard join by prefix tokens and a prefix tree, and its components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hash import BASES, Words, buffers, chunks, mix, powers, tidy
from ._pack import MESSAGE, bits, blocks_of, dec, enc, messages, power, received, unbits
from ._spark import connected, text_bytes, written
from ._trie import Classes, links

#: Counters of shingle frequency: a fixed number, so what is sent around does not grow.
SKETCH_BITS = 20
SKETCH_BLOCKS = 16
TASK_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
PREFIX_BYTES = 2 << 20
#: Bits of the map of sets that are looked at whole: 4 MB, a power of two.
NEEDED_BITS = 1 << 25
#: Members beyond which a group is not filtered by bitmaps but goes to the tree as it is.
MOST_FILTERED = 4_000
SETS = "struct<n:bigint,s0:bigint,s1:bigint,prefix:array<bigint>,parity:binary>"


def shingles(texts: pa.Array, words: int) -> Iterable[tuple[np.ndarray, np.ndarray, int]]:
    """(document, hash, documents) of every shingle, chunk by chunk."""
    data, off = buffers(texts)
    for lo, hi in chunks(off):
        w = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hashes=2, lower=True)
        at, h = w.windows(words)
        doc, key = w.doc[at], h[0]
        count = np.bincount(w.doc, minlength=hi - lo)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):  # the whole sequence as one shingle
            start = np.cumsum(count) - count
            own = [mix((w.hashes[0][start[d] : start[d] + count[d]] * powers(BASES[1], int(count[d]))).sum(keepdims=True) + np.uint64(count[d]))[0] for d in short]
            doc, key = np.concatenate([doc, short]), np.concatenate([key, np.array(own, np.uint64)])
        yield doc, key, hi - lo


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs once each, by document and key."""
    order = np.argsort(key)
    small = doc[order].astype(np.uint16) if len(doc) and doc.max() < 1 << 16 else doc[order]
    order = order[np.argsort(small, kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def ordered(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order: rare classes first, then by hash."""
    return (rank[key >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(60)) | (key >> np.uint64(4))


def frequency_ranks(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """Class of every counter, 0 for ordinary and up to 15 for the most frequent: 2**SKETCH_BITS bytes whatever the input."""

    def count(batches: Iterable[pa.RecordBatch]):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held, n = [], 0
        for b in batches:
            for _, key, _ in shingles(b.column(0), words):
                held.append((key >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                n += len(key)
                if n > len(total):
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
            tidy()
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        for block, part in enumerate(np.split(total, SKETCH_BLOCKS)):
            yield from messages(0, [(0, block, enc(part))]).to_batches()

    def add(key: tuple[pa.Scalar, ...], batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint64)
        for b in batches:
            for blob in b.column("blob"):
                total += dec(blob.as_py())
        yield from messages(0, [(0, key[0].as_py(), enc(total))]).to_batches()

    from collections.abc import Iterator

    add.__annotations__.update({"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]})
    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, MESSAGE)
    got = {r["block"]: dec(r["blob"]) for r in counted.groupBy("block").applyInArrow(add, MESSAGE).collect()}  # SKETCH_BLOCKS rows
    total = np.concatenate([got[b] for b in range(SKETCH_BLOCKS)]).astype(float) if got else np.zeros(1 << SKETCH_BITS)
    return np.clip(np.log2((total + 1) / (total.mean() + 1)), 0, 15).astype(np.uint8)


def identities(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that together stand for it."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key * np.uint64(salt)), dtype=np.uint64)])
        out.append(total[start + count] - total[start])
    return out


def parities(doc: np.ndarray, key: np.ndarray, count: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """A bitmap a document: each shingle flips one of 2**b bits, at least half as many bits as shingles and 128.

    Two sets differ in at least as many shingles as their bitmaps in bits; a longer bitmap folds to a shorter one.
    """
    width = np.maximum(128, 1 << np.ceil(np.log2(np.maximum(count, 1) / 2)).astype(np.int64).clip(min=0)) * wanted
    end = np.cumsum(width)
    bit = (key & np.uint64((1 << 40) - 1)).astype(np.int64) & (width[doc] - 1)
    use = wanted[doc]
    flips = np.bincount((end - width)[doc][use] + bit[use], minlength=int(end[-1]) if len(end) else 0)
    packed = np.packbits((flips & 1).astype(bool), bitorder="little").tobytes()
    return [packed[(e - w) // 8 : e // 8] for e, w in zip(end.tolist(), width.tolist(), strict=True)]


def weak_classes(members: list[tuple[int, int, bytes]], num: int, den: int) -> list[list[int]]:
    """Classes, of two members at least, of those (rep, size, parity) that sizes and bitmaps allow to be similar, directly or through others."""
    classes: list[list[tuple[int, int, int, int]]] = []
    for rep, n, parity in sorted(members, key=lambda x: (x[1], x[0])):
        own, bits_ = int.from_bytes(parity, "little"), 8 * len(parity)
        hit, rest = [], []
        for c in classes:
            for _, m, other, width in reversed(c):
                if m * den < num * n:
                    break  # the others of the class are no larger
                a, w = own, bits_
                while w > width:
                    w //= 2
                    a = (a >> w) ^ (a & ((1 << w) - 1))
                if (a ^ other).bit_count() * (num + den) <= (den - num) * (n + m):
                    hit.append(c)
                    break
            else:
                rest.append(c)
                continue
            if not hit or hit[-1] is not c:
                rest.append(c)
        merged = sorted((x for c in hit for x in c), key=lambda x: x[1]) if len(hit) != 1 else hit[0]
        merged.append((rep, n, own, bits_))
        classes = [*rest, merged]
    return [[x[0] for x in c] for c in classes if len(c) > 1]


def crossing(members: list[tuple[int, int, int, bytes]], num: int, den: int) -> list[int]:
    """Those of (rep, size, class, parity) that sizes and bitmaps allow to be similar to a member of another class."""
    by_width: dict[int, list[int]] = {}
    for i, x in enumerate(members):
        by_width.setdefault(len(x[3]), []).append(i)
    n, known = (np.array([x[k] for x in members], np.int64) for k in (1, 2))
    hit = np.zeros(len(members), dtype=bool)
    maps = {w: np.frombuffer(b"".join(members[i][3] for i in at), np.uint64).reshape(len(at), w // 8) for w, at in by_width.items()}
    for w, at in by_width.items():
        for v, others in by_width.items():
            if v < w:
                continue
            folded, width = maps[v], v
            while width > w:
                width //= 2
                folded = folded[:, : width // 8] ^ folded[:, width // 8 :]
            others = np.array(others)
            for row, i in zip(maps[w], at, strict=True):
                m = n[others]
                near = (known[others] != known[i]) & (np.minimum(m, n[i]) * den >= np.maximum(m, n[i]) * num)
                near &= np.bitwise_count(folded ^ row).sum(axis=1, dtype=np.int64) * (num + den) <= (den - num) * (m + n[i])
                if near.any():
                    hit[i] = True
                    hit[others[near]] = True
    return [x[0] for x, h in zip(members, hit, strict=True) if h]


def with_parities(members: DataFrame, parities: DataFrame, columns: list[str], cut, schema: str) -> DataFrame:
    """``cut`` (rows of ``columns``, map from rep to its bitmap) over buckets of whole groups; a bucket gets the bitmap of each of its sets once, in however many groups the set is."""
    volume = members.agg(F.sum(F.col("n") + 400)).first()[0] or 0
    buckets = max(1, -(-int(volume) // TASK_BYTES))
    keyed = members.select(F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"), *columns)
    maps = keyed.select("bucket", "rep").distinct().join(parities, "rep").select(F.col("bucket").alias("of"), F.col("rep").alias("set"), F.col("parity").alias("map"))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        of = dict(zip(right.column("set").to_pylist(), right.column("map").to_pylist(), strict=True))
        return cut(zip(*(left.column(c).to_pylist() for c in columns), strict=True), of)

    return keyed.groupBy("bucket").cogroup(maps.groupBy("of")).applyInArrow(run, schema)


def crossing_members(members: DataFrame, parities: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, rep) of ``members`` (gid, rep, n, known) that may be similar to one of another class in their group."""

    def cut(rows, parity: dict[int, bytes]) -> pa.Table:
        groups: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for gid, rep, n, known in rows:
            groups.setdefault(gid, []).append((rep, n, known, parity[rep]))
        out = [(gid, rep) for gid, g in groups.items() for rep in crossing(g, num, den)]
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("gid", "rep"))})

    return with_parities(members, parities, ["gid", "rep", "n", "known"], cut, "gid long, rep long")


def prefix_sets(text_col: str, words: int, num: int, den: int, rank: np.ndarray):
    """Column of SETS: size and identity of a document's set, and the prefix that any similar set has to share a shingle of."""

    @F.arrow_udf(SETS)
    def sets(texts: pa.Array) -> pa.Array:
        n_all, s0, s1, size, prefix, parity = [], [], [], [], [], []
        for doc, key, n in shingles(texts, words):
            doc, key = distinct(doc, ordered(key, rank))
            count = np.bincount(doc, minlength=n)
            start = np.cumsum(count) - count
            n_all.append(count)
            for out, sums in zip((s0, s1), identities(key, start, count), strict=True):
                out.append(sums)
            need = -(-num * count // den)
            take = np.where(count * den >= num * (count + 1), count - need + 1, 0)  # smaller sets have no partner but an equal one
            size.append(take)
            prefix.append(key[np.repeat(start - (np.cumsum(take) - take), take) + np.arange(take.sum())])
            parity += parities(doc, key, count, take > 0)
        tidy()
        cat = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.zeros(0, t)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cat(size, np.int64))]), pa.int32()), pa.array(cat(prefix, np.uint64).view(np.int64)))
        return pa.StructArray.from_arrays(
            [pa.array(cat(n_all, np.int64)), pa.array(cat(s0, np.uint64).view(np.int64)), pa.array(cat(s1, np.uint64).view(np.int64)), lists, pa.array(parity, pa.binary())],
            names=["n", "s0", "s1", "prefix", "parity"],
        )

    return sets(F.coalesce(F.col(text_col), F.lit("")))


def shared_tokens(reps: DataFrame, parts: int, entries: int, block_entries: int) -> DataFrame:
    """(rep, n, token) of ``reps`` (rep, n, prefix) whose token some other rep's prefix has too."""
    shift = 64 - power(entries / block_entries)
    rows = reps.select(F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("pid"), "rep", "n", "prefix")

    def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        col = table.column("prefix").combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
        size = np.diff(col.offsets.to_numpy())
        token = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return token, np.repeat(np.arange(len(size)), size), size

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unique = np.unique(mix(tokens(table)[0]))  # mixed, as the leading bits of a token are its class
        blocks, bound = blocks_of(unique, shift)
        return messages(key[0].as_py(), ((0, b, enc(unique[i:j], deltas=True)) for b, i, j in zip(blocks.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True)))

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = [(p, dec(b)) for p, b in zip(table.column("pid").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        _, place, times = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True, return_counts=True)
        cut = np.cumsum([len(s[1]) for s in sent])[:-1]
        return pa.concat_tables([messages(s[0], [(0, key[0].as_py(), bits(x))]) for s, x in zip(sent, np.split(times[place] > 1, cut), strict=True)])

    def keep(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        token, row, _ = tokens(left)
        unique, place, times = np.unique(mix(token), return_inverse=True, return_counts=True)
        got = received(right).get(0, {})
        shared = times > 1
        blocks, bound = blocks_of(unique, shift)
        for b, i, j in zip(blocks.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            shared[i:j] |= unbits(got[b], j - i)
        hit = shared[place]
        tidy()
        rep, n = (left.column(c).to_numpy() for c in ("rep", "n"))
        return pa.table({"rep": pa.array(rep[row[hit]], pa.int64()), "n": pa.array(n[row[hit]], pa.int64()), "token": pa.array(token[hit].view(np.int64))})

    by_pid = rows.groupBy("pid")
    answers = by_pid.applyInArrow(send, MESSAGE).groupBy("block").applyInArrow(count, MESSAGE)
    return by_pid.cogroup(answers.groupBy("pid")).applyInArrow(keep, "rep long, n long, token long")


def similar_members(members: DataFrame, parities: DataFrame, num: int, den: int, block_bytes: int) -> DataFrame:
    """(gid, rep, n, weight, blocks): groups cut into the classes that bitmaps allow, each set of members once. Groups too large for
    one look go on as they are."""
    large = members.where(F.col("m") > MOST_FILTERED).select("gid", "rep", "n", "weight", "blocks")
    small = members.where(F.col("m") <= MOST_FILTERED)

    def cut(rows, parity: dict[int, bytes]) -> pa.Table:
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for gid, rep, n in rows:
            groups.setdefault(gid, []).append((rep, n, parity[rep]))
        out = []
        for group in groups.values():
            n_of = {rep: n for rep, n, _ in group}
            for c in weak_classes(group, num, den):
                who = np.array(c, np.int64).view(np.uint64)
                cid = int((mix(who * np.uint64(BASES[0]) + np.uint64(1)).sum() + mix(np.array([len(c)], np.uint64)))[0].astype(np.int64))
                out += [(cid, rep, n_of[rep]) for rep in c]
        out = list(dict.fromkeys(out))
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("gid", "rep", "n"))})

    classes = with_parities(small, parities, ["gid", "rep", "n"], cut, "gid long, rep long, n long")
    classes = classes.distinct()
    sizes = classes.groupBy("gid").agg(F.sum("n").alias("weight"))
    blocks = F.ceil(F.col("weight") * 8 / F.lit(block_bytes)).cast("int").alias("blocks")
    return classes.join(sizes.select("gid", "weight", blocks), "gid").select("gid", "rep", "n", "weight", "blocks").union(large)


def linked(members: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(a, b) links between the sets of each (gid, block) of ``members`` (gid, block, rep, known, keys), many of them in a task."""

    def join(table: pa.Table) -> pa.Table:
        classes = Classes()
        groups: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
        sets: dict[int, np.ndarray] = {}
        names = ("gid", "block", "other", "rep", "known", "keys")
        for gid, block, other, rep, known, keys in zip(*(table.column(c).to_pylist() for c in names), strict=True):
            if rep not in sets:
                sets[rep] = np.frombuffer(keys, np.uint64)
            if known is not None:
                classes.join(known, rep)
            groups.setdefault((gid, block, other), []).append((rep, sets[rep]))
        found = [x for g in groups.values() for x in links(g, num, den, classes)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    bucket = F.pmod(F.xxhash64("gid", "block", "other"), F.lit(buckets)).alias("bucket")
    return members.groupBy(bucket).applyInArrow(join, "a long, b long")


def banded(members: DataFrame, num: int, den: int, block_bytes: int) -> DataFrame:
    """``members`` (gid, rep, n, known, block, blocks, ...) with groups of several blocks cut by size: a set meets only those of its own band of sizes and
    the next, as sets whose sizes differ by more than num / den are not similar. What is still too large for one look is dealt into blocks anew."""
    columns = ["gid", "rep", "n", "known", "block", "blocks"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("long") if num < den else F.col("n")
    large = members.where("blocks > 1").select("gid", "rep", "n", "known", F.explode(F.array(band, band - 1) if num < den else F.array(band)).alias("band"))
    large = large.select(F.xxhash64("gid", "band").alias("gid"), "rep", "n", "known")
    size = large.groupBy("gid").agg(F.ceil(F.sum("n") * 8 / F.lit(block_bytes)).cast("int").alias("blocks"))
    large = large.join(size, "gid").withColumn("block", F.pmod(F.xxhash64("rep", "gid"), F.col("blocks")).cast("int"))
    return members.where("blocks = 1").select(columns).union(large.select(columns))


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap, of NEEDED_BITS bits whatever the input, of the hashes (``hash_place``) of all values of ``column``: a row whose bit is not set is none of them, and few others have theirs set."""
    word = keys.select(hash_place(column).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = word.toArrow()  # NEEDED_BITS / 64 rows at most
    bitmap = np.zeros(NEEDED_BITS // 64, np.uint64)
    bitmap[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return bitmap


def hash_place(column: str):
    return F.xxhash64(column).bitwiseAND(NEEDED_BITS - 1)


def near_duplicates(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_entries: int = 1 << 18
) -> DataFrame:
    """(id_col, n_shingles, component_id, text_hash): documents whose sets of distinct ``words``-word shingles (A-Z lower-cased) have
    den * intersection >= num * union are linked; component_id is the least id reachable by links.

    Equal sets count once, under their least id. A shingle's rank in the global order is the frequency class of its
    counter in a sketch of fixed size, then its hash; similar sets share a shingle of their prefixes in that order. Prefix
    shingles that nobody else has are dropped in packed exchanges, and groups with the same members count once.
    Sets are joined in a prefix tree, which adds only links between classes not joined yet: first each set in its largest
    group, then, of the groups whose members are not all in one class by then, every set that its bitmap allows a link to another class. A group with more than
    ``block_bytes`` of sets is cut by the sets' sizes, and what is still larger is dealt into blocks, of which every two are joined.

    Null text or no words: an empty set, linked with nothing. Fewer words than ``words``: the whole
    sequence as one shingle. Very long texts: as all others. text_hash is xxhash64 of the text, to tell rows of one id apart. Null id: a row with its set's component, never a component's name unless alone (then null).
    Repeated rows: rows of their own. Ids are whole numbers; one that is not counts as null. Empty table: no rows. Other columns are left out, whatever their names.
    """
    total = text_bytes(docs, text_col)
    rank = frequency_ranks(docs, words, text_col)
    one = docs.select(F.col(id_col).try_cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), prefix_sets(text_col, words, num, den, rank).alias("s")).select("id", "text_hash", "s.*")
    one = written(one)
    reps = one.where("n > 0").groupBy("s0", "s1", "n").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")).where("rep IS NOT NULL")
    some = reps.where("size(prefix) > 0").select("rep", "n", "prefix")
    known = written(reps.select("rep", "n", "s0", "s1", "parity"))
    parity = known.where("octet_length(parity) > 0").select("rep", "parity")
    parts = 1 + total * (den - num) // den * 8 // 6 // PREFIX_BYTES  # prefixes hold (den - num) / den of about a shingle for six bytes of text
    tokens = written(shared_tokens(some, int(parts), max(1, total * (den - num) // den // 6), block_entries))

    groups = tokens.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("m > 1")
    groups = groups.groupBy("m", "weight", "who").agg(F.min("token").alias("gid"))
    blocks = F.ceil(F.col("weight") * 8 / block_bytes).cast("int")
    members = tokens.join(groups.select("gid", "m", "weight", blocks.alias("blocks")), F.col("token") == F.col("gid")).select("gid", "rep", "n", "m", "weight", "blocks")
    members = written(similar_members(members, parity, num, den, block_bytes))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", "gid"), F.col("blocks")).cast("int"))

    needed = members.select("rep").distinct()
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed, "rep"))

    @F.arrow_udf("struct<s0:bigint,s1:bigint,keys:binary>")
    def keys(at: pa.Array, texts: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False).astype(np.uint64)
        hit = np.flatnonzero(held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
        s0, s1, out = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), [None] * len(at)  # null keys: a set that is not needed
        done = 0
        for doc, key, n in shingles(texts.take(pa.array(hit)), words):
            doc, key = distinct(doc, ordered(key, rank))
            count = np.bincount(doc, minlength=n)
            end = np.cumsum(count)
            row = hit[done : done + n]
            s0[row], s1[row] = identities(key, end - count, count)
            for i, a, b in zip(row.tolist(), [0, *end[:-1].tolist()], end.tolist(), strict=True):
                out[i] = key[a:b].tobytes()
            done += n
        tidy()
        return pa.StructArray.from_arrays([pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(out, pa.binary())], names=["s0", "s1", "keys"])

    # one step of Python, not a filter and a map: a task would hold a worker for each, and both live on beside the JVM
    # texts go through an array: Spark does not find a Python step again whose argument holds nested lambda functions, as that of texts that are still to be computed would
    text = F.inline(F.array(F.struct(F.coalesce(text_col, F.lit("")).alias("text"))))
    sets = docs.select(F.col(id_col).try_cast("long").alias("rep"), text).where("rep IS NOT NULL")
    sets = sets.select("rep", keys.asNondeterministic()(hash_place("rep"), "text").alias("s")).select("rep", "s.*").where("keys IS NOT NULL")
    # ids can repeat with other texts: the one that the id stands for has its set's identity
    wanted = known.select("rep", "s0", "s1").join(needed, "rep", "left_semi")
    sets = written(sets.join(wanted, ["rep", "s0", "s1"], "left_semi").dropDuplicates(["rep"]).select("rep", "keys"))
    # first every set in one group only, its largest: that joins most classes, and groups all in one class are done
    pick = members.groupBy("rep").agg(F.max(F.struct("weight", "gid")).alias("p")).select("rep", "p.gid")
    volume = sets.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    plain = members.join(pick, ["rep", "gid"]).select("gid", "block", F.lit(0).alias("other"), "rep", F.lit(None).cast("long").alias("known")).join(sets, "rep")
    edges = written(linked(plain, max(1, -(-int(volume) // TASK_BYTES)), num, den))
    classes = connected(edges)

    # then the groups with more than one class left: sets whose bitmaps allow a link to another class, and every two blocks of a large group
    rest = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("known", F.coalesce("component", "rep")).drop("component")
    open_ = rest.groupBy("gid").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.count("*").alias("m")).where("x <> y").select("gid", "m")
    rest = written(rest.join(open_, "gid"))
    small = rest.where(F.col("m") <= MOST_FILTERED)
    may = crossing_members(small.select("gid", "rep", "n", "known"), parity, num, den)
    rest = written(small.join(may, ["gid", "rep"], "left_semi").union(rest.where(F.col("m") > MOST_FILTERED).select(small.columns)))
    rest = written(banded(rest, num, den, block_bytes))
    volume = rest.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    if volume:
        pairs = rest.select("gid", "rep", "known", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).where("with <> block OR blocks = 1")
        pairs = pairs.select("gid", F.least("block", "with").alias("block"), F.greatest("block", "with").alias("other"), "rep", "known").join(sets, "rep")
        edges = written(edges.union(linked(pairs, max(1, -(-int(volume) * 8 // TASK_BYTES)), num, den)))
        classes = connected(edges)

    named = known.select("s0", "s1", "n", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("s0", "s1", "n", F.coalesce("component", "rep").alias("component_id"))
    full = one.where("n > 0").select("id", "n", "s0", "s1", "text_hash").join(named, ["s0", "s1", "n"], "left").select("id", "n", "component_id", "text_hash")
    empty = one.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "text_hash")
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "text_hash")
