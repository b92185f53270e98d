"""Benchmark decontamination: BM25 retrieval of test items by every passage, then overlap of question and answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hash import Words, buffers, chunks, tidy
from ._spark import making_room, written

SHINGLE = 5
K1, B = 1.2, 0.75
ITEMS_PER_BLOCK = 8
INDEX_BYTES = 64 << 20
HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
#: Everything in ASCII that is no letter or digit separates words, so punctuation makes no difference.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True
_SENTENCE = re.compile(r"(?<=[.?!])\s+(?=\S)")


def answer_at(text: str) -> int:
    """Where an item's answer begins: its last line, or its last sentence if it has one line (0: no question before it)."""
    body = text.rstrip()
    cut = body.rfind("\n") + 1
    if not cut:
        ends = [m.end() for m in _SENTENCE.finditer(body)]
        cut = ends[-1] if ends else len(body)
    return cut


@dataclass
class Corpus:
    """Statistics of all items together, so that scores do not depend on how many indexes hold them."""

    n: int
    mean: float  # words of an item
    most: int
    terms: np.ndarray  # hashes, sorted; of the items of one index at least
    df: np.ndarray


def item_words(texts: list[str]) -> tuple[Words, np.ndarray]:
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), np.uint8), off, hashes=1, lower=True, between=_BETWEEN), off


def corpus_of(texts: list[str]) -> Corpus:
    """Statistics of items that are all at hand."""
    w, _ = item_words(texts)
    words = np.bincount(w.doc, minlength=len(texts))
    terms, term = np.unique(w.hashes[0], return_inverse=True)
    df = np.bincount(np.unique(term * max(len(texts), 1) + w.doc) // max(len(texts), 1), minlength=len(terms))
    return Corpus(len(texts), float(words.mean()) if len(texts) else 1.0, int(words.max(initial=0)), terms, df)


class Index:
    """Postings of test items in blocks of items, with weights as shares of the item's own score.

    term -> (item, weight) and term -> (block, largest weight in it), both in compressed rows.
    """

    def __init__(self, items: list[tuple[int | None, str]], corpus: Corpus | None = None):
        corpus = corpus or corpus_of([t for _, t in items])
        self.ids = [i for i, _ in items]
        w, off = item_words([t for _, t in items])
        n = len(items)
        self.words = np.bincount(w.doc, minlength=n)
        self.stride = max(32, corpus.most)
        self.terms, term = np.unique(w.hashes[0], return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + w.doc, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)] if len(self.terms) else np.zeros(0)
        idf = np.log1p((corpus.n - df + 0.5) / (df + 0.5))
        length = self.words / max(corpus.mean, 1e-9)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item]))
        whole = np.bincount(item, weights=weight, minlength=n)
        self.item, self.weight = item, weight / whole[item]
        self.row = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.best = np.maximum.reduceat(self.weight, self.row[:-1]) if len(term) else np.zeros(0)
        self.n_blocks = -(-n // ITEMS_PER_BLOCK)
        block = item // ITEMS_PER_BLOCK
        start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block = block[start]
        self.block_best = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.block_row = np.searchsorted(term[start], np.arange(len(self.terms) + 1))
        self.question, self.answer = [], []
        for i, (_, t) in enumerate(items):
            first, last = np.searchsorted(w.doc, [i, i + 1])
            k = min(SHINGLE, last - first)
            h = w.hashes[0][first:last]
            sh = _shingles(h, k) if k else np.zeros(0, np.uint64)
            lead = int(np.searchsorted(w.start[first:last] - off[i], len(t[: answer_at(t)].encode())))
            inside = np.arange(len(sh)) + k <= lead
            self.question.append(np.unique(sh[inside]))
            self.answer.append(np.unique(sh[~inside]))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return out


def _expand(row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entry of ``of``, place in the rows' values) for all values of those rows."""
    size = row[of + 1] - row[of]
    who = np.repeat(np.arange(len(of)), size)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(row[of], size)


def search(index: Index, data: np.ndarray, off: np.ndarray, threshold: float, most_cells: int = 1_000_000):
    """(document, item, score, question share, answer share) of the verified pairs of consecutive documents.

    Passages of 2 * stride words start every stride words, so an item lies whole in one. First bound: the sum of the
    passage's terms' largest weights. Second: the same by block of items. Items of blocks that reach the threshold are scored.
    """
    w = Words(data, off, hashes=1, lower=True, between=_BETWEEN)
    n_docs, stride, n_items = len(off) - 1, index.stride, len(index.ids)
    count = np.bincount(w.doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    n_pass = np.maximum(1, -(-count // stride) - 1) * (count > 0)
    base = np.concatenate([[0], np.cumsum(n_pass)])
    term = np.searchsorted(index.terms, w.hashes[0])
    known = term < len(index.terms)
    known[known] = index.terms[term[known]] == w.hashes[0][known]
    at = np.flatnonzero(known)
    slot = (at - first[w.doc[at]]) // stride
    here, last = base[w.doc[at]], n_pass[w.doc[at]] - 1
    passage = np.concatenate([here + np.minimum(slot, last), (here + np.minimum(slot, last) - 1)[(slot > 0) & (slot <= last)]])
    terms = np.concatenate([term[at], term[at][(slot > 0) & (slot <= last)]])
    pair = np.unique(passage * np.int64(len(index.terms)) + terms)
    passage, terms = pair // len(index.terms), pair % len(index.terms)
    hope = np.bincount(passage, weights=index.best[terms], minlength=int(base[-1])) >= threshold
    ok = hope[passage]
    passage, terms = passage[ok], terms[ok]
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    step = max(1, most_cells // max(1, index.n_blocks))
    edges = np.searchsorted(passage, np.arange(0, int(base[-1]) + step, step))
    for lo, hi, p0 in zip(edges[:-1], edges[1:], range(0, int(base[-1]) + step, step), strict=False):
        if lo == hi:
            continue
        p, t = passage[lo:hi] - p0, terms[lo:hi]
        who, where = _expand(index.block_row, t)
        bound = np.bincount(p[who] * index.n_blocks + index.block[where], weights=index.block_best[where], minlength=step * index.n_blocks)
        open_ = bound >= threshold
        some = open_.reshape(step, index.n_blocks).any(axis=1)[p]
        p, t = p[some], t[some]
        who, where = _expand(index.row, t)
        go = open_[p[who] * index.n_blocks + index.item[where] // ITEMS_PER_BLOCK]
        who, where = who[go], where[go]
        cell, place = np.unique(p[who] * np.int64(n_items) + index.item[where], return_inverse=True)
        score = np.bincount(place, weights=index.weight[where], minlength=len(cell))
        for c, s in zip(cell[score >= threshold].tolist(), score[score >= threshold].tolist(), strict=True):
            q, item = c // n_items + p0, c % n_items
            d = int(np.searchsorted(base, q, "right")) - 1
            a = first[d] + (q - base[d]) * stride
            b = first[d + 1] if q + 1 == base[d + 1] else a + 2 * stride
            k = min(SHINGLE, int(index.words[item]))
            seen = _shingles(w.hashes[0][a:b], k)
            q_all, a_all = index.question[item], index.answer[item]
            q_share = float(np.isin(q_all, seen).mean()) if len(q_all) else -1.0
            a_share = float(np.isin(a_all, seen).mean()) if len(a_all) else -1.0
            key = (d, item)
            if key not in found or (q_share, a_share, s) > (found[key][1], found[key][2], found[key][0]):
                found[key] = (s, q_share, a_share)
    return [(d, item, *v) for (d, item), v in sorted(found.items())]


def leaks(question: float, answer: float, both: float = 0.5) -> bool:
    """Whether overlaps make a leak: question and answer together. An item without one of them (-1) asks for the other."""
    return max(question, answer) >= 0 and all(x < 0 or x >= both for x in (question, answer))


def leaked_items(index, threshold: float = 0.4, text_col: str = "text"):
    """Column of HITS for a text column; ``index`` is a broadcast Index."""

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        data, off = buffers(texts)
        lists, rows = [0], []
        own = index.value
        for lo, hi in chunks(off):
            by: dict[int, list] = {}
            for d, item, *v in search(own, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], threshold) if own.ids else ():
                if leaks(v[1], v[2]):
                    by.setdefault(d, []).append((own.ids[item], *v))
            for d in range(hi - lo):
                rows += by.get(d, ())
                lists.append(len(rows))
        tidy()
        cols = [pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.float64()) for i in range(4)]
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(cols, names=["item_id", "score", "question_overlap", "answer_overlap"]))

    return hits(F.col(text_col))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, text_col: str = "text", out_col: str = "leaks", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with ``out_col``, an array of (item_id, score, question_overlap, answer_overlap) of the test items that a document leaks.

    Every passage of every document is a BM25 query against an inverted index of the items; scores are shares of the score that an
    item has against itself, and all items above ``threshold`` are retrieved, skipping blocks of items whose
    largest weights cannot reach it. A retrieved item is verified by five-word shingles: half of
    the question's and half of the answer's have to be in the passage.

    The index goes to every executor, so a benchmark of more than ``index_bytes`` is dealt into that many indexes by item,
    and the documents pass one after the other, written in between; document frequencies, lengths and passages are those of all items, so the result is the same for any
    number of indexes. Items come in order of id (null first), score and overlaps.

    Null or empty text: no items. Very long texts: passage by passage. Items without words: never found. Null item ids (or ids that are no whole numbers): found, as null. Repeated
    rows: as they come. Empty tables: nothing found. All other columns stay, one named like ``out_col`` as ``out_col``_1.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).try_cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL AND t RLIKE '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]'")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // index_bytes))
    docs = making_room(docs, out_col)
    for i, (part, corpus) in enumerate(_dealt(items, shards)):
        index = spark.sparkContext.broadcast(Index(part, corpus))
        hits = leaked_items(index, threshold, text_col)
        docs = docs.withColumn(out_col, F.array_sort(F.concat(out_col, hits) if i else hits))
        if shards > 1:  # one index at a time is held
            docs = written(docs)
            index.destroy()
    return docs


def _dealt(items: DataFrame, shards: int) -> Iterator[tuple[list[tuple[int | None, str]], Corpus | None]]:
    """(items, statistics of all items) of each shard; one shard at a time is on the driver, and of the statistics its own terms."""
    read = lambda df: sorted(((r["i"], r["t"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
    if shards == 1:
        yield read(items), None
        return

    @F.arrow_udf("struct<words:bigint,terms:array<bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        words, lists = [], []
        for t in texts.to_pylist():
            w, _ = item_words([t])
            words.append(len(w.doc))
            lists.append(np.unique(w.hashes[0]).view(np.int64))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["words", "terms"])

    rows = written(items.select("i", "t", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).alias("s"), counted("t").alias("c")).select("i", "t", "s", "c.*"))
    n, mean, most = rows.agg(F.count("*"), F.avg("words"), F.max("words")).first()
    term = rows.select("s", F.explode("terms").alias("term"))
    df = term.groupBy("term").agg(F.count("*").alias("df"))
    df = written(term.distinct().join(df, "term"))
    for s in range(shards):
        own = df.where(F.col("s") == s).select("term", "df").toPandas()
        terms, times = own["term"].to_numpy().view(np.uint64), own["df"].to_numpy()
        order = np.argsort(terms)
        yield read(rows.where(F.col("s") == s)), Corpus(n, mean, most, terms[order], times[order])
