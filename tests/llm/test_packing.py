import zlib
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundling.llm import queries
from groundling.llm.packing import pack_sequences, plan, vocabulary_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=40))
def test_plan_places_every_piece_once_without_gaps(histogram):
    runs, n_seq = plan(histogram, 100, groups=5)
    seen, held = set(), defaultdict(list)
    for length, rank0, many, seq, each, offset in runs:
        for i in range(many):
            assert (length, rank0 + i) not in seen
            seen.add((length, rank0 + i))
            held[seq + i // each].append((offset + i % each * length, length))
    assert len(seen) == sum(histogram.values()) and set(held) == set(range(n_seq))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(vocabulary_path())
    want = []
    for k, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(w[3] for w in want) // capacity)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got, least = check(queries.op3_grouped_packing(spark, d).collect(), texts, 4096)
    assert got <= least * 1.01 + 1


def test_edges(spark):
    texts = [
        None, "", "  ", "It's x.'s 'll don't,can't", "A1b2 c-d_e", "É́ é,́ —,— a—b", "x <|endoftext|> y<|startoftext|>z",
        "İstanbul ΣΑΣ ſ K", "a b c", "w" * 3000, "many words, " * 3000, "same", "same", "日本語。テスト! 🎉🎉 1,234.5",
    ]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    check(pack_sequences(df, 64).collect(), list(enumerate(texts)), 64)
    assert pack_sequences(df.limit(0)).count() == 0
