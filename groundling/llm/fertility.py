"""Quality rules: base counts and tokeniser fertility with rejection bands by language or script."""

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hash import Words, buffers, chunks, covered, mix, tidy
from ._spark import making_room

#: Language: characters per token of the byte-level vocabulary and per piece of the other that its prose does not fall short of, measured on the labelled
#: test rows. Noise and shuffled letters break into more tokens. There is no upper bound near prose: ordinary text has more characters a token than the invented one.
BANDS = {"en": (2.52, 2.50), "de": (2.56, 2.50), "fr": (2.29, 2.22), "es": (2.31, 2.16)}
#: Script of most letters, for other languages: (code points from, name, least characters per token and per piece, largest share of byte pieces). Only what no
#: prose of the script has is rejected: letters that neither vocabulary holds take one token a byte.
SCRIPTS = (
    (0x0000, "latin", 1.6, 1.5, 0.25), (0x0370, "greek", 0.55, 0.55, 0.6), (0x0400, "cyrillic", 0.7, 0.7, 0.5), (0x0530, "other", 0.3, 0.3, 1.0), (0x0590, "hebrew", 0.5, 0.5, 0.8), (0x0600, "arabic", 0.5, 0.5, 0.8),
    (0x0700, "other", 0.3, 0.3, 1.0), (0x0900, "indic", 0.3, 0.3, 1.0), (0x0E00, "thai", 0.3, 0.3, 1.0), (0x0E80, "other", 0.3, 0.3, 1.0), (0x1100, "hangul", 0.3, 0.3, 1.0), (0x1200, "other", 0.3, 0.3, 1.0),
    (0x1E00, "latin", 1.6, 1.5, 0.25), (0x1F00, "greek", 0.55, 0.55, 0.6), (0x2000, "other", 0.3, 0.3, 1.0), (0x3040, "cjk", 0.3, 0.3, 1.0), (0xA000, "other", 0.3, 0.3, 1.0), (0xAC00, "hangul", 0.3, 0.3, 1.0), (0xD7B0, "other", 0.3, 0.3, 1.0),
    (0xF900, "cjk", 0.3, 0.3, 1.0), (0xFB00, "other", 0.3, 0.3, 1.0), (0x20000, "cjk", 0.3, 0.3, 1.0),
)
#: For every language: most characters per token, share of byte pieces where the language has a band, and bits of entropy of a long text.
MOST_CHARS, MOST_FALLBACK, ENTROPY = 12.0, 0.08, 4.6
MIN_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
RESULT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,n_tokens:bigint,chars_per_token:double,token_entropy:double,chars_per_piece:double,fallback_share:double,script:string,kept:boolean>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def vocabulary_paths(names: tuple[str, str] = ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")) -> tuple[str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in names)


def _load(paths: tuple[str, str]):
    """(byte-level encoder, its size, piece encoder, mask of its byte pieces)."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(paths[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    single = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())], dtype=bool)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1, pieces, single


_vocabularies = functools.cache(_load)


_SCRIPT_FROM = np.array([s[0] for s in SCRIPTS])
_SCRIPT_NAMES = sorted({s[1] for s in SCRIPTS})
_SCRIPT_OF = np.array([_SCRIPT_NAMES.index(s[1]) for s in SCRIPTS])
_SCRIPT_BAND = {s[1]: s[2:] for s in SCRIPTS}


def script_of(text: str) -> str:
    """The script of most letters (code points that are neither ASCII signs nor digits); without any, latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = points[(points >= 0xAA) | (((points | 32) >= 97) & ((points | 32) <= 122))]
    if not len(letters):
        return "latin"
    return _SCRIPT_NAMES[int(np.bincount(_SCRIPT_OF[np.searchsorted(_SCRIPT_FROM, letters, "right") - 1], minlength=len(_SCRIPT_NAMES)).argmax())]


def _sum_by(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weights=weight, minlength=n).astype(np.int64)


def measure(data: np.ndarray, off: np.ndarray, langs: list, vocabularies: tuple) -> dict[str, np.ndarray]:
    """Every column of RESULT for consecutive documents."""
    n = len(off) - 1
    size = np.diff(off)
    w = Words(data, off, hashes=2)
    running = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    n_words = _sum_by(w.doc, n)
    word_chars = _sum_by(w.doc, n, points[w.end] - points[w.start])
    at, hashes = w.windows(REPEAT_WINDOW)
    key = mix(hashes[0] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = _sum_by(w.doc[covered(len(w.start), at[twice], REPEAT_WINDOW)], n)

    encoder, size_of, pieces, single = vocabularies
    raw = data.tobytes()
    lines = np.zeros(n, np.int64)
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    for i, text in enumerate(texts):
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip("\t\n\x0b\x0c\r "):
                lines[i] += line in seen
                seen.add(line)
    tokens = [np.asarray(encoder.encode_ordinary(t), dtype=np.int64) for t in texts]
    broken = [np.asarray(ids, dtype=np.int64) for ids in pieces.encode(texts, num_threads=1)]
    counts, n_pieces = (np.array([len(x) for x in ids], np.int64) for ids in (tokens, broken))
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), counts)
    pair, times = np.unique(owner * size_of + flat, return_counts=True)
    owner = pair // size_of
    share = times / counts[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=n)
    fell = np.array([single[ids].sum() for ids in broken], float) / np.maximum(n_pieces, 1)

    chars = running(lead)
    some = np.maximum(counts, 1)
    cpt, cpp = chars / some, chars / np.maximum(n_pieces, 1)
    base_failed = (n_words < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    scripts = [script_of(t) for t in texts]
    band = np.array([(*BANDS[x], MOST_FALLBACK) if x in BANDS else _SCRIPT_BAND[s] for x, s in zip(langs, scripts, strict=True)], float).reshape(n, 3)
    known = np.array([x in BANDS for x in langs], dtype=bool)
    wide = np.where(known, 3 / np.sqrt(some) + 10 / some, 0)  # short texts scatter
    bad = (cpt < band[:, 0] - wide) | (cpp < band[:, 1] - wide) | (np.maximum(cpt, cpp) > MOST_CHARS) | (fell > band[:, 2] + 0.6 / np.sqrt(some))
    bad |= entropy < np.minimum(np.where(known, ENTROPY, 3.0), np.where(known, 0.72, 0.5) * np.log2(some) - 0.5)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": running(_SYMBOL[data]), "n_dup_lines": lines, "n_repeat_words": repeated,
        "base_failed": base_failed, "n_tokens": counts, "chars_per_token": cpt, "token_entropy": entropy, "chars_per_piece": cpp, "fallback_share": fell, "script": np.array(scripts, dtype=object), "kept": ~base_failed & ~bad & (size > 0),
    }


def quality(text_col: str = "text", lang_col: str = "lang", vocabularies: tuple[str, str] | None = None):
    """Column of RESULT for a text column, measured batch by batch in Arrow memory.

    A document is rejected if it has too few words or too many in repeated windows, or if the characters
    per token of a byte-level vocabulary or per piece of one with byte fallback, the share of byte pieces or the entropy of tokens lie outside the band of
    its language, or of the script of most of its letters if the language has no band (or is null).
    Null text: as empty, and empty texts fail. Very long texts: tokenised whole. Nothing is compared across rows, so repeated rows get equal results. Empty table: no rows.
    """
    paths = vocabularies or vocabulary_paths()

    @F.arrow_udf(RESULT)
    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        loaded = _load(paths)  # for this task only: workers live on beside the JVM
        names = [f.split(":")[0] for f in RESULT[7:-1].split(",")]
        for texts, langs in batches:
            data, off = buffers(texts)
            langs = langs.to_pylist()
            out: dict[str, list] = {}
            for lo, hi in chunks(off):
                part = measure(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], langs[lo:hi], loaded)
                for k, v in part.items():
                    out.setdefault(k, []).append(v)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(out[k])) if out else pa.array([], pa.int64()) for k in names], names=names)
            tidy()
        del loaded
        tidy()

    return judged(F.col(text_col), F.col(lang_col).cast("string"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabularies: tuple[str, str] | None = None, out_col: str = "quality") -> DataFrame:
    """``docs`` with the struct column ``out_col`` (see ``quality``); rows and other columns stay as they are, one of that name as ``out_col``_1."""
    return making_room(docs, out_col).withColumn(out_col, quality(text_col, lang_col, vocabularies))
