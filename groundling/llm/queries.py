"""Queries over the operators of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import find_leaks
from .fertility import quality
from .html_text import main_text
from .jaccard_join import near_duplicates
from .line_dedup import remove_all_repeated_lines
from .packing import pack_sequences
from .secrets import link_text, scan_secrets, span_text
from .sharding import shard_by_bytes
from .substring_dedup import remove_seen_windows
from .suffix_dedup import remove_repeated_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality().alias("q")).select("doc_id", "q.*")


def op3_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), 4096)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", F.inline_outer("leaks")).where("score IS NOT NULL")  # outer: a filter on the array would search twice
    return rows.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op5_seen_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_seen_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("found").alias("spans"), "n_linked", link_text("links").alias("links")
    )


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_all_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.n_runs", F.sha2(F.coalesce("lines.kept", F.lit("")), 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", main_text().alias("m"))
    return found.select("page_id", "url", "m.text", F.char_length("m.text").cast("long").alias("n_chars"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start_byte")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op2_fertility``, which SQL can express."""
    return op2_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op6_secret_links``, which SQL can express."""
    return op6_secret_links(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {n: f for n, f in own.items() if n.startswith("op") and callable(f)} | {"quality_base": quality_base, "secret_base": secret_base}


_WORDS = "[^\\x20\\x09-\\x0D]+"
#: The windows joined as plain text: too slow for large tables, but independent of every hash.
SEEN_WINDOWS_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS l FROM documents),
 g AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 12), ' ') AS k FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 12)) AS i FROM d WHERE len(l) >= 13)),
 m AS (SELECT k, min(doc_id) AS d0 FROM g GROUP BY k),
 r AS (SELECT DISTINCT g.doc_id, g.i + t.j AS pos FROM g JOIN m ON m.k = g.k CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS j) t WHERE m.d0 < g.doc_id),
 w AS (SELECT doc_id, unnest(l) AS word, unnest(generate_series(1, len(l))) AS pos FROM d),
 k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS kept FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos WHERE r.pos IS NULL GROUP BY w.doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
SHINGLE_JOIN_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS l FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 3 THEN array_to_string(l, ' ') ELSE array_to_string(list_slice(l, i, i + 2), ' ') END AS k FROM (SELECT doc_id, l, unnest(generate_series(1, greatest(1, len(l) - 2))) AS i FROM d WHERE len(l) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON b.k = a.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT c.x, c.y FROM c JOIN n p ON p.doc_id = c.x JOIN n q ON q.doc_id = c.y WHERE 100 * c.c >= 90 * (p.n + q.n - c.c)),
 reach(x, y) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
 least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.m, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id"""


QUALITY_BASE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS l FROM documents),
 g AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 7), ' ') AS k FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 7)) AS i FROM d WHERE len(l) >= 8)),
 r AS (SELECT doc_id, count(DISTINCT g.i + t.j) AS n FROM g JOIN (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1) m USING (doc_id, k) CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS j) t GROUP BY doc_id),
 c AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d)
 SELECT c.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN r ON r.doc_id = c.doc_id"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + """)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_BASE_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS x FROM d)"
    for rank, (kind, pattern) in enumerate((("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")))
)
#: Matches between two marks are every second piece of a text; their places are the lengths of the pieces before.
SECRET_BASE_SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS t FROM documents),
 p AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM ({_BASE_SPANS})),
 f AS (SELECT doc_id, rank, kind, stop - length(x) AS start, stop FROM p WHERE i % 2 = 0 AND CASE rank WHEN 0 THEN length(regexp_extract(x, '{_ASSIGN}', 2)) >= 6 WHEN 1 THEN length(x) >= 20 ELSE length(x) >= 24 END)
 SELECT d.doc_id, count(CASE WHEN rank = 0 THEN 1 END) AS n_assign, count(CASE WHEN rank = 1 THEN 1 END) AS n_access, count(CASE WHEN rank = 2 THEN 1 END) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')) AS base_sha256 FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
#: Every string of 200 bytes of every text, and the runs that the repeated ones cover.
REPEATED_BYTES_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 g AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) / 2 AS BIGINT) - 200)) AS i FROM d WHERE length(h) >= 400)),
 m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM g) WHERE n > 1),
 s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m),
 r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
 f AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
 q AS (SELECT d.doc_id, sum(f.b - f.a) AS n, count(*) AS spans, string_agg(substr(d.h, CAST(2 * f.since + 1 AS BIGINT), CAST(2 * (f.a - f.since) AS BIGINT)), '' ORDER BY f.a) || max(CASE WHEN f.back = 1 THEN substr(d.h, CAST(2 * f.b + 1 AS BIGINT)) END) AS kept FROM d JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id)
 SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(q.n, 0) AS BIGINT) AS n_removed, coalesce(q.spans, 0) AS n_spans, sha256(unhex(coalesce(q.kept, d.h))) AS kept_sha256 FROM d LEFT JOIN q ON q.doc_id = d.doc_id"""
#: Every line against every earlier equal one, and runs along each shift between two documents: the definition, without windows or hashes.
LINE_RUNS_SQL = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, i, x, CAST(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS w FROM (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM d)),
 e AS (SELECT a.doc_id, a.i, a.w, b.doc_id AS other, a.i - b.i AS shift FROM l a JOIN l b ON b.x = a.x AND (b.doc_id, b.i) < (a.doc_id, a.i)),
 t AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM e),
 r AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM t GROUP BY doc_id, other, shift, run HAVING sum(w) >= 20 AND (count(*) > 1 OR sum(w) >= 50)),
 gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM (SELECT DISTINCT doc_id, s, e FROM r)),
 n AS (SELECT doc_id, count(*) AS n, count(CASE WHEN new THEN 1 END) AS runs FROM (SELECT doc_id, i, i - lag(i, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) > 1 AS new FROM gone) GROUP BY doc_id),
 k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i WHERE gone.i IS NULL GROUP BY l.doc_id)
 SELECT c.doc_id, coalesce(CAST(len(d.x) AS BIGINT), 0) AS n_lines, coalesce(n.n, 0) AS n_removed, coalesce(n.runs, 0) AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
 FROM documents c LEFT JOIN d ON d.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN k ON k.doc_id = c.doc_id"""
#: crc32 bit by bit; rows in the order of the file.
BYTE_SHARDS_SQL = """WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
 b AS (SELECT rn, list_transform(string_split(trim(regexp_replace(hex(encode(t)), '(..)', '\\1,', 'g'), ','), ','), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM d WHERE t <> ''),
 c AS (SELECT rn, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * len(l)), lambda i: (l[i // 8 + 1] >> CAST(i % 8 AS BIGINT)) & 1)), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) AS crc FROM b),
 s AS (SELECT rn, doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size FROM d),
 p AS (SELECT *, CAST(sum(size) OVER (ORDER BY rn) - size AS BIGINT) AS start_byte, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
 q AS (SELECT *, CAST(start_byte * 8 // total AS INTEGER) AS shard FROM p)
 SELECT q.doc_id, q.size, coalesce(c.crc, 0) AS text_crc32, 'bytes' AS law, q.shard, row_number() OVER (PARTITION BY q.shard ORDER BY q.rn) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, q.start_byte FROM q LEFT JOIN c ON c.rn = q.rn"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repeated_bytes": REPEATED_BYTES_SQL, "op5_seen_windows": SEEN_WINDOWS_SQL, "op7_line_runs": LINE_RUNS_SQL, "op9_shingle_join": SHINGLE_JOIN_SQL, "op10_byte_shards": BYTE_SHARDS_SQL, "quality_base": QUALITY_BASE_SQL,
        "secret_base": SECRET_BASE_SQL,
    }
