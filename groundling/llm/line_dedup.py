"""Removal of later copies of runs of lines: winnowed line hashes, joined places, extension both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import making_room, unused, written


def _key(id_col: str, text_col: str) -> list:
    return [F.col(id_col).try_cast("long").isNull().alias("no"), F.col(id_col).try_cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h1"), F.crc32(F.col(text_col).cast("binary")).alias("h2")]


def _body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, w): key of each document that has a text, hashes and words of its lines."""
    body = docs.where(F.col(text_col).isNotNull()).select(*_key(id_col, text_col), F.split(F.col(text_col), "\n", -1).alias("x"))
    body = body.select(F.struct("no", "id", "h1", "h2").alias("k"), F.transform("x", lambda s: F.xxhash64(s)).alias("h"), F.transform("x", lambda s: F.regexp_count(s, F.lit("[^\\x20\\x09-\\x0D]+"))).alias("w"))
    return written(body.groupBy("k").agg(F.first("h").alias("h"), F.first("w").alias("w")))


def _without(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with the struct ``out_col``, without the lines of ``runs`` (k, runs: array of first and last line)."""
    key, gone, kept = (unused(docs, n) for n in ("_k", "_runs", "_kept"))
    rows = docs.withColumn(key, F.when(F.col(text_col).isNotNull(), F.struct(*_key(id_col, text_col))))
    rows = rows.join(runs.select(F.col("k").alias(key), F.col("runs").alias(gone)), key, "left")
    keep = f"filter(transform(split(`{text_col}`, '\\n', -1), (x, i) -> struct(x AS x, i AS i)), s -> NOT exists(coalesce(`{gone}`, array()), r -> s.i BETWEEN r.s AND r.e))"
    rows = rows.withColumn(kept, F.expr(keep))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(0)))
    result = F.struct(
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(text_col).isNull(), 0).otherwise(n_lines - F.size(kept)).cast("long").alias("n_removed"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_runs"),
        F.array_join(F.expr(f"transform(`{kept}`, s -> s.x)"), "\n").alias("kept"),
    )
    rows = rows.withColumn(unused(rows, "_result"), result)
    result = rows.columns[-1]
    room = making_room(docs, out_col).columns
    return rows.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, room, strict=True)], F.col(result).alias(out_col))


def remove_all_repeated_lines(docs: DataFrame, min_words: int = 20, long_line: int = 50, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """``docs`` with the struct ``out_col``: n_lines, n_removed, n_runs and kept, the text without any later repeated run of lines.

    A run of two lines or more with ``min_words`` words, or a line of ``long_line`` words, that stands at an earlier place is
    removed, whichever place that is. Every line of such a run is in a window: the shortest run that starts or ends there or spans it, cut as soon as it
    has ``min_words`` words and two lines. Where a window is cut depends on its lines alone, so equal windows are cut alike everywhere.

    Winnowing: of each window the least line hash (the last of equals) is selected. As the windows are the shortest runs that count,
    every repeated run holds a selected place, with the same hash wherever it stands; a hash selected in one place only rules all windows around it
    out. The others are joined by their lines with the window's first place in the table (least id), which is enough, as whatever
    window has any earlier place is removed. Matches extend both ways through all windows that overlap or touch; n_runs counts these stretches.

    Only hashes and places are shuffled, with partial aggregates for selected places and the first place; both sides of each join are
    exchanges, so a window that stands in many documents can be split. Windows of wordless lines are as long as the stretch of such lines.
    Null text: no lines, kept stays null. Empty text: one empty line. Very long texts: work by lines, each in few windows. Null ids come last in order. Ids are whole numbers; one that is not counts as null.
    Rows equal in id and text are one document and share its result. Empty table: no rows. All other columns stay, one named like
    ``out_col`` as ``out_col``_1.
    """
    least, most = min(1, max(0, min_words)), max(1, min_words)
    body = _body(docs, id_col, text_col).select("k", "h", "w", F.expr(f"filter(sequence(0, size(w) - 1), i -> w[i] >= {least})").alias("v"), F.expr(f"filter(w, x -> x >= {least})").alias("wv"))

    # v: lines with words; to, since: where the window from or to each of them is cut
    upto = f"aggregate({{}}, struct(0L AS n, 0 AS c), (a, x) -> IF(a.c > 0 AND a.n >= {min_words}, a, struct(a.n + x AS n, a.c + 1 AS c)), a -> IF(a.n >= {min_words}, v[{{}}], NULL))"
    ahead = upto.format(f"slice(wv, t + 1, {most})", "t + a.c - 1")
    back = upto.format(f"reverse(slice(wv, greatest(t + 2 - {most}, 1), least(t + 1, {most})))", "t - a.c + 1")
    cut = body.select("k", "h", "w", "v", F.expr(f"transform(v, (y, t) -> {ahead})").alias("to"), F.expr(f"transform(v, (y, t) -> {back})").alias("since"))
    place = "shiftleft(CAST({} AS BIGINT), 31) + {}"
    starts = f"transform(v, (y, t) -> IF(to[t] IS NULL, array(), transform(sequence(IF(t = 0, 0, v[t - 1] + 1), y), i -> IF(greatest(to[t], i + 1) < size(h), {place.format('i', 'greatest(to[t], i + 1)')}, NULL))))"
    ends = f"transform(v, (y, t) -> IF(since[t] IS NULL, array(), transform(sequence(y, IF(t + 1 = size(v), size(h), v[t + 1]) - 1), i -> IF(least(since[t], i - 1) >= 0, {place.format('least(since[t], i - 1)', 'i')}, NULL))))"
    alone = f"transform(filter(v, i -> w[i] >= {max(min_words, long_line)}), i -> {place.format('i', 'i')})"
    windows = cut.select("k", "h", F.expr(f"filter(array_distinct(concat(flatten({starts}), flatten({ends}), {alone})), x -> x IS NOT NULL)").alias("x"))
    windows = windows.select("k", "h", F.expr("transform(x, x -> struct(CAST(shiftright(x, 31) AS INT) AS s, CAST((x & 2147483647) - shiftright(x, 31) AS INT) + 1 AS m)) AS x"))
    lines = "slice(h, x.s + 1, x.m)"
    places = windows.select("k", F.explode(F.expr(f"transform(x, x -> struct(array_min({lines}) AS c, xxhash64({lines}) AS f, hash({lines}) AS g, x.m AS m, x.s AS s, x.s + x.m - array_position(reverse({lines}), array_min({lines})) AS p))")).alias("p"))
    places = written(places.select("k", "p.*"))
    # a hash selected at two places: least and greatest name of a place differ
    name = F.xxhash64("k", "p")
    again = places.groupBy("c").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("c")
    places = written(places.join(again, "c", "left_semi").select("k", "f", "g", "m", "s"))
    first = written(places.groupBy("f", "g", "m").agg(F.min(F.struct("k", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").select("f", "g", "m", "first"))
    later = places.join(first, ["f", "g", "m"]).where("k <> first.k OR s <> first.s").select("k", "s", (F.col("s") + F.col("m") - 1).alias("e"))

    # windows that overlap or touch are one stretch
    by = Window.partitionBy("k").orderBy("s", "e")
    later = later.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("k", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return _without(docs, runs, id_col, text_col, out_col)


def remove_repeated_lines(docs: DataFrame, min_words: int = 20, long_line: int = 50, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """``docs`` with the struct ``out_col``: n_lines, n_removed, n_runs and kept, the text without later repeated runs of lines.

    A fingerprint is the hash of two neighbouring lines; of every two neighbouring fingerprints the
    smaller (the right one if equal) is selected, so any repeated run of three lines has one; each is compared with one earlier place
    only. What it removes is a repeated run, but some stay: ``remove_all_repeated_lines`` finds every one. Lines of
    ``long_line`` words or more are fingerprints of their own. A selected place is joined with the same
    fingerprint's place before it in the document or, for the first there, with the first place in the
    table (least id). Each join fixes a shift between two documents; along it the match is
    extended both ways while lines are equal. A run found so is removed if it has
    ``min_words`` words and two lines, or is a long line; runs are judged on the input.

    Only line hashes and places are shuffled, grouped by fingerprint and document, with partial aggregates for the first place,
    so common lines gather nowhere; text meets its result once. Null text: no lines, kept stays null.
    Empty text: one empty line. Null ids come last in order. Rows equal in id and text are one document and share its result. Empty table: no rows.
    All other columns stay.
    """
    body = _body(docs, id_col, text_col)

    # places of selected fingerprints
    g = "transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1]))"
    pairs = body.select("k", "h", "w", F.expr(f"IF(size(h) > 1, {g}, array())").alias("g"))
    chosen = "filter(transform(g, (x, i) -> struct(x AS f, i AS p)), s -> size(g) = 1 OR (s.p + 1 < size(g) AND s.f < g[s.p + 1]) OR (s.p > 0 AND s.f <= g[s.p - 1]))"
    alone = f"filter(transform(h, (x, i) -> struct(xxhash64(x, 'line') AS f, i AS p)), s -> w[s.p] >= {long_line})"
    places = pairs.select("k", F.explode(F.expr(f"concat({chosen}, {alone})")).alias("s")).select("k", "s.f", "s.p")
    own = places.groupBy("f", "k").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    own = written(own)
    first = own.groupBy("f").agg(F.min(F.struct("k", F.element_at("ps", 1).alias("p"))).alias("first"), F.sum(F.size("ps")).alias("n")).where("n > 1").select("f", "first")
    met = own.join(first, "f")
    shifts = met.select(
        "k",
        F.explode(
            F.expr(
                "concat(IF(k <> first.k, array(struct(first.k AS a, ps[0] - first.p AS d, ps[0] AS p)), array()),"
                " IF(size(ps) > 1, transform(slice(ps, 2, size(ps) - 1), (p, i) -> struct(k AS a, p - ps[i] AS d, p AS p)), array()))"
            )
        ).alias("m"),
    ).select("k", "m.*")
    shifts = shifts.groupBy("k", "a", "d").agg(F.collect_set("p").alias("ps"))

    # extension along each shift
    other = body.select(F.col("k").alias("a"), F.col("h").alias("ha"))
    both = shifts.join(other, "a").join(body, "k")
    breaks = "filter(sequence(-1, size(h)), i -> i < 0 OR i >= size(h) OR i - d < 0 OR i - d >= size(ha) OR h[i] <> ha[i - d])"
    both = both.select("k", "w", "ps", F.expr(breaks).alias("b"))
    run = "transform(ps, p -> struct(array_max(filter(b, x -> x < p)) + 1 AS s, array_min(filter(b, x -> x > p)) - 1 AS e))"
    long_enough = f"r.e >= r.s AND aggregate(slice(w, r.s + 1, r.e - r.s + 1), 0, (x, y) -> x + y) >= {min_words} AND (r.e > r.s OR w[r.s] >= {long_line})"
    runs = both.select("k", F.explode(F.expr(f"filter(array_distinct({run}), r -> {long_enough})")).alias("r")).groupBy("k").agg(F.collect_set("r").alias("runs"))
    return _without(docs, runs, id_col, text_col, out_col)
