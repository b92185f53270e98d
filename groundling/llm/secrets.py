"""Secret scan by regular expressions and linking of complementary credential parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: (kind, pattern, part, strings of which any match holds one, in lower case): the first three kinds are reported wherever they match, the others only when linked.
KINDS = (
    ("assign", ASSIGN, "secret", ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", "AKIA[A-Z0-9]{16,}", "identifier", ("akia",)),
    ("hex", "[0-9a-f]{24,}", "secret", ()),
    ("ident", "(?i:\\b(?:user(?:name)?|login|client_?id|account|access_?key_?id))[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9._@+-]{3,}", "identifier", ("user", "login", "client", "account", "access")),
    ("blob", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}", "secret", ()),
    ("endpoint", "(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\s\"'<>]+", "endpoint", ("://",)),
)
BASE = ("assign", "access", "hex")
#: What has to stand near a weak candidate of each kind for it to be reported.
ASKS = {"ident": ("secret",), "blob": ("identifier",), "endpoint": ("secret", "identifier")}
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


def scan_secrets(docs: DataFrame, scope: int = 200, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of secrets in every row of ``docs``: one row per row, with ``keep``, the counts
    n_assign, n_access, n_hex and n_linked, base and found: arrays of (start, rank, kind, end) in
    code points, end exclusive, sorted (found also has the linked weak spans), and links: for every reported weak span
    (start, kind) the nearest identifier, secret and endpoint starts in its scope that it was reported for (null: not asked for).

    Strong kinds are reported wherever they match. Weak ones (a user name, a long blob, an
    endpoint) are candidates: a name is reported with a secret part, a blob with an identifier part, an endpoint with both. A blob that overlaps a
    strong span is that span, not a part of its own.

    The interval join: every part is keyed by the scope-long interval that its start lies in, a candidate by that and the two
    beside it; equal keys of one row meet, and parts whose starts lie within ``scope`` code points of each other are its complements. Parts
    do not overlap within a kind, so an interval holds a bounded number of them and the join grows with the parts.

    Texts without any of a kind's strings are not searched for it. Null text: no spans. Empty and very long texts: as all others. Repeated rows: rows of their own. Empty table: no rows. Extra columns are left out,
    whatever their names. The marks are private-use characters; the same characters in a text become another of equal length first.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], clean.alias("_t"), F.monotonically_increasing_id().alias("_row")).withColumn("_l", F.lower("_t"))
    cuts, parts = {}, []
    for rank, (kind, pattern, _, held) in enumerate(KINDS):
        cut = F.split(F.regexp_replace("_t", pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
        may = F.lit(False)
        for x in held:
            may = may | F.contains(F.col("_l"), F.lit(x))
        if not held:  # one search less where nothing is replaced
            may = F.col("_t").rlike(pattern)
        cuts[f"_c{rank}"] = F.when(may, cut)
        ok = "length(regexp_extract(x, '{}', 2)) >= 6".format(ASSIGN.replace("\\", "\\\\").replace("'", "\\'")) if kind == "assign" else "true"
        parts.append(f"IF(size(_c{rank}) > 1, transform(_c{rank}, (x, i) -> struct(CAST({rank} AS INT) AS rank, i AS seq, char_length(x) AS len, i % 2 = 1 AND {ok} AS hit)), CAST(array() AS ARRAY<STRUCT<rank:INT,seq:INT,len:INT,hit:BOOLEAN>>))")
    rows = rows.withColumns(cuts).select("_row", *names, F.expr(f"concat({', '.join(parts)})").alias("_parts"))
    rows = written(rows.select("_row", *names, F.explode_outer("_parts").alias("_p")).select("_row", *names, "_p.*"))

    own = Window.partitionBy("_row", "rank").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.where("rank IS NOT NULL").withColumn("end", F.sum("len").over(own)).withColumn("start", F.col("end") - F.col("len")).where("hit")
    upto = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("_row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    base = F.col("rank") < len(BASE)
    kinds = [k[0] for k in KINDS]
    clash = (F.col("rank") == kinds.index("blob")) & (
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(upto), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(base, F.col("start"))).over(onward), F.lit(1 << 60)) < F.col("end"))
    )
    spans = spans.withColumn("_clash", clash).where("NOT _clash").select("_row", "rank", "start", "end")
    at = F.floor(F.col("start") / scope).cast("long")
    which = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), F.col("rank") + 1)
    beside = spans.where(F.col("rank") != kinds.index("endpoint")).select("_row", at.alias("_at"), F.col("start").alias("_start"), which.alias("_part"), F.col("rank").alias("_rank"))
    asks = [F.when(F.col("rank") == kinds.index(k), F.array(*[F.lit(p) for p in v])) for k, v in ASKS.items()]
    weak = spans.where(~base).select("_row", "rank", "start", "end", F.coalesce(*asks).alias("_asks"), F.explode(F.array(at - 1, at, at + 1)).alias("_at"))
    gap = F.abs(F.col("_start") - F.col("start"))
    met = weak.join(beside, ["_row", "_at"]).where((gap <= scope) & F.array_contains(F.col("_asks"), F.col("_part")) & ((F.col("_rank") != F.col("rank")) | (F.col("_start") != F.col("start"))))
    nearest = {p: F.min(F.when(F.col("_part") == p, F.struct(gap.alias("gap"), F.col("_start").alias("at")))).alias(f"_{p}") for p in ("identifier", "secret")}
    linked = met.groupBy("_row", "rank", "start", "end").agg(*nearest.values(), F.first(F.size("_asks")).alias("_n"))
    linked = linked.where(sum(F.col(f"_{p}").isNotNull().cast("int") for p in nearest) == F.col("_n"))

    name = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("rank") + 1)
    span = F.struct(F.col("start"), F.col("rank"), name.alias("kind"), F.col("end"))
    link = F.struct(F.col("start"), name.alias("kind"), F.col("_identifier.at").alias("identifier"), F.col("_secret.at").alias("secret"))
    strong = spans.where(base).select("_row", "rank", "start", span.alias("s"), F.lit(None).cast("struct<start:bigint,kind:string,identifier:bigint,secret:bigint>").alias("l"))
    found = strong.union(linked.select("_row", "rank", "start", span.alias("s"), link.alias("l")))
    found = found.groupBy("_row").agg(
        *[F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.count("l").alias("n_linked"),
        F.array_sort(F.collect_list(F.when(base, F.col("s")))).alias("base"),
        F.array_sort(F.collect_list("s")).alias("found"),
        F.array_sort(F.collect_list("l")).alias("links"),
    )
    # whole rows: one for every row of docs, its parts or none
    one = rows.where("seq IS NULL OR seq = 0").groupBy("_row").agg(*[F.first(n).alias(n) for n in names])
    out = one.join(found, "_row", "left")
    empty = {c: found.schema[c].dataType for c in ("base", "found", "links")}
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (*BASE, "linked")],
        *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()],
    )


def span_text(column: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def link_text(column: str):
    """kind:start:identifier:secret of each link, comma-joined; - where a part was not asked for."""
    at = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], at(s["start"]), at(s["identifier"]), at(s["secret"]))), ",")
