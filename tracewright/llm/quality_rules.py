"""Quality rules whose thresholds follow the corpus: fences from mergeable quantile sketches.

Every text gets a few counts, all by DataFrame functions. Three shares (symbols a word, repeated
lines a line, repeated words a word; in thousandths) of the texts that pass the base rules go into
one quantile sketch per language and source. A sketch is a histogram over value-proportional
buckets, so merging sketches is adding counts: those of a language and of everything are merged ones.

A fence is where a sketch falls into two modes: of all its buckets the one that leaves the largest
variance between what is below and what is above (by bucket number, a logarithmic scale), halfway
between the two means. A sketch whose modes are not far apart, or that has few texts above, has no
fence and rejects nothing. A text is rejected above the lowest of the fences of its group, its
language and everything, so that junk which fills a whole source does not set that source's fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
SHARES = ("symbol_share", "dup_line_share", "repeat_share")
#: Sketches of fewer texts have no fence.
LEAST_TEXTS = 100
#: Buckets keep this many leading bits of a value: a relative error of at most 1/32, and 32 buckets for each doubling.
BUCKET_BITS = 6
#: Added to a share before its bucket is taken, so that shares far under a tenth do not spread over many buckets.
NEAR_ZERO = 100
#: Two modes are apart if their means are this many buckets from each other: two and a half doublings ...
APART = 80
#: ... and if the upper one holds one text in this many.
MOST_RARE = 100
#: Bits of a window's position beside its hash.
PLACE_BITS = 30


def _fresh(*frames: DataFrame) -> str:
    """A prefix that no column has."""
    prefix = "__q"
    while any(c.startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the counts and shares of every whole text.

    A null text counts as an empty one; a text without words has zero counts and shares. Columns of
    ``df`` named like an appended one are replaced, all others are kept. Repeated rows are counted
    each; an empty table gives an empty one.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    q = _fresh(df)
    kept = [c for c in df.columns if c not in (*base, *SHARES)]
    flat = F.trim(F.translate(t, BLANKS, " " * len(BLANKS)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" " + BLANKS)) != "")
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +", -1))
    df = df.select(*[F.col(f"`{c}`") for c in kept], words.alias(f"{q}w"), lines.alias(f"{q}l"), F.regexp_count(t, F.lit(SYMBOLS)).alias(f"{q}s"))
    w, n = F.col(f"{q}w"), F.size(f"{q}w")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    df = df.withColumn(f"{q}g", F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    df = _with_repeated_starts(df, q)
    starts = F.col(f"{q}r")
    covered = F.transform(starts, lambda p, k: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(starts, k + 1), p + 3) - p))
    n_lines = F.size(f"{q}l").cast("bigint")
    df = df.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": F.col(f"{q}s").cast("bigint"),
        "n_dup_lines": n_lines - F.size(F.array_distinct(f"{q}l")),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x),
        f"{q}n": n_lines,
    })
    shares = [_share("n_symbols", "n_words"), _share("n_dup_lines", f"{q}n"), _share("n_repeat_words", "n_words")]
    return df.select(*[F.col(f"`{c}`") for c in kept], *base, *[x.alias(m) for m, x in zip(SHARES, shares, strict=True)])


def _with_repeated_starts(df: DataFrame, q: str) -> DataFrame:
    """Append ``{q}r``: ascending start positions of the windows that occur more than once.

    Part of a window's hash and its position share one long, which sorts as a primitive; windows that
    meet there are then compared by their words. Texts without repeats sort nothing.
    """
    g, w, low = F.col(f"{q}g"), F.col(f"{q}w"), F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(f"{q}p", F.when(repeats, F.sort_array(F.transform(g, lambda h, i: h.bitwiseAND(F.lit(~((1 << PLACE_BITS) - 1))).bitwiseOR(i.cast("bigint"))))))

    def twins(name: str, key, position) -> Column:
        items = F.col(name)
        same = F.filter(items, lambda x, k: key(x).eqNullSafe(key(F.get(items, k + 1))) | key(x).eqNullSafe(key(F.get(items, k - 1))))
        return F.transform(same, position)

    df = df.withColumn(f"{q}c", twins(f"{q}p", lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND(low).cast("int")))
    said = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    df = df.withColumn(f"{q}e", F.sort_array(F.transform(f"{q}c", lambda p: F.struct(said(p).alias("g"), p.cast("bigint").alias("p")))))
    return df.withColumn(f"{q}r", F.coalesce(F.sort_array(twins(f"{q}e", lambda x: x["g"], lambda x: x["p"])), F.array().cast("array<bigint>")))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"{part} * 1000 div {whole}")).otherwise(F.lit(0)).cast("bigint")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def bucket(share: str) -> Column:
    """The number of a share's bucket: its doublings, and the next bits of the value."""
    v = f"({share} + {NEAR_ZERO})"
    over = f"greatest(length(bin({v})) - {BUCKET_BITS}, 0)"
    return F.expr(f"cast({1 << (BUCKET_BITS - 1)} * {over} + shiftright({v}, {over}) as bigint)")


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketches of the texts that pass the base rules, as rows (by..., metric, bucket, n).

    Sketches merge by adding ``n``. Failing texts count 0 rather than being filtered, as a filter
    would be pushed through the steps of ``measure``, each of which would be copied several times.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in SHARES]))
    rows = measured.select(*by, (~base_failed()).cast("bigint").alias("passes"), stacked.alias("m")).select(*by, "passes", "m.metric", "m.bucket")
    return rows.groupBy(*by, "metric", "bucket").agg(F.sum("passes").alias("n")).where("n > 0")


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: the fence of each metric as a bucket number with a fraction, null without one."""
    w = Window.partitionBy(*by, "metric")
    upto = w.orderBy("bucket")
    sums = sketches.withColumn("x", F.col("n") * F.col("bucket")).select(
        *by, "metric", "bucket", F.sum("n").over(w).cast("double").alias("all_n"), F.sum("x").over(w).cast("double").alias("all_x"),
        F.sum("n").over(upto).cast("double").alias("low_n"), F.sum("x").over(upto).cast("double").alias("low_x"),
    ).where("low_n < all_n")
    means = sums.select(*by, "metric", "bucket", "all_n", "low_n", (F.col("all_n") - F.col("low_n")).alias("high_n"), (F.col("low_x") / F.col("low_n")).alias("low"), ((F.col("all_x") - F.col("low_x")) / (F.col("all_n") - F.col("low_n"))).alias("high"))
    gap = F.col("high") - F.col("low")
    best = F.max_by(F.struct("all_n", "high_n", "low", "high"), F.struct((gap * gap * F.col("low_n") * F.col("high_n")).alias("v"), (-F.col("bucket")).alias("b")))
    cut = means.groupBy(*by, "metric").agg(best.alias("c")).select(*by, "metric", "c.*")
    apart = (gap >= APART) & (F.col("high_n") * MOST_RARE >= F.col("all_n")) & (F.col("all_n") >= LEAST_TEXTS)
    fence = lambda m: F.max(F.when((F.col("metric") == m) & apart, (F.col("low") + F.col("high")) / 2))
    return cut.groupBy(*by).agg(*[fence(m).alias(m) for m in SHARES])


def adaptive_fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Fences per language and source: the lowest of the group's own, its language's and the corpus's.

    Null languages and sources are groups like any other. The result has one row per group and is
    a written table, so Spark broadcasts it only if its size is under the session's limit.
    """
    named = measured.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), "n_words", "n_repeat_words", *SHARES)
    fine = written(sketch(named, ["lang", "source"]), "sketch")
    levels = [fences(fine, ["lang", "source"]), fences(merge(fine, ["lang"]), ["lang"]), fences(merge(fine.withColumn("all", F.lit(1)), ["all"]), ["all"])]
    own, mid, top = (x.select(*x.columns[: -len(SHARES)], *[F.col(m).alias(f"{m}_{k}") for m in SHARES]) for k, x in enumerate(levels))
    groups = fine.select("lang", "source").distinct().withColumn("all", F.lit(1))
    joined = groups.join(own.select(F.col("lang").alias("l"), F.col("source").alias("s"), *own.columns[2:]), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    joined = joined.join(mid.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left").join(top, "all", "left")
    return written(joined.select("lang", "source", *[F.least(*[F.col(f"{m}_{k}") for k in range(3)]).alias(f"max_{m}") for m in SHARES]), "fences")


def judge(measured: DataFrame, table: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Append ``base_failed`` and ``kept``: false if the base rules fail or a share lies above its fence."""
    measured = measured.drop("base_failed", "kept")
    q = _fresh(measured)
    table = table.select(*[F.col(c).alias(f"{q}{c}") for c in table.columns])
    joined = measured.join(table, F.col(f"`{lang}`").eqNullSafe(F.col(f"{q}lang")) & F.col(f"`{source}`").eqNullSafe(F.col(f"{q}source")), "left")
    over = F.lit(False)
    for m in SHARES:
        over = over | F.coalesce(bucket(m) > F.col(f"{q}max_{m}"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~over}).drop(*table.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = written(measure(docs).drop("text"), "measured")
    out = judge(measured, adaptive_fences(measured))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, text FROM d),
g AS (SELECT k, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram, i FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT d.k, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN ln USING (k)),
s AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_share FROM m),
v AS (SELECT k, lang, source, base_failed, unnest(['symbol_share', 'dup_line_share', 'repeat_share']) AS metric, unnest([symbol_share, dup_line_share, repeat_share]) + {NEAR_ZERO} AS v FROM s),
b AS (SELECT *, {1 << (BUCKET_BITS - 1)} * greatest(length(bin(v)) - {BUCKET_BITS}, 0) + (v >> greatest(length(bin(v)) - {BUCKET_BITS}, 0))::BIGINT AS x FROM v),
h AS (SELECT grp, metric, x, count(*) AS n FROM (
  SELECT to_json([0::VARCHAR, lang, source])::VARCHAR AS grp, * FROM b UNION ALL SELECT to_json([1::VARCHAR, lang])::VARCHAR, * FROM b UNION ALL SELECT '2', * FROM b) WHERE NOT base_failed GROUP BY grp, metric, x),
c AS (SELECT grp, metric, x, (sum(n) OVER a)::DOUBLE AS an, (sum(n * x) OVER a)::DOUBLE AS ax, (sum(n) OVER u)::DOUBLE AS ln, (sum(n * x) OVER u)::DOUBLE AS lx FROM h
  WINDOW a AS (PARTITION BY grp, metric), u AS (PARTITION BY grp, metric ORDER BY x)),
e AS (SELECT *, an - ln AS hn, lx / ln AS low, (ax - lx) / (an - ln) AS high FROM c WHERE ln < an),
f AS (SELECT grp, metric, (low + high) / 2 AS fence FROM (SELECT *, row_number() OVER (PARTITION BY grp, metric ORDER BY (high - low) * (high - low) * ln * hn DESC, x) AS r FROM e)
  WHERE r = 1 AND high - low >= {APART} AND hn * {MOST_RARE} >= an AND an >= {LEAST_TEXTS}),
j AS (SELECT b.k, bool_or(x > least(f0.fence, f1.fence, f2.fence)) AS over FROM b LEFT JOIN f f0 ON f0.metric = b.metric AND f0.grp = to_json([0::VARCHAR, lang, source])::VARCHAR
  LEFT JOIN f f1 ON f1.metric = b.metric AND f1.grp = to_json([1::VARCHAR, lang])::VARCHAR LEFT JOIN f f2 ON f2.metric = b.metric AND f2.grp = '2' GROUP BY b.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over, false) AS kept
FROM s JOIN j USING (k)
"""
