"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each text is reduced to five statistics, transformed so that ordinary texts are roughly normal:

==  =========================================  ==========
x1  ln of the mean word length                 floor 0.02
x2  ln(1 + 10 * symbols a word)                floor 0.05
x3  lines equal to an earlier one, of n + 3    floor 0.05
x4  words in repeated 3-word windows, of n+50  floor 0.05
x5  ln(1 + 100 * share of capitals)            floor 0.05
==  =========================================  ==========

For every (language, source), every language and the whole corpus the minimum-covariance-determinant
location and scatter are estimated: from two deterministic starts (coordinate-wise median and
mean absolute deviation; plain moments) C-steps are made - keep the SUBSET share of rows with the smallest
Mahalanobis distance, take their moments again - and the start that ends with the smaller determinant wins.
The floors are added to the scatter, as some statistics are constant in clean text. A text is judged
by its (language, source) if that has LEAST eligible texts, else by its language, else by the corpus; where
none has so many, only the base rules decide. It is rejected beyond CUTOFF, the 0.9999 quantile of chi-squared with five
degrees, after distances are scaled by their median. That never makes them larger: where some statistics are constant, the
median is small because fewer than five degrees vary. Where clean texts have next to no repeats, x3 or x4 alone
rejects from 0.26 on.

Shares of few words or lines are uncertain: a single repeated line of three says little. So x3 and x4 count FEW_LINES and
FEW_WORDS more than there are, and a text's distance is taken n / (n + FEW_WORDS) times, as if its deviation were drawn towards the
centre by so many ordinary words.

Scale: statistics are whole numbers (thousandths), so sums are exact and results repeat; every
estimate is a partial aggregation over (group, start) - a hot source costs no more than others - and the
distance cut is read from a histogram of at most ~2,000 bins a group, not from sorted rows. Texts are
read once; later steps read the written statistics.

Defined cases: null and blank texts have no words and fail the base rules; null languages and sources form groups
of their own; repeated ids are judged row by row; an empty table gives an empty result; other columns are kept by
``accepted`` and not read by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.llm.common import BLANKS, SPLIT, saved

P = 5
FLOORS = (20, 50, 50, 50, 50)  # thousandths
SUBSET = 0.75
#: C-steps go on until no log determinant moves by more than SETTLED; each can only lower it but for the histogram's bins.
MOST_STEPS, SETTLED = 6, 0.05
LEAST = 60
#: The 0.9999 quantile of chi-squared with five degrees.
CUTOFF = 25.745
MEDIAN_CHI2 = 4.351
LEAST_WORDS, MOST_REPEATED = 50, 50
FEW_WORDS, FEW_LINES = 50, 3


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes value once and uses it by name in body."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_WORDS = f"if(btrim(t, {BLANKS}) = '', cast(array() as array<string>), split(btrim(t, {BLANKS}), {SPLIT}))"
_LINES = f"filter(split(t, '\\n'), l -> btrim(l, {BLANKS}) <> '')"
_REPEATED = "if(size(w) < 3, 0L, " + _let(
    "g",
    "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as i)))",
    _let(
        "p",
        "sort_array(transform(filter(g, (x, j) -> x.h = get(g, j - 1).h or x.h = get(g, j + 1).h), x -> x.i))",
        "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, b) -> a + b)",
    ),
) + ")"
_STATS = _let(
    "w",
    _WORDS,
    "struct(cast(size(w) as long) as n_words, cast(length(array_join(w, '')) as long) as word_chars, "
    + _REPEATED
    + " as n_repeat_words)",
)


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines, _capitals (all long)."""
    text = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    expr = lambda sql: F.expr(sql.replace("split(t,", "split(_t,").replace("btrim(t,", "btrim(_t,"))
    out = text.withColumn("_s", expr(_STATS)).withColumn("_l", expr(_let("q", _LINES, "struct(cast(size(q) as long) as n, cast(size(q) - size(array_distinct(q)) as long) as d)")))
    return out.select(
        *docs.columns,
        F.col("_s.n_words").alias("n_words"),
        F.col("_s.word_chars").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_s.n_repeat_words").alias("n_repeat_words"),
        F.col("_l.n").alias("_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("_capitals"),
    )


def _key(*names: str):
    """One string of nullable columns, distinct for distinct values."""
    return F.concat_ws("\u0001", *[F.when(F.col(n).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(n).cast("string"))) for n in names])


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / (F.col("_lines") + FEW_LINES),
        F.col("n_repeat_words") / (n + FEW_WORDS),
        F.log1p(100 * F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1))),
    )
    return stats.select("*", *[F.round(1000 * v).cast("long").alias(f"x{i}") for i, v in enumerate(x, 1)])


def _moments() -> list:
    xs = [F.sum(f"x{i}").alias(f"s{i}") for i in range(1, P + 1)]
    return [F.count("*").alias("n"), *xs, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(1, P + 1) for j in range(1, i + 1)]]


def _whitened(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m1.., w11.. (the inverse Cholesky factor), logdet of rows with m1.. and c11.. (floors not yet added)."""
    out = rows
    for i, floor in enumerate(FLOORS, 1):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + float(floor * floor))
    for i in range(1, P + 1):
        for j in range(1, i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(1, j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(1, P + 1):
        out = out.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(1, i):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    det = sum((F.log(f"l{i}{i}") for i in range(2, P + 1)), F.log("l11"))
    w = [f"w{i}{j}" for i in range(1, P + 1) for j in range(1, i + 1)]
    return out.select(*keys, *[f"m{i}" for i in range(1, P + 1)], *w, det.alias("logdet"))


def _distance():
    total = F.lit(0.0)
    for i in range(1, P + 1):
        z = F.lit(0.0)
        for j in range(1, i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + z * z
    return total


def _from_moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    out = sums.select("*", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(1, P + 1)])
    out = out.select("*", *[(F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in range(1, P + 1) for j in range(1, i + 1)])
    return _whitened(out, keys)


_BIN = "cast(floor(32 * log1p(d2)) as int)"


def _cut(rows: DataFrame, share: float, name: str) -> DataFrame:
    """(grp, start, name): the first histogram bin of d2 up to which at least that share of the rows lies."""
    # summed by bin first: window and aggregation together would send every task's bins of a group to one task
    bins = rows.groupBy("grp", "start", F.expr(_BIN).alias("bin")).agg(F.count("*").alias("k"))
    bins = saved(bins, "bins")
    w = Window.partitionBy("grp", "start").orderBy("bin")
    up = bins.select("grp", "start", "bin", F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy("grp", "start")).alias("all"))
    return up.where(F.col("upto") >= F.lit(share) * F.col("all")).groupBy("grp", "start").agg(F.min("bin").alias(name))


#: The groups up to which their few numbers are broadcast.
FEW_GROUPS = 20_000


def _with_groups(spread: DataFrame, per: DataFrame) -> DataFrame:
    """spread with the columns of per (at most a few rows a group): broadcast if there are few groups, else joined by group and a share of it, so that no group's rows are all in one task."""
    if per.count() <= FEW_GROUPS:
        return spread.join(F.broadcast(per), "grp")
    shares = per.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(15)))).hint("merge")
    return spread.withColumn("share", F.pmod(F.xxhash64(*[f"x{i}" for i in range(1, P + 1)]), F.lit(16)).cast("int")).join(shares, ["grp", "share"]).drop("share")


def estimates(vectors: DataFrame) -> DataFrame:
    """The chosen location and whitening of each group with LEAST rows: grp, m.., w.., scale."""
    spread = vectors.where("not base_failed").select(F.explode(F.array("_cell", "_lang", F.lit("a"))).alias("grp"), *[f"x{i}" for i in range(1, P + 1)])
    plain = spread.groupBy("grp").agg(*_moments(), *[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"med{i}") for i in range(1, P + 1)]).where(F.col("n") >= LEAST)
    plain = saved(plain, "moments")
    a = _from_moments(plain, ["grp"]).withColumn("start", F.lit(0))
    mad = _with_groups(spread, plain.select("grp", *[f"med{i}" for i in range(1, P + 1)])).groupBy("grp").agg(
        *[F.min(f"med{i}").cast("double").alias(f"m{i}") for i in range(1, P + 1)],
        *[F.pow(F.avg(F.least(F.abs(F.col(f"x{i}") - F.col(f"med{i}")), F.lit(5 * FLOORS[i - 1]))), F.lit(2)).alias(f"c{i}{i}") for i in range(1, P + 1)],
    )
    for i in range(1, P + 1):
        for j in range(1, i):
            mad = mad.withColumn(f"c{i}{j}", F.lit(0.0))
    b = _whitened(mad, ["grp"]).withColumn("start", F.lit(1))
    now = saved(a.unionByName(b), "start")
    for _ in range(MOST_STEPS):
        before = now.select("grp", "start", F.col("logdet").alias("was"))
        near = _with_groups(spread, now).withColumn("d2", _distance())
        cut = _cut(near, SUBSET, "most")
        kept = near.join(F.broadcast(cut) if now.count() <= FEW_GROUPS else cut, ["grp", "start"]).where(F.expr(_BIN) <= F.col("most"))
        now = saved(_from_moments(kept.groupBy("grp", "start").agg(*_moments()), ["grp", "start"]), "step")
        moved = now.join(before, ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < SETTLED:
            break
    best = now.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    final = now.join(best, ["grp", "start"])
    final = saved(final, "final")
    middle = _cut(_with_groups(spread, final).withColumn("d2", _distance()), 0.5, "middle")
    return saved(final.join(middle, ["grp", "start"]).withColumn("scale", F.greatest(F.lit(1.0), F.expm1((F.col("middle") + 1) / 32) / MEDIAN_CHI2)).drop("logdet", "start", "middle"), "estimates")


def _tag():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _cell():
    return F.concat(F.lit("c"), _key("lang", "source"))


def _judged(docs: DataFrame, tag: bool = False) -> DataFrame:
    stats = statistics(docs.select("doc_id", "text", "lang", "source"))
    stats = (stats.withColumn("_tag", _tag()) if tag else stats).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = _vectors(stats.withColumn("base_failed", failed)).withColumn("_lang", F.concat(F.lit("l"), _key("lang"))).withColumn("_cell", _cell())
    rows = saved(rows.drop("lang", "source"), "statistics")
    found = estimates(rows)
    named = lambda k: found.select(F.col("grp").alias(k), F.struct(*[c for c in found.columns if c != "grp"]).alias(f"e{k}"))
    whole = found.where("grp = 'a'").select(F.struct(*[c for c in found.columns if c != "grp"]).alias("ea"), F.lit("a").alias("_a"))
    out = rows.withColumn("_a", F.lit("a")).join(named("_cell"), "_cell", "left").join(named("_lang"), "_lang", "left").join(whole, "_a", "left")
    out = out.withColumn("e", F.coalesce("e_cell", "e_lang", "ea")).select(*rows.columns, "e.*")
    out = out.withColumn("distance", _distance() / F.col("scale") * F.col("n_words") / (F.col("n_words") + FEW_WORDS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF)))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row."""
    return _judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, columns as before.

    A verdict depends on text, language and source only, so rows get theirs by these (and by id, which spreads copies).
    """
    keep = _judged(docs, tag=True).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("_tag").alias("_kept_tag"), F.col("_cell").alias("_kept_cell"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (_tag() == F.col("_kept_tag")) & (_cell() == F.col("_kept_cell"))
    return docs.join(keep, same, "left_semi")
