"""Mixing sources to target weights, in DataFrame operations only.

The words of each source are packed into blocks of BLOCK words (documents in a fixed pseudorandom order,
one after the other; the last block of a source may be short). A source's target is its share of the mix by
weight, but at most LIMIT times its words; what it can't give is shared anew by weight. The words
it gives are whole passes over its blocks, then a part of one more pass: within a pass, slot k takes block
``(a * k + b) mod m`` (a prime multiplier and an offset by hash of source and pass, so a permutation;
a short last block comes last), and the last slot is cut to what is still missing. So a source's words are
its target to within a word, no block is taken twice within a pass, and no document exceeds LIMIT times its size.

Every shard has SHARD_SLOTS slots (the last one fewer). The source counts of a shard are a multinomial draw: each slot
draws its source by the sources' shares. The i-th slot that drew a source, over all shards in order, is the
source's slot i. Over the whole mix a source is drawn a little too often or too seldom; slots drawn beyond its quota
go, in order, to the sources that lack some. Blocks are joined to slots by (source, block).

Scale: ids, sizes and hashes are shuffled. Positions within a source are prefix sums in two steps, over
buckets of a source (one for BUCKET_ROWS rows, BUCKETS at least) and within each, so that a hot source is never in one task; the numbers of slots
before a shard likewise, over groups of shards. The rows over which a window has no partition are one a source.

Defined cases: null text has size 0; null sources are one source, last in order; repeated and null ids are
separate documents, told apart by a hash of all their columns; an empty table gives an empty result; a source without words has
target 0; other columns are not read by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.llm.common import BLANKS, SPLIT, joined_spread, saved

BLOCK = 512
SHARD_SLOTS = 1024
BUCKETS, BUCKET_ROWS = 1024, 200_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: The sources up to which their few numbers are broadcast.
FEW_SOURCES = 10_000
#: The largest primes below 2**27: each that doesn't divide a number of blocks (below 2**36) is a multiplier of a permutation, without overflow.
PRIMES = (134217689, 134217649, 134217617, 134217613, 134217593, 134217541, 134217529, 134217509)


def words_of(text: str) -> str:
    """SQL for the array of words of a text column."""
    return f"if(btrim(coalesce({text}, ''), {BLANKS}) = '', cast(array() as array<string>), split(btrim({text}, {BLANKS}), {SPLIT}))"


def _source_key(source: str):
    """Distinct for distinct sources, null last in order."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(skey, source_size, target, wanted) by weights in order of the sources; sizes: (skey, size)."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy("skey")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int")))
    per = per.withColumn("most", (limit * F.col("source_size")).cast("long")).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("before", F.coalesce(F.sum("most").over(up), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(up), F.lit(0)))
    per = per.withColumn("all", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    # the level a unit of weight gets if just the sources before this one are at their limit
    per = per.withColumn("level", (share * F.col("all") - F.col("before")) / (F.col("weights") - F.col("used")))
    per = per.withColumn("free", F.col("level") <= F.col("ratio"))
    per = per.withColumn("final", F.min(F.when(F.col("free"), F.struct("ratio", "skey", "level"))).over(whole).getField("level"))
    first = F.min(F.when(F.col("free"), F.struct("ratio", "skey"))).over(whole)
    at = F.struct("ratio", "skey") < first
    per = per.withColumn("capped", F.coalesce(at, F.lit(True)))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select("skey", "source_size", target.alias("target")).withColumn("wanted", F.least(F.round("target").cast("long"), limit * F.col("source_size")))


def _by_source(rows: DataFrame, per: DataFrame, n: int) -> DataFrame:
    """rows with per's columns (one row a source): broadcast if there are few sources, else joined with hot ones apart."""
    return rows.join(F.broadcast(per), "skey") if per.count() <= FEW_SOURCES else joined_spread(rows, per, "skey", n)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with start: the number of words of the source before this row in the source's pseudorandom order."""
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("part"))
    sums = sums.withColumn("base", F.sum("part").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("part")).drop("part")
    inner = Window.partitionBy("skey", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("size").over(inner)).join(sums, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("upto", "base", "bucket")


def quotas(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(skey, source_size, wanted, per, quota): slots of one pass over a source and in all."""
    per = F.ceil(F.col("source_size") / block)
    rest = F.col("wanted") % F.col("source_size")
    return goal.where("wanted > 0").select("skey", "source_size", "wanted", per.alias("per"), (F.floor(F.col("wanted") / F.col("source_size")) * per + F.ceil(rest / block)).alias("quota"))


def draws(quota: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, skey): the source each slot of each shard draws, by the sources' quotas."""
    every = quota.agg(F.sort_array(F.collect_list(F.struct("skey", "quota"))).alias("all"), F.sum("quota").alias("slots"))
    every = every.withColumn("ends", F.expr("transform(all, (x, i) -> aggregate(slice(all, 1, i + 1), 0L, (a, y) -> a + y.quota))"))
    # in steps, so that one task doesn't write all shards
    shards = every.where("slots > 0").withColumn("step", F.explode(F.expr(f"sequence(0L, (slots - 1) div {shard_slots * 256})"))).repartition("step")
    shards = shards.withColumn("shard", F.explode(F.expr(f"sequence(step * 256, least(step * 256 + 255, (slots - 1) div {shard_slots}))")))
    # a number below the sum of quotas, and the first source whose running sum exceeds it
    drawn = f"transform(sequence(0L, least({shard_slots}L, slots - shard * {shard_slots}) - 1), i -> get(all, size(filter(ends, e -> e <= pmod(xxhash64(shard, i, 'draw'), slots)))).skey)"
    return shards.select("shard", F.posexplode(F.expr(drawn)).alias("slot", "skey"))


def _numbered(drawn: DataFrame, quota: DataFrame, n: int) -> DataFrame:
    """(shard, slot, skey, k): the source's slot that each slot of the mix stands for, after what is drawn too often went to what lacks."""
    counts = drawn.groupBy("skey", "shard").agg(F.count("*").alias("c")).withColumn("bunch", F.expr("shard div 1024"))
    bunches = counts.groupBy("skey", "bunch").agg(F.sum("c").alias("part"))
    bunches = bunches.withColumn("base", F.sum("part").over(Window.partitionBy("skey").orderBy("bunch")) - F.col("part")).drop("part")
    upto = F.sum("c").over(Window.partitionBy("skey", "bunch").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = counts.withColumn("upto", upto).join(bunches, ["skey", "bunch"]).select("skey", "shard", (F.col("base") + F.col("upto") - F.col("c")).alias("before"))
    up = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    per = quota.join(counts.groupBy("skey").agg(F.sum("c").alias("got")), "skey", "left").select("skey", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    per = per.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("lack", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    per = saved(per.withColumn("overs", F.coalesce(F.sum("over").over(up), F.lit(0))).withColumn("lacks", F.coalesce(F.sum("lack").over(up), F.lit(0))), "drawn")
    place = F.row_number().over(Window.partitionBy("skey", "shard").orderBy("slot")) - 1
    # neither side is to be broadcast, however small it seems: both grow with the input
    rows = drawn.withColumn("r", place).join(before.hint("merge"), ["skey", "shard"]).select("shard", "slot", "skey", (F.col("before") + F.col("r")).alias("k"))
    rows = _by_source(rows, per.select("skey", "quota", "overs"), n)
    fine = rows.where("k < quota").select("shard", "slot", "skey", "k")
    # the surplus is of the order of the root of all slots; one row has all sources that lack some
    lack = per.where("lack > 0").agg(F.collect_list(F.struct("skey", "got", "lack", "lacks")).alias("lacking")).withColumn("one", F.lit(1))
    extra = rows.where("k >= quota").select("shard", "slot", (F.col("overs") + F.col("k") - F.col("quota")).alias("j"), F.lit(1).alias("one"))
    extra = extra.join(F.broadcast(lack), "one").withColumn("to", F.expr("get(filter(lacking, x -> x.lacks <= j and j < x.lacks + x.lack), 0)"))
    return fine.unionByName(extra.select("shard", "slot", F.col("to.skey").alias("skey"), (F.col("to.got") + F.col("j") - F.col("to.lacks")).alias("k")))


def slots(goal: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, skey, pass, block, words) of every slot of the mix; goal: (skey, source_size, wanted)."""
    quota = saved(quotas(goal, block), "quotas")
    drawn = saved(draws(quota, shard_slots), "draws")
    n = drawn.count()
    rows = _by_source(_numbered(drawn, quota, n), quota, n)
    rows = rows.withColumn("pass", F.expr("k div per")).withColumn("k", F.expr("k % per")).withColumn("full", F.expr(f"source_size div {block}"))
    rows = rows.withColumn("need", F.least(F.col("source_size"), F.col("wanted") - F.col("pass") * F.col("source_size")))
    primes = ", ".join(f"{p}L" for p in PRIMES)
    prime = _let_sql("p", f"filter(array({primes}), x -> full % x <> 0)", "get(p, cast(pmod(xxhash64(skey, pass, 1), size(p)) as int))")
    moved = F.expr(f"if(k < full, ({prime} * k + pmod(xxhash64(skey, pass, 2), greatest(full, 1L))) % greatest(full, 1L), k)")
    return rows.select("shard", "slot", "skey", "pass", moved.alias("block"), F.least(F.lit(block), F.col("need") - F.col("k") * block).alias("words"))


def _let_sql(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _pieces(placed: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """placed's rows with words, one for each block they lie in and pass that takes it: lo, hi, taken (a part's words within the document)."""
    spread = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    # the planner takes the exploded slots for few rows, but they grow with the input: not to be broadcast
    both = spread.join(drawn.hint("merge"), ["skey", "block"], "left")
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    return both.withColumn("lo", lo - F.col("start")).withColumn("taken", F.greatest(hi - lo, F.lit(0)))


def _sized(docs: DataFrame) -> DataFrame:
    """All columns of docs as d_<name>, then doc_id, skey, size and h, a hash of all columns."""
    rows = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    return rows.select(
        "*", F.col("d_doc_id").alias("doc_id"), _source_key("d_source").alias("skey"), F.expr(f"cast(size({words_of('d_text')}) as long)").alias("size"), F.xxhash64(*rows.columns).alias("h")
    )


def plan(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) of every row of docs (doc_id, text, source).

    first_shard: the first output shard that takes words of the document (null: none does).
    """
    rows = saved(_sized(docs).select("doc_id", "skey", "size", "h"), "sizes")
    goal = saved(targets(rows, weights, share, limit), "targets")
    parts = _pieces(_placed(rows), slots(goal, block), block).groupBy("skey", "start", "doc_id", "size").agg(F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("shard"))).alias("first_shard"))
    out = parts.select("skey", "doc_id", "size", "taken", "first_shard").unionByName(rows.where("size = 0").select("skey", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard")))
    return _by_source(out, goal, rows.count()).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_shard")


def mixed(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The mix as documents, columns as before: for each pass that takes words of a document, a row with the taken text.

    Where all words are taken the text is as it was, else the taken words joined by blanks; n_chars follows.
    """
    keyed = _sized(docs)
    rows = saved(keyed.select("doc_id", "skey", "size", "h"), "sizes")
    goal = saved(targets(rows, weights, share, limit), "targets")
    parts = _pieces(_placed(rows), slots(goal, block), block).where("taken > 0")
    parts = parts.groupBy("skey", "start", "doc_id", "size", "h", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "taken"))).alias("ranges"), F.sum("taken").alias("taken"))
    # wholly equal rows: one stands for all, whose parts each stay; window and join have the same keys, so that texts are shuffled once
    keys = ["k0", "k1", "k2", "k3", "k4"]
    own = [F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("skey").alias("k2"), F.col("size").alias("k3"), F.col("h").alias("k4")]
    texts = keyed.select(*[f"d_{c}" for c in docs.columns], *own)
    texts = texts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("k4"))).where("_n = 1").drop("_n")
    parts = parts.select(*own, "size", "ranges", "taken")
    both = texts.join(parts.hint("merge"), keys)
    cut = F.expr(f"get(transform(array({words_of('d_text')}), w -> array_join(flatten(transform(ranges, r -> slice(w, cast(r.lo + 1 as int), cast(r.taken as int)))), ' ')), 0)")
    text = F.when(F.col("taken") == F.col("size"), F.col("d_text")).otherwise(cut)
    both = both.withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return both.select(*[made.get(c, F.col(f"d_{c}")).alias(c) for c in docs.columns])
