"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations; DataFrame functions only.

1. Each source's share ``p`` of all tokens (words between white space).
2. Weights ``p**a`` normalised. The exponent ``a`` is bisected so that the weights reach a target
   entropy, or that no source is repeated more than ``max_epochs`` times. 1 keeps the shares, 0 makes sources equal.
3. The budget of tokens is, unless given, the one at which every source is read whole at least once,
   so mixing repeats documents of small sources and loses none.
4. A source's stream is its documents in a hash permutation for each epoch, until its part of the
   budget is met (the document that crosses the line is still taken). Blocks of ``block_tokens`` cut all streams
   in proportion to the weights, so that each block has the target mix; inside a block all are permuted by hash.

Prefix sums run in two levels (source, epoch and hash slice; then inside a slice), so a source with a
third of all rows is spread over ``SLICES`` groups. No table of sources or offsets is broadcast.

Defined cases: a null source is a source of its own; null, empty and blank texts have 0 tokens and ride along
in the first epoch; a very long text counts with all its tokens, and crosses the budget's line whole; rows of equal hash follow by id and content; repeated rows are told apart by content and stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalguard.llm.common import materialise, small

MAX_EPOCHS, BLOCK_TOKENS = 1.5, 1_000_000
SLICES = 256
STEPS = 60
SEED = "mix"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def bisect(accepts, low: float = 0.0, high: float = 1.0, steps: int = STEPS) -> float:
    """The least exponent in [low, high] that ``accepts`` holds for; it must hold from some point on."""
    if accepts(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if accepts(mid) else (mid, high)
    return high


def exponent_for_repetition(sources: DataFrame, max_epochs: float) -> float:
    """Least exponent at which the most repeated source is read ``max_epochs`` times, when the least repeated is read once.

    Repetitions go as p**(a-1), so the smallest and the largest share decide.
    """
    r = sources.where("tokens > 0").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if r["least"] is None:
        return 1.0
    ratio = r["most"] / r["least"]
    return bisect(lambda a: ratio ** (1 - a) <= max_epochs)


def exponent_for_entropy(sources: DataFrame, target: float) -> float:
    """Greatest exponent in [0, 1] whose weights have at least ``target`` nats; one aggregate a step, of which one row returns."""
    some = sources.where("tokens > 0")
    top = some.agg(F.max("tokens")).first()[0]

    def entropy(a: float) -> float:
        z = F.log(F.col("tokens") / F.lit(float(top))) * F.lit(a)
        r = some.agg(F.sum(F.exp(z)).alias("s"), F.sum(z * F.exp(z)).alias("t")).first()
        return math.log(r["s"]) - r["t"] / r["s"]

    if top is None or entropy(1.0) >= target:
        return 1.0
    return 1.0 - bisect(lambda b: entropy(1.0 - b) >= target, steps=40)


def weigh(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """(key, tokens, weight, quota): quota is the source's part of the budget, in tokens."""
    some = sources.where("tokens > 0")
    r = some.agg(F.sum(F.pow("tokens", F.lit(exponent))).alias("s"), F.max(F.col("tokens") / F.pow("tokens", F.lit(exponent))).alias("m")).first()
    total = r["s"] or 1.0
    whole = (r["m"] or 0.0) * total if budget is None else budget
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent)) / F.lit(total)).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("quota", F.greatest(F.round(F.col("weight") * F.lit(whole), 6), F.lit(0.0)))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def schedule(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, slices: int = SLICES) -> DataFrame:
    """(doc_id, th, source, n_tokens, epoch, block, order_key) of each planned reading, and its source's weight.

    ``order_key`` permutes a block; th tells rows of one id apart; copy numbers identical rows.
    """
    text = F.col("text").cast("string")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8).alias("content"), key.alias("key"), n_tokens(text).alias("n_tokens")), "mix-rows")
    sources = materialise(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    exponent = exponent_for_entropy(sources, entropy) if entropy is not None else exponent_for_repetition(sources, max_epochs)
    weights = materialise(weigh(sources, exponent, budget), "mix-weights")
    planned = rows.join(weights, "key").withColumn("passes", F.greatest(F.lit(1), F.ceil(F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(1.0) - F.lit(1e-9))).cast("int"))
    epochs = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    name = F.concat_ws("/", F.lit(SEED), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("content"))
    shuffled = epochs.withColumn("h", _hash(name)).withColumn("slice", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(slices)).cast("int"))
    sums = materialise(shuffled.groupBy("key", "epoch", "slice").agg(F.sum("n_tokens").alias("part"), F.first("tokens").alias("all")), "mix-slices")
    # epochs are whole passes, so an epoch begins at epoch x tokens; only slices need summing
    before = F.coalesce(F.sum("part").over(Window.partitionBy("key", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("key", "epoch", "slice", (F.col("epoch") * F.col("all") + before).alias("before"))
    inside = Window.partitionBy("key", "epoch", "slice").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    stream = shuffled.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["key", "epoch", "slice"]).withColumn("at", F.col("before") + F.col("inside"))
    first = F.col("epoch") == 0
    taken = stream.where(F.when(F.col("n_tokens") == 0, first).otherwise(F.col("at") < F.col("quota")))
    block = F.when(F.col("weight") > 0, F.floor(F.col("at") / (F.col("weight") * F.lit(float(block_tokens))))).otherwise(0).cast("long")
    return taken.withColumn("block", block).select(
        "doc_id", "th", F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source"), "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block",
        _hash(F.col("block"), F.col("h")).alias("order_key"), F.col("at").cast("long").alias("stream_at"), F.round("weight", 9).alias("weight"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as planned; all columns stay. Readings of a document are copies of its row."""
    plan = schedule(docs, **options).groupBy("doc_id", "th").agg((F.max("epoch") + 1).alias("times"))
    whole = options.get("budget") is None  # then every document is read, and only repeated ones need a row
    plan = materialise(plan.where("times > 1") if whole else plan, "mix-plan")
    p = small(plan)
    same = docs["doc_id"].cast("long").eqNullSafe(p["doc_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(p["th"])
    joined = docs.join(p, same, "left" if whole else "inner")
    copies = F.array_repeat(F.struct(*(docs[c] for c in docs.columns)), F.coalesce(p["times"], F.lit(1)))
    return joined.select(F.explode(copies).alias("row")).select("row.*")


ORACLE_SQL = f"""
with rows_ as (
  select doc_id, source, case when source is null then 'n' else 's' || source end as key, substr(md5(coalesce(text, '')), 1, 8) as content,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as n_tokens from documents),
sources as (select key, cast(sum(n_tokens) as double) as tokens from rows_ group by key),
a as (select case when max(tokens) / min(tokens) <= {MAX_EPOCHS} then 0.0 else 1 - ln({MAX_EPOCHS}) / ln(max(tokens) / min(tokens)) end as a from sources where tokens > 0),
s as (select sum(pow(tokens, a)) as s, max(tokens / pow(tokens, a)) as m from sources, a where tokens > 0),
weights as (
  select key, tokens, case when tokens > 0 then pow(tokens, a) / s else 0 end as weight,
    round(case when tokens > 0 then pow(tokens, a) * m else 0 end, 6) as quota from sources, a, s),
epochs as (
  select r.*, w.tokens, w.weight, w.quota, unnest(generate_series(0, greatest(1, cast(ceil(case when w.tokens > 0 then w.quota / w.tokens else 1 end - 1e-9) as bigint)) - 1)) as epoch
  from rows_ r join weights w using (key)),
hashed as (select *, md5('{SEED}/' || epoch || '/' || coalesce(cast(doc_id as varchar), 'null') || '/' || content) as h from epochs),
stream as (
  select *, epoch * tokens + coalesce(sum(n_tokens) over (
    partition by key, epoch order by cast('0x' || substr(h, 1, 8) as bigint) % {SLICES}, h, doc_id rows between unbounded preceding and 1 preceding), 0) as pos from hashed)
select doc_id, source, n_tokens, cast(epoch as integer) as epoch,
  cast(case when weight > 0 then floor(pos / (weight * {float(BLOCK_TOKENS)})) else 0 end as bigint) as block,
  md5(cast(cast(case when weight > 0 then floor(pos / (weight * {float(BLOCK_TOKENS)})) else 0 end as bigint) as varchar) || ':' || h) as order_key,
  cast(pos as bigint) as stream_at, round(weight, 9) as weight
from stream where case when n_tokens = 0 then epoch = 0 else pos < quota end"""
