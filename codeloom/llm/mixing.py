"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of tokens to the power alpha, normalised. alpha lies between 0 (all sources
alike) and 1 (natural shares) and is found by bisection: the largest whose weights reach the target
entropy, but no smaller than the repetition limit allows. A source then gives weight x budget tokens: whole
epochs, and of the last epoch a prefix of its blocks in the order of a hash of (seed, epoch, block), then of
the last block's documents in the order of a hash, up to what is left. The first document that doesn't fit
ends the source, as the SQL has it, so a source falls short of its quota by less than that document's tokens,
however few blocks it has; no later document fills the room. Blocks are summed by the head of their
hash first, so a source of any size needs 4096 sums in one place, the blocks of one head, and only its last
block's documents in order.

DataFrame and SQL functions only. What meets in one row are the totals by source, one number each.

Defined results: a null source counts as the empty one, '', as in the SQL; null and empty texts and others
without words weigh nothing and aren't drawn; repeated rows are drawn as often as they are there; nulls in the
id are drawn like any other value, all at one place in the order; documents of one id are in the order of
their tokens, then of the carried columns; a very long document counts whole, and what is longer than the room
left ends its source; an empty table gives an empty result. With the target out of reach alpha is 0 or 1.
Only the named columns are read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import saved, table

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts):
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def weights(totals: DataFrame, target_entropy: float, max_repeats: float, budget_share: float) -> DataFrame:
    """(source, total, alpha, weight, quota) from (source, total). target_entropy: a share of the greatest."""
    one = totals.agg(F.collect_list("total").alias("t"), F.sum("total").cast("double").alias("z"))
    one = one.select("z", F.expr("array_sort(transform(t, x -> x / z))").alias("p"))
    z, h = "aggregate(p, 0D, (s, x) -> s + power(x, {a}))", "aggregate(p, 0D, (s, x) -> s + power(x, {a}) * ln(x))"
    entropy = f"(ln({z}) - {{a}} * {h} / {z})"
    half = "(b.lo + b.hi) / 2"
    # the largest alpha with entropy enough, and the smallest within the limit: the smallest source repeats most
    reach = entropy.format(a=half) + f" >= {float(target_entropy)}D * ln(size(p))"
    repeat = f"power(p[0], {half}) / {z.format(a=half)} * {float(budget_share)}D / p[0] <= {float(max_repeats)}D"
    search = "aggregate(sequence(1, 60), named_struct('lo', 0D, 'hi', 1D), (b, i) -> if({t}, named_struct('lo', {y}), named_struct('lo', {n})))"
    up = search.format(t=reach, y=f"{half}, 'hi', b.hi", n=f"b.lo, 'hi', {half}")
    down = search.format(t=repeat, y=f"b.lo, 'hi', {half}", n=f"{half}, 'hi', b.hi")
    natural = entropy.format(a="1D") + f" >= {float(target_entropy)}D * ln(size(p))"
    even = f"1D / size(p) * {float(budget_share)}D / p[0] <= {float(max_repeats)}D"
    one = one.where("z > 0").select("z", "p", F.expr(f"if({natural}, 1D, {up}.lo)").alias("reach"), F.expr(f"if({even}, 0D, {down}.hi)").alias("limit"))
    one = one.select("z", "p", F.round(F.greatest("reach", "limit"), 9).alias("alpha"))
    one = one.select("z", "alpha", F.expr("aggregate(p, 0D, (s, x) -> s + power(x, alpha))").alias("norm"))
    w = F.expr("power(total / z, alpha) / norm")
    got = totals.join(F.broadcast(one), F.lit(True))  # one row
    return got.select("source", "total", "alpha", w.alias("weight"), F.round(w * F.col("z") * float(budget_share)).cast("long").alias("quota"))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*carry, F.col(key).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))


def draws(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 50_000, seed: int = 17, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, block_order, doc_order): a row for each time a document is drawn.

    The mixture in order is the rows by (epoch, block_order, doc_order). carry: further columns of docs, which
    each draw has from its own row.
    """
    rows = saved(counted(docs, key, carry=carry).where("tokens > 0"), "counted")
    totals = saved(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "totals")
    plan = weights(totals, target_entropy, max_repeats, budget_share)
    plan = plan.select("source", F.floor(F.col("quota") / F.col("total")).cast("int").alias("whole"), (F.col("quota") % F.col("total")).alias("rest"), F.ceil(F.col("total") / block_tokens).cast("long").alias("n_blocks"))
    plan = saved(plan, "plan")
    place = F.conv(F.substring(_hash(F.col("doc_id"), F.lit(seed)), 1, 8), 16, 10).cast("long")
    dealt = rows.join(plan, "source").withColumn("block", F.pmod(place, F.col("n_blocks")))
    # of the last epoch: blocks in order, as far as the rest goes
    blocks = saved(dealt.where("rest > 0").groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("size")), "blocks")
    order = _hash(F.lit(seed), F.col("source"), F.col("whole"), F.col("block"))
    blocks = blocks.withColumn("block_order", order).withColumn("head", F.substring("block_order", 1, 3))
    # summed in two steps, so that no task holds all blocks of a source: over the 4096 heads, then within a head
    sums = lambda x, *by: F.coalesce(F.sum(x).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = blocks.groupBy("source", "head", "rest").agg(F.sum("size").alias("size"))
    heads = heads.withColumn("ahead", sums("size", "source", "head")).where("ahead < rest").select("source", "head", "ahead")
    blocks = blocks.join(heads, ["source", "head"]).withColumn("before", F.col("ahead") + sums("size", "source", "head", "block_order")).where("before < rest")
    blocks = saved(blocks.select("source", "block", (F.col("rest") - F.col("before")).alias("room"), (F.col("before") + F.col("size") <= F.col("rest")).alias("all_of_it")), "last")
    last = dealt.join(blocks, ["source", "block"])
    doc_order = _hash(F.lit(seed), F.col("whole"), F.col("doc_id"))
    one = Window.partitionBy("source", "block").orderBy(doc_order, "tokens", *carry).rowsBetween(Window.unboundedPreceding, 0)
    cut = last.where("not all_of_it").withColumn("upto", F.sum("tokens").over(one)).where("upto <= room").drop("upto")
    ends = last.where("all_of_it").unionByName(cut).withColumn("epoch", F.col("whole"))
    full = dealt.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    names = [*carry, "doc_id", "source", "tokens", "epoch", "block"]
    every = full.select(*names).union(ends.select(*names))
    return every.withColumns({"block_order": _hash(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")), "doc_order": _hash(F.lit(seed), F.col("epoch"), F.col("doc_id"))})


def op6_source_mixing(spark, sf_dir):
    return draws(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive counted as (
  select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens from documents
), totals as (
  select source, sum(tokens)::bigint as total from counted where tokens > 0 group by source
), z as (select sum(total)::double as z, count(*) as k from totals
), shares as (select total / z as p from totals, z
), search(i, lo, hi, lo2, hi2) as (
  select 0, 0::double, 1::double, 0::double, 1::double
  union all
  select i + 1, case when reach then (lo + hi) / 2 else lo end, case when reach then hi else (lo + hi) / 2 end,
         case when repeats then lo2 else (lo2 + hi2) / 2 end, case when repeats then (lo2 + hi2) / 2 else hi2 end
  from (
    select i, lo, hi, lo2, hi2,
      (select ln(sum(p ^ ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ^ ((lo + hi) / 2) * ln(p)) / sum(p ^ ((lo + hi) / 2)) from shares) >= 0.97 * (select ln(k) from z) as reach,
      (select min(p) ^ ((lo2 + hi2) / 2) / sum(p ^ ((lo2 + hi2) / 2)) / min(p) from shares) <= 4.0 as repeats
    from search where i < 60)
), found as (
  select greatest(
    case when (select -sum(p * ln(p)) from shares) >= 0.97 * (select ln(k) from z) then 1.0 else lo end,
    case when (select 1.0 / count(*) / min(p) from shares) <= 4.0 then 0.0 else hi2 end) as a
  from search where i = 60
), alpha as (select round(a, 9) as alpha from found
), plan as (
  select source, total, round((total / z) ^ alpha / (select sum(p ^ alpha) from shares) * z)::bigint as quota, ceil(total / 50000)::bigint as n_blocks
  from totals, z, alpha
), dealt as (
  select c.*, quota // total as whole, quota % total as rest,
         ('0x' || substr(md5(concat_ws('|', c.doc_id::varchar, '17')), 1, 8))::bigint % n_blocks as block
  from counted c join plan p on c.source = p.source where tokens > 0
), blocks as (
  select source, block, whole, rest, sum(tokens)::bigint as size, md5(concat_ws('|', '17', source, whole::varchar, block::varchar)) as block_order
  from dealt where rest > 0 group by all
), placed as (
  select *, coalesce(sum(size) over (partition by source order by block_order rows between unbounded preceding and 1 preceding), 0) as before from blocks
), ends as (
  select d.doc_id, d.source, d.tokens, d.whole as epoch, d.block, before + size <= p.rest as all_of_it, p.rest - before as room,
         sum(d.tokens) over (partition by d.source, d.block order by md5(concat_ws('|', '17', d.whole::varchar, d.doc_id::varchar)), d.tokens rows unbounded preceding) as upto
  from dealt d join placed p on d.source = p.source and d.block = p.block where before < p.rest
), every as (
  select doc_id, source, tokens, unnest(range(whole)) as epoch, block from dealt
  union all
  select doc_id, source, tokens, epoch, block from ends where all_of_it or upto <= room
)
select doc_id, source, tokens::bigint as tokens, epoch::int as epoch, block,
       md5(concat_ws('|', '17', source, epoch::varchar, block::varchar)) as block_order,
       md5(concat_ws('|', '17', epoch::varchar, doc_id::varchar)) as doc_order
from every
"""
