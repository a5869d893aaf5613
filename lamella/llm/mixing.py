"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, its target share of all characters over its actual share. A
document's number of copies is the Poisson quantile, at that mean, of a uniform number drawn from
the seed and its id and text; copies are exploded and ordered by another such draw, which shuffles them
globally: its leading digits, which are even, name the partition, so no sampling pass draws everything a second time.
Rates come from one aggregate over all rows and meet the documents as a broadcast only
while the table of sources is small, else in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialise, numbered, only, parts, place

#: Means above it are drawn as sums of several equal parts, so that exp(-mean) never vanishes.
MEAN_PART = 32.0
#: Bytes of names and rates up to which the table of sources is broadcast.
BROADCAST_BYTES = 8 << 20


def poisson_quantile(mean: str, u: str) -> str:
    """SQL for the least k with P(X <= k) > u, X of Poisson's law with this mean (at most MEAN_PART).

    The distribution is summed term by term up to 20 + 8 times the mean, where what is left of it
    is below 2**-52, the step of u; so no quantile lies beyond.
    """
    terms = f"sequence(1, cast(20 + 8 * {mean} as int))"
    start = f"named_struct('k', 0, 'p', exp(-{mean}), 'all', exp(-{mean}))"
    step = f"(s, i) -> if(s.all > {u}, s, named_struct('k', i, 'p', s.p * {mean} / i, 'all', s.all + s.p * {mean} / i))"
    return f"aggregate({terms}, {start}, {step}).k"


def temperature_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """source, weight: each source's size raised to the power, so that small sources count for more than their share."""
    return sizes.select("source", F.pow(F.col("chars").cast("double"), F.lit(power)).alias("weight"))


def source_sizes(docs: DataFrame) -> DataFrame:
    """source, chars: the code points of each source's texts, a null source being one of its own."""
    return only(docs, "source", "text").select("source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("chars"))


def rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """source, rate: the mean number of copies that brings each source to its share of as many characters as there are.

    weights: source, weight, any positive scale; sources that it lacks get none. None: temperature_weights.
    """
    sizes = source_sizes(docs)
    weights = (weights if weights is not None else temperature_weights(sizes)).select(F.col("source").alias("s"), "weight").where("weight > 0")
    joined = sizes.join(weights, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_rows = joined.where("chars > 0").agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    return joined.crossJoin(F.broadcast(all_rows)).select("source", F.when(F.col("chars") > 0, F.round(F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars"), 9)).otherwise(0.0).alias("rate"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: int = 5) -> DataFrame:
    """docs, each row as often as its draw says, with the columns copy (int, from 0), rate and slot_key, in global random order.

    Needs doc_id, text and source; a column named copy, rate or slot_key is replaced. Rows are told
    apart by doc_id and text alone: repeated rows have equal draws, so they are repeated alike and lie side by side. A source without characters
    (null and empty texts only) has rate 0, so its rows go, as they carry nothing to a mix; so do those of
    sources whose weight is 0. Null doc_ids and sources are values like others. Output rows are in
    ascending slot_key over the whole frame. An empty table gives none.
    """
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ("copy", "rate", "slot_key")]
    names, own = [docs.columns[i] for i in keep], [f"c{i}" for i in keep]
    doc_id, text, source = (f"c{place(docs, x)}" for x in ("doc_id", "text", "source"))
    rate = materialise(rates(docs, weights).select(F.col("source").alias("__mix_source"), F.col("rate")), "rates")
    size = rate.agg(F.sum(F.coalesce(F.octet_length("__mix_source"), F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else a join, which adaptive execution splits at a hot source
        rate = F.broadcast(rate)
    rated = numbered(docs).select(*own).join(rate, F.col(source).eqNullSafe(F.col("__mix_source")))
    split = f"greatest(1, cast(ceil(rate / {MEAN_PART!r}D) as int))"
    name = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rated = rated.withColumn("__mix_name", name).withColumn("__mix_split", F.expr(split))
    draw = "cast(conv(substring(md5(concat_ws(':', '{0}', __mix_name, cast(part as string))), 1, 13), 16, 10) as double) / 4503599627370496D".format(seed)
    count = f"aggregate(transform(sequence(1, __mix_split), part -> {poisson_quantile('(rate / __mix_split)', '(' + draw + ')')}), 0, (a, k) -> a + k)"
    counted = rated.withColumn("__mix_count", F.expr(count)).where("__mix_count > 0")
    copies = counted.withColumn("copy", F.explode(F.expr("sequence(0, __mix_count - 1)")))
    copies = copies.withColumn("slot_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:slot"), F.col("__mix_name"), F.col("copy").cast("string"))))
    n = parts(docs.sparkSession)
    slice_ = F.expr(f"cast((cast(conv(substring(slot_key, 1, 8), 16, 10) as bigint) * {n}) div {1 << 32} as int)")
    ordered = copies.select(*own, "copy", "rate", "slot_key").repartitionById(n, slice_).sortWithinPartitions("slot_key")
    return ordered.toDF(*names, "copy", "rate", "slot_key")


#: What replicate() does with the default weights and seed 5, for the columns of documents.
ORACLE = """
with sizes as (select source, sum(coalesce(length(text), 0)) as chars from documents group by source),
alls as (select sum(chars) as all_chars, sum(sqrt(chars::double)) as all_weight from sizes where chars > 0),
rates as (select source, case when chars > 0 then round(sqrt(chars::double) / all_weight * all_chars / chars, 9) else 0 end as rate from sizes, alls),
named as (
  select d.*, r.rate, greatest(1, ceil(r.rate / 32.0)::int) as parts,
    md5(concat_ws(':', coalesce(d.doc_id::varchar, 'null'), md5(coalesce(d.text, '')))) as name
  from documents d join rates r on d.source is not distinct from r.source),
draws as (select name, part, rate / parts as mean, ('0x' || substr(md5(concat_ws(':', '5', name, part::varchar)), 1, 13))::bigint / 4503599627370496.0::double as u
  from (select distinct name, rate, parts, unnest(range(1, parts + 1)) as part from named)),
terms as (
  with recursive t(name, part, mean, u, k, p, total) as (
    select name, part, mean, u, 0, exp(-mean), exp(-mean) from draws
    union all
    select name, part, mean, u, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) from t where total <= u and k < floor(20 + 8 * mean))
  select name, part, max(k) as k from t group by name, part),
counts as (select name, sum(k)::bigint as n from terms group by name)
select doc_id, text, lang, source, n_chars, rate, copy::int as copy, md5(concat_ws(':', '5:slot', name, copy::varchar)) as slot_key
from (select n.*, unnest(range(0, c.n)) as copy from named n join counts c on n.name = c.name where c.n > 0)
"""
