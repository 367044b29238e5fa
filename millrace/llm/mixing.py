"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, named, packed, running_totals, table, with_size

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: For each of WEIGHTS: the weight's factor at the start and at the end of training; between them it changes linearly.
#: Heavy sources fade, light ones grow. Each schedule's mean is 1, so the totals stay at the weights.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUDGET, REPEATS, BUCKETS = 1.5, 2, 1024
#: What the mix adds to each row.
ADDED = ["size", "source_size", "target", "taken", "position", "source_before", "kind"]


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(src, source_size, weight, kind, target) from (src, source_size), src unique and in the order of the weights.

    Water filling without a loop: ordered by size over weight, a source is at its limit of repeats times its size exactly
    if that limit is at most its share of what those before it leave; what the others share is then one number."""
    n = len(weights)
    ranked = running_totals(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("src")], ["one"])
    kind = F.pmod(F.col("one_before"), F.lit(n)).cast("int")
    weighed = ranked.select("src", "source_size", kind.alias("kind"), F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), kind + 1).alias("weight"))
    weighed = weighed.withColumn("full", F.col("source_size") * repeats)
    total = running_totals(weighed.withColumn("ratio", F.col("full") / F.col("weight")), [F.col("ratio"), F.col("src")], ["full", "weight"])
    total = cut(total)
    whole, weight = total.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted = budget * whole
    at_limit = F.col("full") * (F.lit(weight) - F.col("weight_before")) <= F.col("weight") * (F.lit(wanted) - F.col("full_before"))
    marked = total.withColumn("limited", at_limit)
    spent, left = marked.agg(F.coalesce(F.sum(F.when(F.col("limited"), F.col("full"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("limited"), F.col("weight"))), F.lit(0))).first()
    level = (wanted - spent) / left if left else 0.0
    target = F.when(F.col("limited"), F.col("full").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return marked.select("src", "source_size", "weight", "kind", target.alias("target"))


def position_of(demand, kind, schedules: tuple = SCHEDULES):
    """The time from 0 to 1 at which a source has used up the share `demand` of its target: its integrated schedule, inverted.

    A schedule a + (b - a) t integrates to a t + (b - a) t^2 / 2 over a whole of (a + b) / 2."""
    a, b = (F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), kind + 1) for i in (0, 1))
    d = F.least(F.greatest(demand, F.lit(0.0)), F.lit(1.0)) * (a + b) / 2
    return F.when(a == b, d / a).otherwise((F.sqrt(F.greatest(a * a + 2 * (b - a) * d, F.lit(0.0))) - a) / (b - a))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeats: int = REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """docs with size, source_size, target, taken and position, a row for each row of docs.

    Each source's documents stand in a shuffled order that depends on doc_id alone. The target is filled by whole passes
    over that order and a last part of one, so the words taken of a source miss its target by less than one word; the
    document at the end of the last part gives its first words only. position is the time of the first word taken, null
    where nothing is taken; expand() gives one row per copy. Rows are summed by source and bucket of the shuffled order
    first, then inside each bucket, so that a source with any share of all rows is spread over `buckets` groups.

    Nulls: a null source is a source of its own, last in order; a null text has size 0; a null doc_id is ordered first.
    Rows that are equal in all of doc_id, source and size are interchangeable. An empty table gives no rows. Other columns
    are carried along, whatever their names; those named like one of ADDED are replaced."""
    kept = [c for c in docs.columns if c not in ADDED]
    return place(docs, kept, weights, schedules, budget, repeats, buckets).select(*named(kept, "row"), *ADDED)


def place(docs: DataFrame, columns: list[str], weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeats: int = REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """row, a struct of columns of docs, doc_id and ADDED of each row of docs; see mix."""
    sized = with_size(packed(docs, columns, "doc_id", "source", "text")).drop("text")
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1 << 32)) * buckets / (1 << 32)
    sized = sized.withColumn("src", key).drop("source").withColumn("digest", digest).withColumn("bucket", F.floor(bucket).cast("int"))
    by_bucket = cut(sized.groupBy("src", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(by_bucket.groupBy("src").agg(F.sum("words").alias("source_size")), weights, budget, repeats)
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("src", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")).join(targets, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(base, ["src", "bucket"]).withColumn("source_before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size")
    taken = passes * F.col("size") + F.least(F.greatest(rest - F.col("source_before"), F.lit(0)), F.col("size"))
    first = F.when(F.col("taken") > 0, position_of(F.col("source_before") / F.col("target"), F.col("kind"), schedules))
    return placed.withColumn("taken", taken).withColumn("position", first).select("row", "doc_id", *ADDED)


def expand(mixed: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """A row for each copy that the mix takes, dealt out and sorted by training position; adds copy and words (at most size),
    which replace columns of these names.

    Documents without words are taken once, at the position of what stands before them, if their source is taken at all."""
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(F.lit(1)).cast("int")
    rows = mixed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("words", F.least(size, taken - F.col("copy") * size))
    used = F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("source_before")) / F.col("target")).otherwise(0.0)
    rows = rows.withColumn("position", position_of(used, F.col("kind"), schedules))
    return rows.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of documents in training order, repeated as often as the mix takes them; the last copy of the
    document at the end of a source's target is cut to the words taken.

    All columns keep their values, whatever their names, but for the text of a cut copy and its n_chars. Nulls, repeated rows
    and empty tables: see mix; null and blank texts are taken once."""
    rows, short = expand(place(docs, docs.columns)), F.col("words") < F.col("size")
    first_words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(short, first_words).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else named([c], "row")[0] for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and position, sorted by ranges of position (null, not taken, first).

    Nulls, ties, repeated rows and empty tables: see mix."""
    rows = place(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    rows = cut(rows.select("doc_id", "size", "source_size", "target", "taken", "position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         case when source is null then '1' else '0' || source end as src,
         md5('mix:' || coalesce(doc_id::varchar, '')) as digest
  from documents),
s as (
  select src, sum(size)::bigint as source_size, (row_number() over (order by src) - 1) % 3 as kind from d group by src),
w as (select *, case kind when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as full_size from s),
r as (
  select *, sum(weight) over () - coalesce(sum(weight) over o, 0) as weight_left,
         1.5::double * sum(source_size) over () - coalesce(sum(full_size) over o, 0)::double as words_left
  from w window o as (order by full_size::double / weight, src rows between unbounded preceding and 1 preceding)),
m as (select *, full_size * weight_left <= weight * words_left as limited from r),
l as (
  select (1.5::double * sum(source_size) - coalesce(sum(full_size) filter (where limited), 0)::double)
         / nullif(sum(weight) filter (where not limited), 0)::double as level from m),
t as (
  select src, kind, source_size, case when limited then full_size::double else weight * coalesce(level, 0::double) end as target from m, l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, t.kind, round(t.target)::bigint as goal,
         coalesce(sum(d.size) over (partition by d.src order by d.digest, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint as before_words
  from d join t using (src)),
q as (
  select *, case when source_size > 0 then goal // source_size else 0 end as passes from p),
k as (
  select *, (passes * size + least(greatest(goal - passes * source_size - before_words, 0), size))::bigint as taken,
         case kind when 0 then 1.5::double when 1 then 1.0::double else 0.5::double end as a,
         case kind when 0 then 0.5::double when 1 then 1.0::double else 1.5::double end as b from q),
f as (select *, least(greatest(before_words / target, 0), 1) * (a + b) / 2 as used from k)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then case when a = b then used / a
            else (sqrt(greatest(a * a + 2 * (b - a) * used, 0)) - a) / (b - a) end end as position
from f
"""
