"""Cross-site boilerplate lines, found by their spread over sites. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, lookup, named, packed, table

#: A line on so many distinct sites is boilerplate. Sketches have 2**LG_K registers; estimates within MARGIN of the bound are counted exactly.
MIN_SITES, LG_K, MARGIN = 10, 8, 0.25


def key_of(line):
    """What stands for a line: 128 bits of a hash, so that different lines do not meet among any number that could be stored."""
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, site, h) of every line that is not blank; h is the line's hash."""
    split = docs.select("doc_id", F.xxhash64(site).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return split.where(F.trim("line") != "").select("doc_id", "site", key_of("line").alias("h"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h) of the lines on at least min_sites sites.

    A HyperLogLog sketch of the sites per line merges in the map-side and final aggregation. Estimates clear of the bound
    by the margin (about four standard errors of the sketch) decide; the lines between get exact distinct counts, from the
    rows that a semi-join on those lines leaves."""
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    estimated = cut(sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin)))
    clear = estimated.where(F.col("sites") > min_sites * (1 + margin)).select("h")
    near = estimated.where(F.col("sites") <= min_sites * (1 + margin)).select("h")
    exact = lookup(lines.select("h", "site"), near, "h").groupBy("h").agg(F.count_distinct("site").alias("sites"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("h"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text; adds n_lines and n_removed.

    keep_first leaves each such line in the document with the smallest doc_id that has it, so that no content is lost.
    Lines are compared exactly, by a hash of 128 bits; blank lines stay. A null text stays null with 0 lines; a null site is
    a site of its own; a null doc_id keeps its lines, though they count; rows that share a doc_id are one document; an empty
    table gives no rows. Other columns are carried along, whatever their names; those named n_lines or n_removed are
    replaced. Very common lines meet no single task: counts are pre-aggregated and the join back is salted."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = strip(docs, [c for c in kept if c != "text"], site, min_sites, keep_first)
    return rest.select(*[F.col("text") if c == "text" else named([c], "row")[0] for c in kept], "n_lines", "n_removed")


def strip(docs: DataFrame, columns: list[str], site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """row, a struct of columns of docs, text without boilerplate lines, n_lines and n_removed; see remove_boilerplate."""
    lines = cut(lines_of(docs.select("doc_id", "text", site), site).dropDuplicates(["doc_id", "site", "h"]))
    spread = cut(spread_lines(lines, min_sites))
    hits = cut(lookup(lines.select("doc_id", "h").where("doc_id is not null"), spread, "h"))
    if keep_first:
        hits = lookup(hits, hits.groupBy("h").agg(F.min("doc_id").alias("first")), "h").where("doc_id != first")
    drop = hits.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    joined = packed(docs, columns, "doc_id", "text").join(drop, "doc_id", "left")
    parts = F.split("text", "\n")
    stay = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains("gone", key_of(x)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    before, after = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size(stay), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(before)
    n_removed = F.when(F.col("text").isNull() | F.col("gone").isNull(), 0).otherwise(before - after)
    return joined.select("row", text.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without boilerplate lines; one that consisted of nothing else goes.

    All columns keep their values, whatever their names, but for the texts that lines are taken from and their n_chars.
    Nulls, repeated rows, empty texts and empty tables: see remove_boilerplate."""
    rest = strip(docs, [c for c in docs.columns if c != "text"]).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rest.select(*[new[c].alias(c) if c in new else named([c], "row")[0] for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and kept_md5, the MD5 of the text that is left (null: null). Edge cases: see
    remove_boilerplate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = """
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null),
b as (
  select line, min(doc_id) as first from l where trim(line) <> ''
  group by line having count(distinct coalesce(source, chr(0))) >= 10),
k as (
  select l.doc_id, l.line, l.i, b.line is not null and l.doc_id <> b.first as gone
  from l left join b on l.line = b.line),
g as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
         md5(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_md5
  from k group by doc_id)
select d.doc_id, coalesce(g.n_lines, 0)::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed, g.kept_md5
from documents d left join g using (doc_id)
"""
