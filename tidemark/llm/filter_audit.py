"""Filter interaction audit: what each of five filters removes in every order, by Walsh-Hadamard sums.

A document's failures are a mask of five bits. For each part and label class (all, good, toxic) one aggregate keeps the 32
sums of (-1)^|mask & s| over its documents, s from 0 to 31: fixed-width numbers that add up across tasks. Their inverse
transform, sum over s of (-1)^|m & s| * W(s) / 32, is the exact number of documents with mask m. All 120 orders and their
steps are then read from the 32 cells of a part, and a filter's Shapley value is the sum over the cells that it fails of
documents * 120 / failures, since among a document's k failed filters each comes first in 120 / k orders.

E needs the whole table: rows are summed up by (digest of the text, doc_id), the smallest doc_id of each digest is found, and
the two are joined on both, so equal texts are no hot key. Digests are SHA-256.

Defined results: null texts count as empty, null lang as the part ''. A row fails E where a row of its text has a smaller
doc_id, so repeated rows of one doc_id don't fail by each other; a null doc_id is neither smaller nor larger than any. Of
several label rows of a doc_id one that is set counts. An empty table gives no parts. Only the named columns are read, so other
columns can't clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._io import saved

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
CELLS = 1 << len(FILTERS)
ORDERS = 120
CLASSES = {"n": "true", "good": "good", "toxic": "toxic"}


def _odd(mask: Column, s: int) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: what a text fails of A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    few = F.size(words) < 200
    same = 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long")
    capitals = 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 3 * F.length(text).cast("long")
    signs = text.rlike(r"[#$%&*|]")
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate((few, same, capitals, signs))), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and documents, summed up by digest and doc_id; masks of all five filters."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("four"))
    base = saved(facts.groupBy("digest", "doc_id", "part", "four").agg(F.count("*").alias("rows")), "audit-texts")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    first = first.where("first_id is not null").select("digest", F.col("first_id").alias("doc_id"), F.lit(True).alias("is_first"))
    later = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    joined = base.join(first.hint("merge"), ["digest", "doc_id"], "left").join(flags.hint("merge"), "doc_id", "left")
    return joined.select(
        "part", (F.col("four") + F.when(later, 16).otherwise(0)).alias("mask"), "rows",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def parity_sums(rows: DataFrame) -> DataFrame:
    """For each part and class an array of the 32 signed sums."""
    wide = rows.groupBy("part").agg(
        *(F.sum(F.when(F.expr(c), (1 - 2 * _odd(F.col("mask"), s)) * F.col("rows")).otherwise(0)).alias(f"{name}_{s}") for name, c in CLASSES.items() for s in range(CELLS))
    )
    return wide.select("part", *(F.array(*(F.col(f"{name}_{s}") for s in range(CELLS))).alias(name) for name in CLASSES))


def cells(sums: DataFrame) -> DataFrame:
    """The inverse transform: for each part and class the numbers of documents of the 32 masks."""

    def inverse(name: str) -> Column:
        signed = F.zip_with(F.col(name), F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda w, s: F.struct(w.alias("w"), s.alias("s")))
        total = lambda m: F.aggregate(signed, F.lit(0).cast("long"), lambda acc, x: acc + x.w * (1 - 2 * F.bit_count(x.s.bitwiseAND(m)).bitwiseAND(F.lit(1))))
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.shiftright(total(m), 5)).alias(name)

    return sums.select("part", *(inverse(name) for name in CLASSES))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    found = cells(parity_sums(masks(docs, labels)))
    steps = [(("".join(o)), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    spread = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"p":{p}}}' for o, s, b, p in steps) + "]"), "array<struct<o:string,s:int,b:int,p:int>>")).alias("x")
    rows = found.select("part", *CLASSES, spread).select("part", *CLASSES, F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.col("x.b").alias("bit"), F.col("x.p").alias("before"))
    mask = F.sequence(F.lit(0), F.lit(CELLS - 1))
    bit, before = F.col("bit"), F.col("before")

    def total(name: str, weight) -> Column:
        return F.aggregate(F.zip_with(F.col(name), mask, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda acc, x: acc + x)

    def flag(c: Column) -> Column:
        return c.cast("long")

    removed = lambda m: flag((m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: flag(m.bitwiseAND(bit.bitwiseOR(before)) == 0)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: flag((m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0))).alias("redundant"),
        F.element_at("n", bit + 1).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", lambda m: F.when(m.bitwiseAND(bit) != 0, F.lit(ORDERS).cast("long") / F.bit_count(m)).otherwise(0).cast("long")).alias("shapley"),
    )


#: The same rows in DuckDB's SQL: every document against every order, without sums or cells.
ORACLE = r"""
with filters as (select unnest(['A','B','C','D','E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as o from filters a, filters b, filters c, filters d, filters e
  where a.f <> b.f and a.f <> c.f and a.f <> d.f and a.f <> e.f and b.f <> c.f and b.f <> d.f and b.f <> e.f and c.f <> d.f and c.f <> e.f and d.f <> e.f),
t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
d as (
  select t.part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) then 'C' else '' end
    || case when regexp_matches(x, '[#$%&*|]') then 'D' else '' end
    || case when t.doc_id > min(t.doc_id) over (partition by x) then 'E' else '' end as fails
  from t left join l on t.doc_id = l.doc_id),
g as (select part, fails, good, toxic, count(*) as n from d group by all),
s as (select part, o, k, o[k] as f, left(o, k - 1) as before from (select distinct part from g), orders, (select unnest([1,2,3,4,5]) as k))
select s.part as part, s.o as filter_order, s.k::int as step,
  sum(case when not contains(fails, f) and len(translate(fails, before, '')) = len(fails) then n else 0 end)::bigint as kept,
  sum(case when contains(fails, f) and len(translate(fails, before, '')) = len(fails) then n else 0 end)::bigint as removed,
  sum(case when contains(fails, f) and len(translate(fails, before, '')) < len(fails) then n else 0 end)::bigint as redundant,
  sum(case when fails = f then n else 0 end)::bigint as unique_fails,
  sum(case when good and contains(fails, f) and len(translate(fails, before, '')) = len(fails) then n else 0 end)::bigint as good_lost,
  sum(case when toxic and contains(fails, f) and len(translate(fails, before, '')) = len(fails) then n else 0 end)::bigint as toxic_lost,
  sum(case when contains(fails, f) then n * 120 // len(fails) else 0 end)::bigint as shapley
from s join g on s.part = g.part group by all
"""
