"""Mixing sources to target weights by Pfair scheduling.

Weights are whole parts of PARTS slots. Block k (from 0) of a source with w parts
is released at slot floor(k * PARTS / w) and due by ceil((k + 1) * PARTS / w). At each
slot the released block with the earliest deadline runs (earliest-deadline-first;
ties go to the source that sorts first). As the weights fill all slots,
every block meets its window, so a source's share of any prefix deviates from its
target by less than one block. The schedule repeats after PARTS slots, so only one
round is worked out, over sources, not over rows; block k of a source runs in
round k div w, at its (k mod w)-th slot of the round.

The mix goes on until every source has been used in full; sources that run out
before start their next epoch, so no row is dropped and the weights hold to
the end. Without weights, a source's target is 3/4 of its natural share
and 1/4 of an equal share.

Skew: rows are numbered within a source in two steps, over hash buckets and
within each, so a source with a third of all rows is never one task's. There are BUCKETS of a
source, cut further by digits of the MD5 in proportion to all rows (BUCKET_ROWS each), which
leaves the order as it is. What is gathered grows with sources, and with buckets.
The schedule of one round is a fold in one row; its work grows as the square of the number of
sources (some 10,000 sources are its bound; group small ones before).

Defined results: a null source is the source ''; rows are taken in pseudo-random but
fixed order (bits of the MD5 of the id, the MD5, then the id; rows that repeat an id get
neighbouring places, either way round); an empty table gives an empty result; all columns of docs
are kept by mix(), but for those that have the names of its own: __slot, __place, __epoch,
__release and __deadline. A source that has to be repeated more than MANY_EPOCHS times to keep its
weight gives a warning.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from avrolith.llm.common import materialize

PARTS = 1000
BUCKETS = 256
BUCKET_ROWS = 50_000
MANY_EPOCHS = 16


def _weights(counts: DataFrame, parts: int, weights: dict[str, int] | None) -> DataFrame:
    """(__s, n, w): rows and parts of each source; the parts sum up to the slots of a round."""
    if weights:
        if min(weights.values()) < 1:
            raise ValueError("a weight is at least one part")
        table = counts.sparkSession.createDataFrame(sorted(weights.items()), "__s string, w long")
        return counts.join(F.broadcast(table), "__s", "left").withColumn("w", F.coalesce("w", F.lit(1).cast("long")))
    everything = Window.partitionBy(F.lit(0))
    # parts of 3/4 natural and 1/4 equal share, rounded down, one at least; the rest goes by remainder
    shares = counts.withColumn("total", F.sum("n").over(everything)).withColumn("k", F.count(F.lit(1)).over(everything))
    shares = shares.withColumn("slots", F.greatest(F.lit(parts).cast("long"), F.col("k") * 10))
    shares = shares.withColumn("num", F.expr("slots * (3 * n * k + total)")).withColumn("den", F.expr("4 * total * k"))
    shares = shares.withColumn("w", F.expr("greatest(num div den, 1)")).withColumn("rest", F.expr("num % den"))
    shares = shares.withColumn("short", F.col("slots") - F.sum("w").over(everything))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "__s")
    largest = Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), "__s")
    shares = shares.withColumn("by_rest", F.row_number().over(order)).withColumn("by_w", F.row_number().over(largest))
    # rounding up to one part may take too much: the largest source gives it back
    extra = F.expr("case when short >= 0 then (case when by_rest <= short then 1 else 0 end) else (case when by_w = 1 then short else 0 end) end")
    return shares.select("__s", "n", (F.col("w") + extra).alias("w"))


def schedule(sources: DataFrame) -> DataFrame:
    """One round, from (__s, n, w): rows (__s, w, slots, j, offset, release, deadline), one per slot.

    Released blocks are taken by deadline: a fold over the slots of a round, whose
    state is how many blocks each source has had.
    """
    one = sources.agg(F.sort_array(F.collect_list(F.struct("__s", "w"))).alias("src"), F.sum("w").alias("slots")).where("slots > 0")
    fold = F.expr(
        """
        aggregate(
          sequence(0L, slots - 1),
          struct(transform(src, x -> 0L) as had, cast(array() as array<int>) as picks),
          (acc, t) -> transform(array(array_min(transform(src, (x, i) -> case
              when (acc.had[i] * slots) div x.w <= t then struct(((acc.had[i] + 1) * slots + x.w - 1) div x.w as due, i as i)
              else struct(9223372036854775807L as due, i as i) end))),
            p -> struct(transform(acc.had, (h, i) -> h + if(i = p.i, 1L, 0L)) as had, concat(acc.picks, array(p.i)) as picks))[0],
          acc -> acc.picks)
        """
    )
    picks = one.withColumn("picks", fold)
    slots = picks.select("src", "slots", F.posexplode("picks").alias("offset", "i"))
    slots = slots.select(F.expr("src[i].__s").alias("__s"), F.expr("src[i].w").alias("w"), "slots", F.col("offset").cast("long").alias("offset"))
    slots = slots.withColumn("j", F.row_number().over(Window.partitionBy("__s").orderBy("offset")).cast("long") - 1)
    return slots.select("__s", "w", "slots", "j", "offset", F.expr("(j * slots) div w").alias("release"), F.expr("((j + 1) * slots + w - 1) div w").alias("deadline"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int] | None = None, parts: int = PARTS, block_rows: int = 1) -> DataFrame:
    """docs, each row once per epoch of its source, with __slot (the block's place in the
    mix), __place (the row's place in its block), __epoch, __release and __deadline.

    weights: parts by source; a source without any gets one part.
    """
    # Digits of the MD5 that cut a bucket further: the third and fourth are the bucket itself.
    digits = max(0, math.ceil(math.log(max(1, docs.count()) / (BUCKETS * BUCKET_ROWS), 16)))
    rows = docs.select(F.coalesce(F.col(source_col), F.lit("")).alias("__s"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__md5"), F.col(id_col).alias("__id"), F.struct(*docs.columns).alias("__doc"))
    finer = F.concat(F.substring("__md5", 1, min(digits, 2)), F.substring("__md5", 5, max(digits - 2, 0)))
    rows = rows.withColumn("__h", F.conv(F.substring("__md5", 1, 4), 16, 10).cast("int") % BUCKETS).withColumn("__f", finer)
    cells = materialize(rows.groupBy("__s", "__h", "__f").agg(F.count(F.lit(1)).alias("c")), "cells")
    counts = materialize(cells.groupBy("__s").agg(F.sum("c").alias("n")), "counts")
    # rows before a cell: those of earlier buckets, then of earlier cells of its own
    buckets = cells.groupBy("__s", "__h").agg(F.sum("c").alias("b"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__b", F.coalesce(F.sum("b").over(earlier("__s", "__h")), F.lit(0).cast("long"))).drop("b")
    inner = F.coalesce(F.sum("c").over(earlier("__s", "__h", "__f")), F.lit(0).cast("long"))
    cells_ = materialize(cells.withColumn("__i", inner).join(buckets, ["__s", "__h"]).select("__s", "__h", "__f", (F.col("__b") + F.col("__i")).alias("__before")), "before")
    sources = materialize(_weights(counts, parts, weights), "sources")
    round_ = materialize(schedule(sources), "round")
    blocks = F.expr(f"(n + {block_rows - 1}) div {block_rows}")

    # The mix ends with the slot at which the last source has had all its blocks.
    last = sources.withColumn("last", blocks - 1).join(round_.select("__s", "slots", "j", "offset"), "__s").where("j = last % w").select(F.expr("(last div w) * slots + offset + 1").alias("end")).agg(F.max("end")).first()[0] or 0
    # Blocks of each source in the mix: whole rounds, and what the last round still gives.
    had = round_.withColumn("end", F.lit(last).cast("long")).groupBy("__s", "w", "slots", "end").agg(F.sum(F.when(F.col("offset") < F.col("end") % F.col("slots"), 1).otherwise(0)).alias("part"))
    had = had.select("__s", "slots", F.expr("(end div slots) * w + part").alias("given")).join(sources.withColumn("__blocks", blocks), "__s").select("__s", F.col("w").alias("__w"), F.col("slots").alias("__slots"), F.col("given").alias("__given"), "__blocks")

    had = materialize(had, "given")
    most = had.agg(F.max(F.expr("(__given - 1) div __blocks + 1"))).first()[0]
    if most is not None and most > MANY_EPOCHS:
        warnings.warn(f"a source is taken {most} times over to keep its weight", stacklevel=2)

    number = Window.partitionBy("__s", "__h", "__f").orderBy("__md5", "__id")
    placed = rows.withColumn("__n", F.row_number().over(number).cast("long") - 1)
    placed = placed.join(_small(cells_), ["__s", "__h", "__f"]).withColumn("__n", F.col("__n") + F.col("__before"))
    placed = placed.join(_small(had), "__s")
    placed = placed.withColumn("__block", F.expr(f"__n div {block_rows}")).withColumn("__place", F.expr(f"__n % {block_rows}"))
    placed = placed.withColumn("__epoch", F.explode(F.expr("sequence(0L, (__given - 1 - __block) div __blocks)")))
    placed = placed.withColumn("__k", F.col("__block") + F.col("__epoch") * F.col("__blocks"))
    placed = placed.withColumn("__j", F.expr("__k % __w"))
    slot = _small(round_.select("__s", F.col("j").alias("__j"), F.col("offset").alias("__offset"), F.col("release").alias("__r"), F.col("deadline").alias("__d")))
    placed = placed.join(slot, ["__s", "__j"])
    turn = F.expr("(__k div __w) * __slots")
    placed = placed.withColumn("__slot", turn + F.col("__offset")).withColumn("__release", turn + F.col("__r")).withColumn("__deadline", turn + F.col("__d"))
    own = ["__slot", "__place", "__epoch", "__release", "__deadline"]
    return placed.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in own], *own)


#: Tables by source (and bucket, or slot) are broadcast up to so many rows.
BROADCAST_ROWS = 500_000


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it has at most BROADCAST_ROWS rows; else Spark's own choice."""
    return F.broadcast(table) if len(table.limit(BROADCAST_ROWS + 1).select(F.lit(1)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= BROADCAST_ROWS).take(1)) else table


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The mix without texts: slot, doc_id, source, epoch, release, deadline."""
    out = mix(docs.select("doc_id", "source"), **options)
    return out.select(F.col("__slot").alias("slot"), "doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__release").alias("release"), F.col("__deadline").alias("deadline"))


ORACLE = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::INT % 256, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k
  FROM documents
), counts AS (SELECT s, count(*)::HUGEINT AS n FROM rows_ GROUP BY s),
tot AS (SELECT sum(n)::HUGEINT AS total, count(*)::HUGEINT AS k FROM counts),
sh AS (
  SELECT s, n, greatest(1000, k * 10)::HUGEINT AS slots, greatest(1000, k * 10)::HUGEINT * (3 * n * k + total) AS num, 4 * total * k AS den FROM counts, tot
), sh2 AS (
  SELECT *, greatest(num // den, 1) AS w0, num % den AS rest FROM sh
), sh3 AS (
  SELECT *, slots - sum(w0) OVER () AS short, row_number() OVER (ORDER BY rest DESC, s) AS by_rest, row_number() OVER (ORDER BY w0 DESC, s) AS by_w FROM sh2
), src AS (
  SELECT s, n, slots::BIGINT AS slots,
         (w0 + CASE WHEN short >= 0 THEN CASE WHEN by_rest <= short THEN 1 ELSE 0 END ELSE CASE WHEN by_w = 1 THEN short ELSE 0 END END)::BIGINT AS w,
         row_number() OVER (ORDER BY s) AS i
  FROM sh3
), arr AS (SELECT list(w ORDER BY i) AS ws, any_value(slots) AS slots FROM src),
sim AS (
  SELECT 0::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick FROM arr
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: had[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT sim.t, sim.had, arr.ws, arr.slots,
               list_position(
                 list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN (had[i] * slots) // ws[i] <= t THEN ((had[i] + 1) * slots + ws[i] - 1) // ws[i] ELSE 9223372036854775807 END),
                 list_min(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN (had[i] * slots) // ws[i] <= t THEN ((had[i] + 1) * slots + ws[i] - 1) // ws[i] ELSE 9223372036854775807 END))) AS p
        FROM sim, arr WHERE t < slots)
), pat AS (
  SELECT src.s, src.w, src.slots, src.n, sim.t - 1 AS o, row_number() OVER (PARTITION BY src.s ORDER BY sim.t) - 1 AS j
  FROM sim JOIN src ON src.i = sim.pick WHERE sim.t > 0
), fin AS (SELECT max(((n - 1) // w) * slots + o + 1) AS e FROM pat WHERE j = (n - 1) % w),
given AS (
  SELECT s, w, slots, n, (any_value(e) // slots) * w + count(*) FILTER (o < e % slots) AS g FROM pat, fin GROUP BY s, w, slots, n
), reps AS (
  SELECT r.doc_id, r.source, r.s, g.w, g.slots, u.e AS epoch, r.k + u.e * g.n AS kb
  FROM rows_ r JOIN given g ON r.s = g.s, LATERAL (SELECT unnest(range(0, ((g.g - 1 - r.k) // g.n + 1)::BIGINT)) AS e) u
)
SELECT ((kb // reps.w) * reps.slots + pat.o)::BIGINT AS slot, doc_id, source, epoch::BIGINT AS epoch,
       ((kb // reps.w) * reps.slots + (pat.j * reps.slots) // reps.w)::BIGINT AS release,
       ((kb // reps.w) * reps.slots + ((pat.j + 1) * reps.slots + reps.w - 1) // reps.w)::BIGINT AS deadline
FROM reps JOIN pat ON pat.s = reps.s AND pat.j = kb % reps.w
"""
