"""Mixing sources to target weights by whole blocks.

Each source gets a share of the mix by its weight, at most two times its own size; what is above
goes to the others by weight. Sainte-Lague apportionment then gives each source a whole number of
equal blocks of words: the blocks go to the highest quotients target / (2 seat - 1). A source's
documents are dealt to shards of bounded size and stand there in seeded order as one stream; the
source's blocks are apportioned to its shards the same way, and within a shard each block is taken
the same number of times, the rest by seeded order of blocks. A source of less than FEW blocks is
small: its blocks are a FEWth of its own size, it takes as many of them as its target asks for, and
the others share what is left.

Sizes, hashes and quotas are functions of the rows, so reruns agree. Null and empty texts have size
0 and are taken 0 times. Null is a source of its own, the last. Rows that repeat a document id, or have
none, are taken as they come: ties in the seeded order stand by size, then by a hash of the text. An
empty table gives an empty mix. Of extra columns none is read. Of a very long text only the size
counts: a text longer than a block, or a shard, takes up several blocks, or all of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words in a shard of a source, about, and shards of all sources: so as many rows are ranked at once.
SHARD_WORDS, SHARDS = 200_000, 100_000
#: Blocks are total / BLOCKS words long, within LEAST and MOST.
BLOCKS, LEAST, MOST = 200_000, 64, 4096
#: Sources of less than so many blocks have blocks of their own length.
FEW = 32
SEED = 17


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_mark, size): words of each text."""
    return docs.select(F.col("doc_id"), F.col("source"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_mark"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: k (its rank), source_size, weight, target, total, block, small."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("k", F.row_number().over(by))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    src = src.withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.col("source_size") * most)
    # Those that reach their limit first are those with the least limit for their weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    src = src.withColumn("pos", F.row_number().over(order))
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("rate", (F.col("total") * share - used) / left)
    src = src.withColumn("full", F.col("cap") <= F.col("rate") * F.col("weight"))
    rate = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.col("pos"))).over(every)
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rate))
    block = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.floor(F.col("total") / BLOCKS))).cast("long")
    small = (F.col("source_size") > 0) & (F.col("source_size") < FEW * block)
    own = F.when(small, F.greatest(F.lit(1), F.floor(F.col("source_size") / FEW))).otherwise(block).cast("long")
    return src.select("source", "k", "source_size", "weight", "target", "total", own.alias("block"), small.alias("small"))


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """rows with won: the seats of each by highest quotients weight / (2 s - 1).

    With n rows in a group, sum t of weights and m seats, the divisors t / (m - n / 2) and
    t / (m + n / 2) give too few and too many seats in all, or just enough; only seats between,
    about 2 n of them, are ranked.
    """
    g = Window.partitionBy(*group)
    x = rows.withColumn("_t", F.sum(weight).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    at = lambda m: F.when(F.col("_t") > 0, F.greatest(F.floor(F.col(weight) * m / F.col("_t") + 0.5), F.lit(0))).otherwise(0)
    x = x.withColumn("_lo", at(F.col(seats) - F.col("_n") / 2)).withColumn("_hi", at(F.col(seats) + F.col("_n") / 2))
    x = x.withColumn("_rest", F.col(seats) - F.sum("_lo").over(g))
    c = x.where(F.col("_hi") > F.col("_lo")).select(*group, key, weight, "_rest", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_s"))
    rank = F.row_number().over(g.orderBy((F.col(weight) / (2 * F.col("_s") - 1)).desc(), key, "_s"))
    c = c.withColumn("_r", rank).where(F.col("_r") <= F.col("_rest")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_more"))
    won = (F.col("_lo") + F.coalesce(F.col("_more"), F.lit(0))).cast("long")
    return x.join(c, [*group, key], "left").withColumn("won", won).drop("_t", "_n", "_lo", "_hi", "_rest", "_more")


def _number(text: Column, n: int = 8) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED, with_mark: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, weight, block) for each document; with_mark adds a hash of
    its text as text_mark, so that rows can be told apart."""
    sized = stored(sizes(docs))
    src = stored(targets(sized, weights, share, most))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(SHARD_WORDS), F.floor(F.col("total") / SHARDS)))).cast("long")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = sized.join(src.select(F.col("source").alias("_s"), "k", "source_size", "weight", "target", "total", "block"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("mark", mark).withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % shards)
    stream = Window.partitionBy("k", "shard").orderBy("mark", "size", "text_mark")
    placed = placed.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    # Blocks of each source, then of each of its shards, a few rows for each.
    lengths = sized.join(src.select(F.col("source").alias("_s"), "k", "source_size", "total", "block"), F.col("source").eqNullSafe(F.col("_s")))
    lengths = lengths.withColumn("shard", F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % shards)
    lengths = lengths.groupBy("k", "shard", "block").agg(F.sum("size").alias("length")).where("length > 0")
    apart = F.coalesce(F.sum(F.when(F.col("small"), F.col("target"))).over(Window.partitionBy()), F.lit(0.0))
    seats = F.round((F.col("total") * share - apart) / F.col("block")).cast("long")
    won = apportion(src.withColumn("seats", seats).where("NOT small"), [], "k", "target", "seats")
    won = won.select("k", F.least(F.col("won"), F.floor(F.col("source_size") * most / F.col("block"))).alias("seats"))
    # The target as a share of the source's blocks: what is to be taken twice is taken so to the last word.
    own = F.round(F.col("target") * F.ceil(F.col("source_size") / F.col("block")) / F.col("source_size")).cast("long")
    won = won.unionByName(src.where("small").select("k", own.alias("seats")))
    quota = apportion(lengths.join(won, "k"), ["k"], "shard", "length", "seats")
    n = F.ceil(F.col("length") / F.col("block"))
    quota = quota.withColumn("n", n).withColumn("q", F.least(F.col("won"), (n * F.lit(most)).cast("long")))
    quota = quota.select("k", "shard", "block", "n", F.expr("q div n").alias("base"), F.expr("q % n").alias("more"))
    blocks = quota.select("k", "shard", "block", "base", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "k", "shard", "b").cast("binary"))
    inner = Window.partitionBy("k", "shard")
    blocks = blocks.withColumn("extra", (F.row_number().over(inner.orderBy(turn, "b")) <= F.col("more")).cast("long"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("extra").over(inner.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Words of the stream's extra blocks before a document's end; a document has what lies between its ends.
    seen = placed.withColumn("b", F.expr("greatest(end - 1, 0) div block"))
    seen = seen.join(blocks.select("k", "shard", "b", "base", "extra", "before"), ["k", "shard", "b"], "left")
    upto = F.col("before") * F.col("block") + F.col("extra") * (F.col("end") - F.col("b") * F.col("block"))
    seen = seen.withColumn("upto", F.when(F.col("end") > 0, F.coalesce(upto, F.lit(0))).otherwise(0))
    extra = F.col("upto") - F.lag("upto", 1, 0).over(stream)
    taken = F.coalesce(F.col("base"), F.lit(0)) * F.col("size") + F.when(F.col("size") > 0, extra).otherwise(0)
    return seen.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("weight").cast("long").alias("weight"), "block", *(["text_mark"] if with_mark else []))


def _apportioned(name: str, rows: str, group: str, key: str, weight: str) -> str:
    over = f"PARTITION BY {group}" if group else ""
    cols = f"{group}, {key}" if group else key
    return f"""
{name}_x AS (SELECT *, sum({weight}) OVER ({over}) AS t_, count(*) OVER ({over}) AS n_ FROM {rows}),
{name}_y AS (SELECT *, CASE WHEN t_ > 0 THEN greatest(floor({weight} * (seats - n_ / 2) / t_ + 0.5), 0)::BIGINT ELSE 0 END AS lo_,
  CASE WHEN t_ > 0 THEN greatest(floor({weight} * (seats + n_ / 2) / t_ + 0.5), 0)::BIGINT ELSE 0 END AS hi_ FROM {name}_x),
{name}_z AS (SELECT *, seats - sum(lo_) OVER ({over}) AS rest_ FROM {name}_y),
{name}_c AS (SELECT {cols}, {weight}, rest_, unnest(range(lo_ + 1, hi_ + 1)) AS s_ FROM {name}_z),
{name}_r AS (SELECT *, row_number() OVER ({over} ORDER BY {weight} / (2 * s_ - 1) DESC, {key}, s_) AS r_ FROM {name}_c),
{name}_m AS (SELECT {cols}, count(*) AS more_ FROM {name}_r WHERE r_ <= rest_ GROUP BY {cols}),
{name} AS (SELECT z.*, (lo_ + coalesce(more_, 0))::BIGINT AS won FROM {name}_z z LEFT JOIN {name}_m m USING ({cols}))"""


def sql(share: float = 1.5, most: float = 2.0, seed: int = SEED) -> str:
    """The same result for the documents table in DuckDB's SQL."""
    number = "('0x' || substr(mark, 1, 8))::BIGINT"
    weight = "CASE (k - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM a),
c AS (SELECT *, {weight} AS weight, (sum(source_size) OVER ())::BIGINT AS total, source_size * {most}::DOUBLE AS cap FROM b),
d AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS pos FROM c),
e AS (SELECT *, (total * {share}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM d),
f AS (SELECT *, cap <= rate * weight AS "full" FROM e),
src0 AS (SELECT source, k, source_size, weight, total, CASE WHEN "full" THEN cap ELSE weight * (min_by(rate, pos) FILTER (WHERE NOT "full") OVER ()) END AS target,
  least({MOST}, greatest({LEAST}, floor(total / {BLOCKS})))::BIGINT AS common FROM f),
src AS (SELECT *, source_size > 0 AND source_size < {FEW} * common AS small,
  CASE WHEN source_size > 0 AND source_size < {FEW} * common THEN greatest(1, floor(source_size / {FEW})) ELSE common END::BIGINT AS block FROM src0),
p AS (SELECT s.doc_id, s.size, src.*, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM sized s JOIN src ON s.source IS NOT DISTINCT FROM src.source),
placed0 AS (SELECT *, {number} % greatest(1, ceil(source_size / greatest({SHARD_WORDS}, floor(total / {SHARDS}))))::BIGINT AS shard FROM p),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY k, shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM placed0),
lengths AS (SELECT k, shard, block, sum(size)::BIGINT AS length FROM placed GROUP BY ALL HAVING sum(size) > 0),
apart AS (SELECT coalesce(sum(target) FILTER (WHERE small), 0) AS words FROM src),
seated AS (SELECT src.*, round((total * {share}::DOUBLE - words) / block)::BIGINT AS seats FROM src, apart WHERE NOT small),{_apportioned("won1", "seated", "", "k", "target")},
won AS (SELECT k, least(won, floor(source_size * {most}::DOUBLE / block))::BIGINT AS seats FROM won1
  UNION ALL SELECT k, round(target * ceil(source_size / block) / source_size)::BIGINT FROM src WHERE small),
ls AS (SELECT lengths.*, seats FROM lengths JOIN won USING (k)),{_apportioned("won2", "ls", "k", "shard", "length")},
q AS (SELECT k, shard, block, ceil(length / block)::BIGINT AS n, least(won, (ceil(length / block) * {most}::DOUBLE)::BIGINT) AS q FROM won2),
bl AS (SELECT k, shard, block, q // n AS base, q % n AS more, unnest(range(0, n)) AS b FROM q),
ex AS (SELECT *, (row_number() OVER (PARTITION BY k, shard ORDER BY md5('{seed}:' || k || ':' || shard || ':' || b), b) <= more)::BIGINT AS extra FROM bl),
be AS (SELECT *, coalesce(sum(extra) OVER (PARTITION BY k, shard ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ex),
seen AS (SELECT p.*, base, CASE WHEN "end" > 0 THEN coalesce(before * p.block + extra * ("end" - be.b * p.block), 0) ELSE 0 END AS upto
  FROM placed p LEFT JOIN be ON be.k = p.k AND be.shard = p.shard AND be.b = greatest("end" - 1, 0) // p.block)
SELECT doc_id, size, source_size, target, (coalesce(base, 0) * size + CASE WHEN size > 0 THEN upto - lag(upto, 1, 0) OVER (PARTITION BY k, shard ORDER BY mark, size) ELSE 0 END)::BIGINT AS taken,
  weight::BIGINT AS weight, block FROM seen"""
