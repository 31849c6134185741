"""Proportional stratified interleaving: shards that each hold the sources in the whole table's proportions.

Rows of a source are ranked by a seeded hash of their key; row r of n gets the fraction (2 r - 1) / 2 n; the rows of
all sources are sorted by fraction and cut into equal runs. Both ranks are exact and no task ranks a whole source or
table: rows are dealt by (source, leading hash digits), later by the fraction's bin, ranked there, and lifted by
running sums of the bins' counts.

Defined results: a null source is a source of its own; a row without a key is shuffled by its other columns; ties stand by source, hash, key and the
carried columns (equal rows are interchangeable); with fewer rows than shards some shards stay empty; an empty table gives no rows; a column named ``shard`` or
``slot`` gives way to the result. Rows of equal texts ("Groups: equal texts" of a table) are rows like others under this law: it deals
by source and place, so copies may go to different shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a task ranks at a time, about.
BIN_ROWS = 50_000


def seeded_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))


def interleave(df: DataFrame, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``df``'s source, key and carried columns (null: all others) with ``shard`` and ``slot`` (place in the shard, from 0)."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in (source, key, "shard", "slot")]
    n = df.count()
    digits = 1
    while n / 16**digits > BIN_ROWS:
        digits += 1
    bins = max(1, -(-n // BIN_ROWS)) * 8
    # own names, so that columns of the table can't clash with the working ones
    other = F.md5(F.concat(F.lit(f"{seed}:null:"), F.xxhash64(*[F.col(f"`{c}`") for c in carry], F.lit(0)).cast("string")).cast("binary"))
    h = F.when(F.col(key).isNull(), other).otherwise(seeded_hash(seed, key))
    rows = df.select(F.col(source).alias("s"), F.col(key).alias("k"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("z")).alias("c"), h.alias("h"))
    rows = rows.withColumn("b", F.substring("h", 1, digits))
    counts = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("m"))
    by_source = Window.partitionBy("s")
    before = counts.select(F.col("s").alias("s2"), F.col("b").alias("b2"), (F.sum("m").over(by_source.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("below"), F.sum("m").over(by_source).alias("n"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k", "c")))
    ranked = ranked.join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    placed = ranked.select("s", "k", "c", "h", ((2 * (F.col("below") + F.col("r")) - 1).cast("double") / (2 * F.col("n"))).alias("f"))
    placed = placed.withColumn("g", F.least(F.floor(F.col("f") * bins), F.lit(bins - 1)).cast("int"))
    per_bin = placed.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    lift = per_bin.select(F.col("g").alias("g2"), (F.sum("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("below"))
    final = placed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("f", "s", "h", "k", "c")))
    # the window has dealt the rows by g already, so the join moves the bins' counts only
    final = final.join(lift, F.col("g") == F.col("g2")).withColumn("at", F.col("below") + F.col("r") - 1)
    shard = F.expr(f"at * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    out = final.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    return out.select(F.col("s").alias(source), F.col("k").alias(key), *[F.col(f"c.c{i}").alias(c) for i, c in enumerate(carry)], F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, target: str) -> None:
    """One folder a shard, rows by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)


#: What the query over ``documents`` gives, for 24 shards and seed 17; a test holds it against the query. DuckDB has no CRC-32, so the sum is taken by its table.
SQL = """
WITH RECURSIVE t(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, source, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM d),
c AS (SELECT doc_id, source, len(b) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, v: xor(s // 256, l[xor(s % 256, v) + 1])), 4294967295) AS text_crc32 FROM b, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n), source NULLS FIRST, md5('17:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS m FROM r),
s AS (SELECT *, (pos * 24 // m) AS shard FROM p)
SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * m + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
