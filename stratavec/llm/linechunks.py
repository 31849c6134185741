"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

Lines are hashed; a rolling hash over the last WINDOW line hashes ends a chunk where it is 0 modulo ``every``, so an
inserted or lost line moves the boundaries near it only. Chunks of two lines or more whose digest occurs more than once
are then compared byte by byte, over all documents; of equal chunks the first (least document id, then place) stays,
the others' lines go. Three column-pruned passes: digests are counted (partial counts, so a common chunk is one row a
task), texts are fetched for repeated digests alone, and the documents that lose lines are put together again.

Defined results: a null text has no lines and stays null; an empty text is one empty line; null ids sort before others;
rows equal in id and text count as one occurrence and are treated alike; other columns pass through, ``n_chars`` (if
there is one) is counted anew, and one named like a result gives way to it; an empty table gives no rows. A text of any
length is one row; the work on it is in proportion to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.session import materialize

EVERY = 3

# line hash: 28 leading bits of MD5; rolling hash over a window of two line hashes
_HASHES = "transform(_split, x -> cast(conv(substring(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))"
_ENDS = "filter(sequence(1, size(_x.h)), i -> i = size(_x.h) or (element_at(_x.h, i) * 31 + if(i > 1, element_at(_x.h, greatest(i - 1, 1)), 0L)) % {every} = 0)"
_CHUNKS = "transform(_y.e, (e, k) -> struct(k + 1 as k, if(k = 0, 1, element_at(_y.e, greatest(k, 1)) + 1) as a, e as b))"


def chunked(docs: DataFrame, every: int = EVERY, text: str = "text") -> DataFrame:
    """``docs`` with ``_lines`` and ``_chunks`` (number, first and last line, all from 1).

    Each step's arrays come out of a one-row explode. Without it a filter on the result is pushed below the steps, which
    puts whole steps inside the next one's lambda and makes the work quadratic in the lines and worse.
    """
    split = docs.withColumn("_split", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1))
    hashed = split.withColumn("_x", F.explode(F.array(F.struct(F.col("_split").alias("l"), F.expr(_HASHES).alias("h"))))).drop("_split")
    ended = hashed.withColumn("_y", F.explode(F.array(F.struct(F.col("_x.l").alias("l"), F.expr(_ENDS.format(every=every)).alias("e"))))).drop("_x")
    done = ended.withColumn("_z", F.explode(F.array(F.struct(F.col("_y.l").alias("l"), F.expr(_CHUNKS).alias("c"))))).drop("_y")
    return done.withColumn("_lines", F.col("_z.l")).withColumn("_chunks", F.col("_z.c")).drop("_z")


_BODY = "array_join(slice(_lines, _c.a, _c.b - _c.a + 1), '\n')"


def occurrences(docs: DataFrame, every: int, text: str, key: str) -> DataFrame:
    """Every multi-line chunk: _id, _row (hash of the whole text), _k, _a and _b (its first and last line), _digest and _body."""
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    cut = chunked(narrow, every, "_text")
    rows = cut.select("_id", F.xxhash64("_text").alias("_row"), "_lines", F.explode(F.expr("filter(_chunks, c -> c.b > c.a)")).alias("_c"))
    return rows.select("_id", "_row", F.col("_c.k").alias("_k"), F.col("_c.a").alias("_a"), F.col("_c.b").alias("_b"), F.expr(_BODY).alias("_body")).withColumn("_digest", F.unhex(F.md5(F.col("_body").cast("binary"))))


def repeats(docs: DataFrame, every: int = EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _row, _k, _a, _b): the chunks that stood before, with their lines."""
    found = occurrences(docs, every, text, key)
    repeated = found.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest")
    mine = found.join(repeated, "_digest", "left_semi")
    first = mine.groupBy("_digest", "_body").agg(F.min(F.struct("_id", "_row", "_k")).alias("_first"))
    first = first.select(F.col("_digest").alias("_d2"), F.col("_body").alias("_b2"), "_first")
    again = mine.join(first, (F.col("_digest") == F.col("_d2")) & (F.col("_body") == F.col("_b2"))).where(~F.struct("_id", "_row", "_k").eqNullSafe(F.col("_first")))
    return again.select("_id", "_row", "_k", "_a", "_b")


def removals(docs: DataFrame, every: int = EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _row, _gone): the numbers of the chunks that each affected document loses."""
    return repeats(docs, every, text, key).groupBy("_id", "_row").agg(F.collect_set("_k").alias("_gone"))


def dedup(docs: DataFrame, every: int = EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated chunks gone from the text, plus lines, chunks and removed_chunks, removed_lines."""
    gone = removals(docs, every, text, key)
    names = [c for c in docs.columns if c not in ("lines", "chunks", "removed_chunks", "removed_lines")]
    own = {c: f"_c{i}" for i, c in enumerate(names)}  # the table's columns can't clash with the working ones
    rows = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names])
    k, t = own[key], own[text]
    rows = rows.withColumn("_hit", F.xxhash64(F.col(t).cast("string")))
    joined = rows.join(gone, F.col(k).eqNullSafe(F.col("_id")) & (F.col("_hit") == F.col("_row")), "left")
    cut = chunked(joined, every, t)
    # array_except hashes, so this is linear in the chunks, however many are lost
    new = F.expr("array_join(flatten(transform(array_except(sequence(1, size(_chunks)), _gone), k -> slice(_lines, element_at(_chunks, k).a, element_at(_chunks, k).b - element_at(_chunks, k).a + 1))), '\n')")
    cut = cut.withColumn("_new", F.when(F.col("_gone").isNull(), F.col(t)).otherwise(new))
    values = {text: F.col("_new"), "n_chars": F.length("_new").cast("long")}

    def counted(x) -> Column:
        return F.when(F.col(t).isNull(), 0).otherwise(x).cast("long")

    lost = F.expr("aggregate(_gone, 0L, (s, k) -> s + element_at(_chunks, k).b - element_at(_chunks, k).a + 1)")
    stats = [counted(F.size("_lines")).alias("lines"), counted(F.size("_chunks")).alias("chunks"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("removed_chunks"), F.coalesce(lost, F.lit(0)).cast("long").alias("removed_lines")]
    return cut.select(*[values.get(c, F.col(own[c])).alias(c) for c in names], *stats)


_DIGEST = "unhex(substring(sha2({x}, 256), 1, 32))"
_HASHED = f"transform(_split, x -> {_DIGEST.format(x='cast(x as binary)')})"
_PAIRS = f"transform(filter(sequence(1, size(_x.h)), i -> i < size(_x.h)), i -> struct(i as a, i + 1 as b, {_DIGEST.format(x='concat(element_at(_x.h, i), element_at(_x.h, i + 1))')} as d))"
_LONG = "transform(filter(sequence(1, size(_x.h)), i -> length(element_at(_x.l, i)) >= 2 * {n} - 1 and size(split(trim(element_at(_x.l, i)), '[ \\\\t\\\\r]+')) >= {n}), i -> struct(i as a, i as b, element_at(_x.h, i) as d))"


def dedup_passages(docs: DataFrame, long_line: int = 50, every: int = EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated passages gone from the text, plus removed_lines.

    Repeated content-defined chunks go as in :func:`dedup`; their places are written to the shared folder. An exact check then finds what
    chunks miss, judged on the whole texts: every two consecutive lines, and every line of ``long_line`` words or more, are a window; the first of equal windows
    (ordered as in :func:`dedup`) stays, the others' lines go. So a repeated run of two or more lines goes whole, however
    short and wherever chunks would end, and the first occurrence of every line stays. Windows are equal where 128 bits
    of SHA-256 are, so digests alone are shuffled. The results for nulls, equal rows and ``n_chars`` are those of :func:`dedup`.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    own = {c: f"_c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names])
    k, t = own[key], own[text]
    narrow = rows.where(F.col(t).isNotNull()).select(F.col(k).alias("_id"), F.xxhash64(F.col(t).cast("string")).alias("_row"), F.split(F.col(t).cast("string"), "\n", -1).alias("_split"))
    hashed = narrow.withColumn("_x", F.explode(F.array(F.struct(F.col("_split").alias("l"), F.expr(_HASHED).alias("h")))))  # see chunked
    found = hashed.select("_id", "_row", F.explode(F.expr(f"concat({_PAIRS}, {_LONG.format(n=long_line)})")).alias("_w")).select("_id", "_row", "_w.*")
    place = F.struct("_id", "_row", "a")
    first = found.groupBy(F.col("d").alias("_d")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = found.join(first, F.col("d") == F.col("_d")).where(~place.eqNullSafe(F.col("_first")))
    lines = again.select("_id", "_row", F.explode(F.array("a", "b")).alias("_line"))
    chunks = materialize(repeats(docs, every, text, key), "chunks").select("_id", "_row", F.explode(F.sequence("_a", "_b")).alias("_line"))
    gone = chunks.union(lines).groupBy("_id", "_row").agg(F.collect_set("_line").alias("_gone"))
    joined = rows.withColumn("_hit", F.xxhash64(F.col(t).cast("string"))).join(gone, F.col(k).eqNullSafe(F.col("_id")) & (F.col("_hit") == F.col("_row")), "left")
    cut = joined.withColumn("_split", F.split(F.col(t).cast("string"), "\n", -1))
    new = F.expr("array_join(transform(array_except(sequence(1, size(_split)), _gone), i -> element_at(_split, i)), '\n')")
    cut = cut.withColumn("_new", F.when(F.col("_gone").isNull(), F.col(t)).otherwise(new))
    values = {text: F.col("_new"), "n_chars": F.length("_new").cast("long")}
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("removed_lines")
    return cut.select(*[values.get(c, F.col(own[c])).alias(c) for c in names], removed)


SQL = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM l),
e AS (SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR (h[i] * 31 + CASE WHEN i > 1 THEN h[greatest(i - 1, 1)] ELSE 0 END) % 3 = 0) AS e FROM h),
c AS (SELECT doc_id, lines, unnest(range(1, len(e) + 1)) AS k, e FROM e),
d AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 1 ELSE e[greatest(k - 1, 1)] + 1 END AS a, e[k] AS b, lines FROM c),
t AS (SELECT doc_id, k, a, b, array_to_string(lines[a:b], chr(10)) AS body FROM d),
r AS (SELECT *, b > a AND row_number() OVER (PARTITION BY body, b > a ORDER BY doc_id, k) > 1 AS gone FROM t)
SELECT doc_id, CASE WHEN any_value(u.text) IS NULL THEN 0 ELSE max(b) END::BIGINT AS lines, CASE WHEN any_value(u.text) IS NULL THEN 0 ELSE count(*) END::BIGINT AS chunks,
  count(*) FILTER (gone)::BIGINT AS removed_chunks, coalesce(sum(b - a + 1) FILTER (gone), 0)::BIGINT AS removed_lines,
  md5(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_md5
FROM r JOIN documents u USING (doc_id) GROUP BY doc_id
"""
