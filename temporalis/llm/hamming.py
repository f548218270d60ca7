"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of b bits is cut into m segments of b / m bits, about log2 of the number of codes
each. The index has a row (segment, key) for each segment of each distinct code. Step
(r, i) probes segment i of a query's code with all keys at distance r from its own and
verifies the codes found there by their full Hamming distance. After it each code within
m * r + i has been seen (any other differs by more than r in the segments up to i and by r in the
rest), so a query leaves as soon as its k-th verified distance is no larger than that; only
the others go on.

Copies of a code are searched once: a code keeps its k smallest ids (no other copy can be
among a query's k, since ties go by id), queries with one code are one query. What a query has so far
are ids, each with its least distance, so that an id with several codes counts once. Far-off queries,
and a k near the number of rows, take more steps, up to radius b / m, where all codes are seen.

Nulls: a row without an id, or with no code, is neither indexed nor a query. Rows that
repeat an id and a code are one; an id with several codes stands for each of them, and the
least distance counts. Other columns are ignored. An empty table gives an empty result;
with fewer than k ids a query gets them all.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, stored

K = 10
BITS = 32
#: A step probes at most this many keys a query; segments of 16 bits never need more.
MASKS = 20_000


def comparison_code(vector: Column, bits: int = BITS) -> Column:
    """A code of a vector of 2 * bits numbers: bit i tells whether x[i] > x[i + bits].

    Each bit is the sign of a projection on a fixed direction. Null if the vector is null,
    shorter, or holds a null.
    """
    bit = [F.when(F.get(vector, F.lit(i)) > F.get(vector, F.lit(i + bits)), F.lit(1 << i)).when(F.get(vector, F.lit(i)).isNotNull() & F.get(vector, F.lit(i + bits)).isNotNull(), F.lit(0)).cast("long") for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), bit)


def segments_for(codes: int, bits: int = BITS) -> int:
    """The number of segments: about log2(codes) bits each, of equal width."""
    wanted = max(1, round(bits / max(1.0, math.log2(max(2, codes)))))
    return next(m for m in range(wanted, bits + 1) if bits % m == 0)


def _segment(code: Column, i: int, width: int) -> Column:
    return F.shiftright(code, i * width).bitwiseAND(F.lit((1 << width) - 1))


def _first_ids(seen: DataFrame, k: int) -> DataFrame:
    """The k ids of each query that come first by (least distance, id), and their ranks."""
    each = seen.groupBy("q", "id").agg(F.min("distance").alias("distance"))
    return each.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).where(F.col("nth") <= k)


def _search(wanted: DataFrame, codes: DataFrame, m: int, k: int, bits: int, tables: Scratch) -> DataFrame:
    """q, id, distance, nth: the nearest ids of each query, by steps over m segments.

    A step that would need more than MASKS keys a query isn't made: the queries still active
    start over with more segments, whose steps need fewer.
    """
    width = bits // m
    index = tables.stored(reduce(DataFrame.unionByName, [codes.select(F.lit(i).alias("segment"), _segment(F.col("code"), i, width).alias("key"), "code", "ids") for i in range(m)]), "index")
    best, active = None, wanted
    for radius, i in product(range(width + 1), range(m)):
        if math.comb(width, radius) > MASKS:
            finer = next(more for more in range(m + 1, bits + 1) if bits % more == 0)
            rest = _search(active, codes, finer, k, bits, tables)
            return rest if best is None else rest.unionByName(best.join(active, "q", "left_anti"))
        # one constant array, at most MASKS long
        masks = F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(width), radius))), ",").cast("array<long>")
        probes = active.select("q", F.explode(masks).alias("mask")).select("q", _segment(F.col("q"), i, width).bitwiseXOR(F.col("mask")).alias("key"))
        both = F.col("q").bitwiseXOR(F.col("code"))
        # a pair counts in the step that sees it first
        first = reduce(lambda x, y: x & y, [F.bit_count(_segment(both, j, width)) >= (radius + 1 if j < i else radius) for j in range(m) if j != i], F.lit(True))
        # Spark takes the exploded probes for no larger than the queries, and would broadcast them
        seen = probes.hint("merge").join(index.where(F.col("segment") == i), "key").where(first).select("q", F.explode("ids").alias("id"), F.bit_count(both).alias("distance"))
        best = tables.stored(_first_ids(seen if best is None else seen.unionByName(best.select("q", "id", "distance")), k), "best")
        kth = best.where(F.col("nth") == k).select("q", F.col("distance").alias("kth"))
        active = tables.stored(wanted.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > m * radius + i)).select("q"), "active")
        if active.isEmpty():
            break
    return best


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """query_id, rank, id, distance: the k rows nearest to each query; both have (id, code)."""
    every = rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).dropna().distinct()
    own = every.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    tables = Scratch()
    codes = tables.stored(own.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")  # k at most
    asked = stored(queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("q")).dropna().distinct(), "asked")
    wanted = tables.stored(asked.select("q").distinct(), "wanted")
    best = stored(_search(wanted, codes, segments_for(codes.count(), bits), k, bits, tables), "nearest")
    tables.clear()
    near = asked.join(best.select("q", "id", "distance"), "q").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
