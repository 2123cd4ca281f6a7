"""Importance resampling towards a target text: hashed n-grams of both sides, a gain for each bucket, and a weighted draw.

Words are exploded with their positions, and window functions put the following words beside each one, which gives the n-grams of every
order. Their buckets are written once, a row a word; corpus counts, gains and sums over documents all come from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: the ASCII characters that are neither digits nor small letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def word_buckets(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(row, doc_id, b1, b2, ...) a word: the buckets of the n-grams of each order that start there, null where the text ends before.

    A text without words keeps one row of nulls. Texts are dealt by row before they are exploded, so that the windows find every
    text in one partition already and no word is shuffled.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.repartition(parts, "row").select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    order = Window.partitionBy("row").orderBy("pos")
    near = placed.select("row", "doc_id", "word", *[F.lead("word", k).over(order).alias(f"w{k}") for k in range(1, orders)])
    grams = [F.col("word")]
    for k in range(1, orders):
        grams.append(F.when(F.col(f"w{k}").isNotNull(), F.concat(grams[-1], F.lit(" "), F.col(f"w{k}"))))
    return near.select("row", "doc_id", *[(F.crc32(g) % buckets).cast("int").alias(f"b{k + 1}") for k, g in enumerate(grams)])


def numbered(texts: DataFrame, *, with_id: bool) -> DataFrame:
    """(row, doc_id, text): rows get numbers of their own, so null and repeated ids do no harm."""
    return texts.select(F.monotonically_increasing_id().alias("row"), (F.col("doc_id") if with_id else F.lit(None)).cast("long").alias("doc_id"), "text")


def counts(placed: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): features in each bucket, at most as many rows as there are buckets."""
    each = placed.select(F.explode(F.array(*[f"b{k + 1}" for k in range(orders)])).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that own (bucket, s) has, for target (bucket, t)."""
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    every = Window.partitionBy(F.lit(0))
    both = own.join(target, "bucket", "full").select("bucket", s.cast("double").alias("s"), t.cast("double").alias("t"))
    both = both.select("bucket", "s", "t", F.sum("s").over(every).alias("all_s"), F.sum("t").over(every).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number for an id, times a thousand and floored: the same for the same id and seed on every engine."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, share: int) -> DataFrame:
    """scored (row, doc_id, n_words, n_features, weight, score, drawable) with rank: 1, 2, 3 ... of those drawn, else null.

    The order is global, but no task sees more than a range of it: ranges are written, counted, and numbered behind the counts of
    the ranges before them.
    """
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    # A row a range, and there are as many ranges as shuffle partitions.
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.count_if("drawable").alias("drawable"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.floor(F.sum("drawable").over(every) * share / 100).alias("take"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    placed = ranges.withColumn("place", place).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("place")
    return placed.withColumn("rank", F.when(F.col("drawable") & (rank <= F.col("take")), rank)).drop("part", "place", "start", "take")


def resample(docs: DataFrame, target: DataFrame, orders: int = 3, buckets: int = 10_000, share: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn towards target (text).

    Null and empty texts have no features and weight 0; they are never drawn, as no text of fewer than least_words words is. Among
    equal scores the smaller doc_id comes first, null ids last (their noise is that of an empty id); repeated rows are scored and
    drawn each on its own; other columns are ignored; an empty table gives no rows, an empty target gives gains all the same.
    """
    placed = materialise(word_buckets(numbered(docs, with_id=True), orders, buckets), "buckets")
    aimed = counts(word_buckets(numbered(target, with_id=False), orders, buckets), orders, "t")
    # At most a row a bucket.
    gain = F.broadcast(materialise(gains(counts(placed, orders, "s"), aimed, buckets), "gains"))
    names = [f"b{k + 1}" for k in range(orders)]
    rows = placed
    for b in names:
        rows = rows.join(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}")), b, "left")
    zero = F.lit(0).cast("long")
    sums = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("b1").alias("n_words"), *[F.count(b).alias(f"n_{b}") for b in names], *[F.sum(f"g_{b}").alias(f"s_{b}") for b in names]
    )
    n_features, weight = zero, zero
    for b in names:
        n_features, weight = n_features + F.col(f"n_{b}"), weight + F.coalesce(f"s_{b}", zero)
    scored = sums.select("row", "doc_id", n_features.alias("n_features"), weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("drawable"))
    return ranked(scored, share).select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql(orders: int = 3, buckets: int = 10_000, share: int = 5, seed: int = 42, least_words: int = 20) -> str:
    """The same in DuckDB SQL. It has no checksum function: the 256 steps of the polynomial are made by its rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    table = "list_transform(range(0, 256), b -> list_reduce(list_prepend(b::BIGINT, range(0, 8)), lambda c, i: " + step + "))"
    table = table.replace("b ->", "lambda b:")
    octets = "list_transform(range(0, octet_length(encode(gram))), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)"
    grams = ["word"] + [" || ' ' || ".join(["word", *[f"lead(word, {j}) OVER t" for j in range(1, k + 1)]]) for k in range(1, orders)]
    tokens = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '')"
    every = " UNION ALL ".join(f"SELECT side, doc_id, {g} AS gram FROM words WINDOW t AS (PARTITION BY side, doc_id ORDER BY pos)" for g in grams)
    return f"""
    WITH steps AS (SELECT {table} AS poly),
    texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
    split AS (SELECT side, doc_id, {tokens} AS ws FROM texts),
    words AS (SELECT side, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
    grams AS (SELECT side, doc_id, gram, count(*) AS n FROM ({every}) WHERE gram IS NOT NULL GROUP BY ALL),
    keyed AS (SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, poly[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket
      FROM (SELECT DISTINCT gram FROM grams), steps),
    counted AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM grams JOIN keyed USING (gram) GROUP BY 1),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {buckets}) / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM counted),
    summed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM grams JOIN keyed USING (gram) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
    scored AS (SELECT d.doc_id, len(ws) >= {least_words} AS drawable, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM split d LEFT JOIN summed s ON s.doc_id = d.doc_id WHERE d.side = 0),
    placed AS (SELECT *, row_number() OVER (ORDER BY drawable DESC, score DESC, doc_id) AS place, {share} * (count(*) FILTER (WHERE drawable) OVER ()) // 100 AS take FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN drawable AND place <= take THEN place END AS rank FROM placed
    """
