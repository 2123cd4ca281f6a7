"""I-Match fingerprints, with DataFrame functions only.

Of each text the distinct terms whose document frequency lies in a band are kept, sorted, and hashed once for each of several
randomised lexicon subsets. A subset takes one in 4, 16, 64 or 256 terms, so that texts of any length have subsets of a few terms; two
texts are alike in the share of subsets, among those that hold a term of either, whose hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import materialise

#: Share of documents that a term of the lexicon occurs in, at least and at most: idf between ln(1/MOST) and ln(1/LEAST).
LEAST, MOST = 0.0005, 0.02
#: One in how many terms each randomised subset takes.
SUBSETS = [4] * 4 + [16] * 6 + [64] * 10 + [256] * 20
#: What a subset without terms of the text has: the hash of nothing.
NONE = "d41d8cd9"
#: Rows of a bucket of ascending ids, about; broadcast limits, in rows. A bucket of over CROWDED times as many rows is divided by PARTS.
BUCKET, MOST_HEADS, MOST_TERMS, CROWDED, PARTS = 4000, 200_000, 4_000_000, 4, 1024


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")), "")


def lexicon(texts: DataFrame, total: int) -> DataFrame:
    """(term, mask) of the terms in the band; bit j of mask says whether subset j takes the term.

    The empty term with mask 0 is always there. The sum of document frequencies is at most the number of distinct terms of all
    documents, so the lexicon has at most (mean distinct terms a document) / LEAST terms, whatever the number of documents.
    """
    frequency = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = frequency.where((F.col("df") >= F.greatest(F.lit(2.0), F.lit(LEAST * total))) & (F.col("df") <= F.greatest(F.lit(2.0), F.lit(MOST * total)))).select("term")
    return band.union(texts.sparkSession.createDataFrame([("",)], "term string")).select("term", mask().alias("mask"))


def mask() -> Column:
    draw = [F.conv(F.substring(F.md5(F.concat(F.col("term"), F.lit(f":{j}"))), 1, 4), 16, 10).cast("long") % n == 0 for j, n in enumerate(SUBSETS)]
    bits = [F.when(d, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, d in enumerate(draw)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return F.when(F.col("term") == "", F.lit(0).cast("long")).otherwise(total)


def fingerprint(kept: Column, whole: Column) -> Column:
    """Eight hexadecimal digits a subset: of its sorted terms' hash, or NONE. kept: (term, mask) structs; whole: of all terms.

    A text without any term in the band is told by the hash of all its terms instead.
    """
    def subset(bit: Column) -> Column:
        chosen = F.transform(F.filter(kept, lambda t: t["mask"].bitwiseAND(bit) != 0), lambda t: t["term"])
        return F.substring(F.md5(F.array_join(chosen, " ")), 1, 8)

    parts = F.transform(F.array(*[F.lit(1 << j).cast("long") for j in range(len(SUBSETS))]), subset)
    return F.when(F.size(kept) == 0, F.repeat(F.substring(whole, 1, 8), len(SUBSETS))).otherwise(F.array_join(parts, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those that hold a term of either text; 0 if there are none and the prints differ."""
    def at(x: Column, j: Column) -> Column:
        return F.substr(x, j * 8 + 1, F.lit(8))

    every = F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1))
    used = F.size(F.filter(every, lambda j: (at(a, j) != NONE) | (at(b, j) != NONE)))
    same = F.size(F.filter(every, lambda j: (at(a, j) != NONE) & (at(a, j) == at(b, j))))
    return F.when(a == b, F.lit(1.0)).when(used == 0, F.lit(0.0)).otherwise(same / used)


def with_buckets(rows: DataFrame, width: int, divided: list[tuple[DataFrame, int]]) -> DataFrame:
    """rows with `bucket`: the first id of the range that doc_id lies in, of `width` ids or, in divided ranges, fewer. Widths are powers of two."""

    def first(ids: int) -> Column:
        return F.col("doc_id") - F.pmod(F.col("doc_id"), F.lit(ids))

    rows = rows.withColumn("bucket", first(width))
    for crowded, parts in divided:
        # At most MOST_HEADS rows.
        rows = rows.join(F.broadcast(crowded), "bucket", "left").withColumn("bucket", F.when(F.col("_crowded"), first(parts)).otherwise(F.col("bucket"))).drop("_crowded")
    return rows


def divisions(ids: DataFrame, total: int, width: int) -> list[tuple[DataFrame, int]]:
    """[(crowded buckets, width of their parts)] from coarse to fine: however ids are spread, buckets hold about equally few rows.

    Only rows that repeat one id are never divided. Usually no bucket is crowded, and ids are counted once.
    """
    out: list[tuple[DataFrame, int]] = []
    parts = width
    while parts > 1:
        sizes = with_buckets(ids, width, out).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        crowded = sizes.where(F.col("rows") > max(CROWDED * BUCKET, total // MOST_HEADS)).select("bucket", F.lit(True).alias("_crowded"))
        crowded = materialise(crowded, "crowded-ids")
        if crowded.isEmpty():
            break
        parts = max(1, parts // PARTS)
        out.append((crowded, parts))
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, rn, ghost, doc_id, text, next_text) of every row, in buckets of ascending ids.

    Each bucket also holds the first row of the next one as a ghost, the last bucket that of the first. So neighbours meet without
    a task that sees all rows. Rows with a null id have no next row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    total, low, high = ids.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    heads_most = max(1, -(-total // BUCKET))
    width = 1 << min(62, (((high or 0) - (low or 0)) // heads_most).bit_length())
    divided = divisions(ids, total, width)
    rows = with_buckets(rows, width, divided).withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("text"), F.lit(heads_most))))
    heads = materialise(with_buckets(ids, width, divided).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")), "bucket-heads")
    few = heads.count() <= MOST_HEADS
    # A row a bucket, BUCKET times fewer than documents.
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    heads = heads.select("doc_id", before.alias("bucket"))
    heads = F.broadcast(heads) if few else heads
    ghosts = rows.drop("bucket").join(heads, "doc_id").select("doc_id", "text", "bucket", F.lit(1).alias("ghost"))
    every = rows.select("doc_id", "text", "bucket", F.lit(0).alias("ghost")).union(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", F.xxhash64("text"))
    return every.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)))


def imatch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs (doc_id, text).

    Null texts are empty; a row with a null id has no next document (its edited text loses its last half, near_next is 0); among
    repeated ids the hash of the text decides the order; other columns are ignored; an empty table gives no rows.
    """
    total = docs.count()
    words = lexicon(docs.select("text"), total)
    if total and 1 / LEAST <= MOST_TERMS:
        words = F.broadcast(words)
    half = F.floor(F.col("n_chars") / 2)
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half.cast("int")))
    rows = rows.withColumn("edited", edited)
    about = ["bucket", "rn", "ghost", "doc_id", "n_chars"]
    rows = rows.select(*about, F.sha2("edited", 256).alias("edited_sha256"), F.array(terms(F.col("text")), terms(F.col("edited"))).alias("both"))

    def told(terms_: Column) -> Column:
        return F.struct(F.md5(F.array_join(F.sort_array(terms_), " ")).alias("whole"), F.array_append(terms_, F.lit("")).alias("terms"))

    sides = rows.select(*about, "edited_sha256", F.posexplode(F.transform("both", told)).alias("side", "x"))
    each = sides.select(*about, "edited_sha256", "side", "x.whole", F.explode("x.terms").alias("term"))
    hits = each.join(words, "term").groupBy("bucket", "rn", "side").agg(*[F.first(c).alias(c) for c in [*about[2:], "edited_sha256", "whole"]], F.sort_array(F.filter(F.collect_list(F.struct("term", "mask")), lambda t: t["term"] != "")).alias("kept"))
    prints = hits.withColumn("print", fingerprint(F.col("kept"), F.col("whole")))
    pairs = prints.groupBy("bucket", "rn").agg(*[F.first(c).alias(c) for c in [*about[2:], "edited_sha256"]], F.max(F.when(F.col("side") == 0, F.col("print"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("print"))).alias("edited_fingerprint"))
    following = F.when(F.col("doc_id").isNotNull(), F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn")))
    done = pairs.withColumn("following", following).where("ghost = 0")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), F.coalesce(likeness(F.col("fingerprint"), F.col("following")), F.lit(0.0)).alias("near_next"))


def imatch_sql() -> str:
    """The same in DuckDB SQL."""
    bits = " + ".join(f"CASE WHEN ('0x' || md5(term || ':{j}')[1:4])::INT % {n} = 0 THEN {1 << j}::BIGINT ELSE 0 END" for j, n in enumerate(SUBSETS))

    def prints(j: int) -> str:
        chosen = f"list_sort(list(term) FILTER (WHERE (mask & {1 << j}::BIGINT) <> 0))"
        return f"coalesce(md5(array_to_string({chosen}, ' '))[1:8], '{NONE}')"

    def alike(a: str, b: str) -> str:
        def at(x: str) -> str:
            return f"substr({x}, j * 8 + 1, 8)"

        every = f"range(0, {len(SUBSETS)})"
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce(len(list_filter({every}, lambda j: {at(a)} <> '{NONE}' AND {at(a)} = {at(b)}))::DOUBLE / nullif(len(list_filter({every}, lambda j: {at(a)} <> '{NONE}' OR {at(b)} <> '{NONE}')), 0), 0.0::DOUBLE) END"

    return f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS nx FROM documents),
    wrapped AS (SELECT doc_id, text, n_chars, coalesce(nx, (SELECT coalesce(text, '') FROM documents ORDER BY doc_id LIMIT 1)) AS nx FROM base),
    texts AS (SELECT doc_id, n_chars, text, substr(text, 1, n_chars - n_chars // 2) || substr(nx, 1, n_chars // 2) AS edited FROM wrapped),
    sides AS (SELECT doc_id, 0 AS side, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS terms FROM texts
      UNION ALL SELECT doc_id, 1, list_distinct(regexp_extract_all(lower(edited), '[\\p{{L}}\\p{{N}}]+')) FROM texts),
    freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM sides WHERE side = 0) GROUP BY term),
    n AS (SELECT count(*) AS n FROM documents),
    lex AS (SELECT term, {bits} AS mask FROM freq, n WHERE df >= greatest(2.0, {LEAST} * n) AND df <= greatest(2.0, {MOST} * n)),
    words AS (SELECT doc_id, side, unnest(terms) AS term FROM sides),
    kept AS (SELECT doc_id, side, {" || ".join(prints(j) for j in range(len(SUBSETS)))} AS print FROM words JOIN lex USING (term) GROUP BY doc_id, side),
    prints AS (SELECT doc_id, side, coalesce(print, repeat(md5(array_to_string(list_sort(terms), ' '))[1:8], {len(SUBSETS)})) AS print FROM sides LEFT JOIN kept USING (doc_id, side)),
    pairs AS (SELECT doc_id, max(print) FILTER (WHERE side = 0) AS fingerprint, max(print) FILTER (WHERE side = 1) AS edited_fingerprint FROM prints GROUP BY doc_id),
    followed AS (SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY doc_id), first_value(fingerprint) OVER (ORDER BY doc_id)) AS following FROM pairs)
    SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {alike("fingerprint", "edited_fingerprint")} AS near_edited, {alike("fingerprint", "following")} AS near_next
    FROM followed JOIN texts USING (doc_id)
    """
