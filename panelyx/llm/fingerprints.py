"""Document fingerprints by winnowing: k-gram hashes, the minimum of each window (rightmost of ties), positions kept.

Units are what lies between white space; characters of scripts that write no spaces are units of their own. A k-gram is
`K` = 5 consecutive units. Its hash is the rolling one of Karp and Rabin: the units' hashes u are the digits of a number
to the base BASE modulo the prime PRIME, so that gram(i + 1) = (gram(i) - u(i) BASE^(K-1)) BASE + u(i + K). A DataFrame
expression carries no running value along an array, so the same numbers are made for all positions at once by doubling:
the gram of 2n units from two neighbours of n, one multiplication each, instead of hashing K units anew. Of every window
of `W` = 4 consecutive k-grams the smallest hash is kept with its position, the rightmost one of equal hashes. Hence any
passage of W + K - 1 = 8 equal units in two texts leaves an equal mark in both. Texts of fewer than K units have the one
k-gram of all their units, texts of fewer than W k-grams one window. An empty or null text has no marks. Likeness of two
fingerprints: Jaccard of their sets of hashes; two without marks are alike (1.0).

A mark is one long: 31 bits of hash, then 2^31 - 1 - position, so that least() finds the smallest hash and, among equal
ones, the rightmost position; a position fits, as no text has 2^31 units.

Everything is a DataFrame expression. The next document in ascending id order comes without a global sort: ids fall
into at most SPLITS ranges by approximate percentiles, each cut evenly into buckets of about BUCKET_ROWS rows; a window
over each bucket finds the next row, and the first row of each bucket is also sent to the bucket before as a sentinel.
So the texts are shuffled once. Rows of one id are ordered by the hash of their text, then by text; those of an id that
is frequent (it stands at several percentiles), or of none, are cut into 2^HOT_BITS buckets by that hash. Null ids come
first; the only document is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, W = 5, 4
#: The prime 2^31 - 1 and a base below it: products stay below 2^62.
PRIME, BASE = 2147483647, 1103515245
#: Code points of scripts that put no spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han), as ranges: asking for
#: the script of every character is many times slower. No smaller code point is among them.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
HIGH = r"[\x{0E00}-\x{323AF}]"
SPLITS, BUCKET_ROWS, HOT_BITS = 64, 512, 10


def units_of(text: Column) -> Column:
    """The units of a text; without a white space or a character of UNSPACED the text is one unit."""
    cut = F.when(F.regexp_like(text, F.lit(HIGH)) & F.regexp_like(text, F.lit(UNSPACED)), F.split(text, rf"\s+|(?<={UNSPACED})|(?={UNSPACED})")).otherwise(F.split(text, r"\s+"))
    return F.transform(cut, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))


def with_grams(df: DataFrame, units: str, out: str, k: int = K) -> DataFrame:
    """Adds `out`: the rolling hash of the k units from each position on (units past the end count as 0)."""
    made, of, n = [f"{out}_1"], {1: f"{out}_1"}, 1
    df = df.withColumn(of[1], F.expr(f"concat({units}, array_repeat(0L, {k - 1}))"))
    # Positions from which not all units lie inside the padded array give null and are cut off at the end.
    join = lambda left, right, at, size: f"transform({left}, (x, i) -> (x * {pow(BASE, size, PRIME)}L + get({right}, i + {at})) % {PRIME}L)"
    while 2 * n <= k:  # grams of 2, 4, 8, ... units
        of[2 * n] = f"{out}_{2 * n}"
        made.append(of[2 * n])
        df = df.withColumn(of[2 * n], F.expr(join(of[n], of[n], n, n)))
        n *= 2
    have, name = n, of[n]
    while have < k:  # the rest by the binary digits of k
        n = max(x for x in of if x <= k - have)
        made.append(f"{out}_and_{have + n}")
        df = df.withColumn(made[-1], F.expr(join(name, of[n], have, n)))
        have, name = have + n, made[-1]
    return df.withColumn(out, F.expr(f"slice({name}, 1, greatest(size({units}) - {k - 1}, 1))")).drop(*made)


def with_marks(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds `out`, array<bigint>: the marks of column `text` in order of position."""
    units, grams = f"{out}_units", f"{out}_grams"
    least = ", ".join(f"get({grams}, i + {j})" for j in range(1, w))
    df = with_grams(df.withColumn(units, units_of(F.coalesce(text, F.lit("")))), units, grams, k)
    return (
        df.withColumn(grams, F.expr(f"transform({grams}, (x, i) -> shiftleft(x, 31) | (2147483647L - i))"))
        .withColumn(out, F.expr(f"if(coalesce({text}, '') = '', array(), array_distinct(transform(slice({grams}, 1, greatest(size({grams}) - {w - 1}, 1)), (x, i) -> least(x, {least}))))"))
        .drop(units, grams)
    )


def positions(marks: Column) -> Column:
    """Unit positions of marks."""
    return F.transform(marks, lambda v: F.lit(2147483647).cast("long") - v.bitwiseAND(F.lit(2147483647)))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda v: F.shiftright(v, 31)))


def likeness(a: str, b: str) -> Column:
    """Jaccard of two columns that hold arrays of distinct hashes."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / CAST(greatest(size({a}) + size({b}) - size(array_intersect({a}, {b})), 1) AS DOUBLE))")


def digest(marks: str) -> Column:
    return F.md5(F.array_join(F.col(marks).cast("array<string>"), ",").cast("binary"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Adds next_text: the text of the following document, after the last that of the first."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    lo, hi, n, found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.percentile_approx("doc_id", [i / SPLITS for i in range(1, SPLITS)], 10_000)).first()
    cuts = sorted(set(found or []))
    hot = [c for c in cuts if found.count(c) > 1]  # an id that holds a share of the rows stands at several percentiles
    edges = [*(c for c in cuts if c > lo), hi] if cuts else []
    none = F.col("doc_id").isNull()
    if cuts:
        starts = [lo, *(c + 1 for c in edges[:-1])]
        per = max(1, -(-n // max(1, len(edges))) // BUCKET_ROWS)
        table_ = F.array(*[F.lit(int(c)) for c in edges[:-1]])
        s = F.size(F.filter(table_, lambda c: c < F.col("doc_id"))) if len(edges) > 1 else F.lit(0)
        start, width = (F.array(*[F.lit(int(v)) for v in x]) for x in (starts, [max(1, -(-(b - a + 1) // per)) for a, b in zip(starts, edges, strict=True)]))
        docs_b = docs.withColumn("s", F.when(none, -1).otherwise(s)).withColumn(
            "b", F.when(F.col("s") < 0, 0).otherwise(F.floor((F.col("doc_id") - F.get(start, F.col("s"))) / F.get(width, F.col("s")))).cast("long")
        )
    else:
        docs_b = docs.withColumns({"s": F.lit(-1), "b": F.lit(0).cast("long")})
    # The rows of a frequent id, or of none, are cut by the hashes of their texts; the ids before and behind it stay apart.
    one = F.coalesce(F.col("doc_id").isin(hot), F.lit(False)) if hot else F.lit(False)
    below = sum(((F.col("doc_id") > c).cast("int") for c in hot), F.lit(0))
    docs_b = docs_b.withColumn("p", F.coalesce(2 * below + one.cast("int"), F.lit(0)))
    docs_b = docs_b.withColumn("c", F.when(none | one, F.shiftright("h", 64 - HOT_BITS)).otherwise(0).cast("int"))
    place = ["s", "b", "p", "c"]
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("first")
    buckets = docs_b.groupBy(*place).agg(first).select(*place, F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    # The bucket before: in the same range, else the last of the range before, else (for the first of all) the last of all.
    at = F.struct(*place)
    ranges = buckets.groupBy("s").agg(F.max(at).alias("range_end"))  # at most SPLITS + 1 rows
    order = Window.orderBy("s")
    whole = Window.partitionBy(F.lit(1))
    ranges = ranges.select("s", F.coalesce(F.lag("range_end").over(order), F.max("range_end").over(whole)).alias("before"))
    inner = F.lag(at).over(Window.partitionBy("s").orderBy(*place[1:]))
    sent = buckets.select("s", "first_id", "first_h", inner.alias("prev")).join(ranges, "s").select("first_id", "first_h", F.coalesce("prev", "before").alias("prev"))
    sentinels = docs.join(sent, docs.doc_id.eqNullSafe(sent.first_id) & (docs.h == sent.first_h)).select("doc_id", "h", "text", *(F.col(f"prev.{x}").alias(x) for x in place))
    sentinels = sentinels.dropDuplicates([*place, "doc_id", "h"]).withColumn("sentinel", F.lit(1))  # equal rows need one
    every = docs_b.select("doc_id", "h", "text", *place, F.lit(0).alias("sentinel")).unionByName(sentinels)
    ahead = F.lead("text").over(Window.partitionBy(*place).orderBy("sentinel", "doc_id", "h", "text"))
    return every.withColumn("next_text", ahead).filter("sentinel = 0").select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row each: sizes, marks of the text, of its edited text and of the next document's text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    for text, out in (("text", "marks"), ("edited", "edited_marks"), ("next_text", "next_marks")):
        df = with_marks(df, text, out)
    return df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprint_documents(table(spark, sf_dir, "documents"))
    df = df.withColumns({"a": hashes(F.col("marks")), "e": hashes(F.col("edited_marks")), "x": hashes(F.col("next_marks"))})
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest("marks").alias("fingerprint"),
        digest("edited_marks").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"),
        likeness("a", "x").alias("near_next"),
        F.size("marks").cast("long").alias("n_marks"),
    )
