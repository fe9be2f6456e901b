"""Line dedup: an exact set-similarity join of lines, in DataFrame operations alone.

A line's tokens are what spaces separate (other white space counts as a space). Lines without tokens are never compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, frozen, release

#: Similarity, as a fraction: 100 * intersection >= 80 * union.
SIMILAR = (80, 100)
#: Counters of token frequencies, eight bytes each.
COUNTERS = 1 << 18
#: Bytes of a table that may be broadcast, by its rows; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Parts in which prefix tokens are joined, so that only one part's rows are on disk at a time; fewer than SLICE_ROWS are one part.
SLICES, SLICE_ROWS = 5, 1_000_000
#: The largest rarity code: it stays below the sign of a number.
MOST_CODE = 127
#: White space inside lines, other than the space.
WHITE = ("\t", "\x0b", "\f", "\r")


def spaced(text: Column) -> Column:
    """The text with spaces for other white space inside lines. Few texts have any: the rest are passed on as they are."""
    other = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in WHITE])
    return F.when(other, F.translate(text, "".join(WHITE), " " * len(WHITE))).otherwise(text)


def _token_hashes(body: Column) -> Column:
    """Hashes of the distinct tokens of a spaced line."""
    return F.array_except(F.transform(F.split(body, " ", -1), lambda t: F.xxhash64(t)), F.array(F.xxhash64(F.lit(""))))


def _counter(token_hash: Column) -> Column:
    return token_hash.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def trimmed_lines(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    """Lines with tokens: the other columns, line (from 0) and body."""
    lines = docs.select(*others, spaced(F.col(text)).alias("spaced")).select(*[c for c in docs.select(*others).columns], F.posexplode(F.split("spaced", "\n", -1)).alias("line", "whole"))
    return lines.withColumn("body", F.trim("whole")).drop("whole").where("body != ''")


def rarity_codes(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (codes array<long>): the logarithm of each counter's tokens in all texts, in the highest byte of a number.

    It orders tokens by how often they occur; tokens with one counter share a code. Its size is the same for any input.
    """
    words = docs.select(F.explode(F.split(F.replace(spaced(F.col(text)), F.lit("\n"), F.lit(" ")), " ", -1)).alias("w")).where("w != ''")
    counts = words.groupBy(_counter(F.xxhash64("w")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    code = F.least(F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1) * 2.5), F.lit(MOST_CODE)).cast("long")
    every = docs.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("c")).join(counts, "c", "left").select("c", F.shiftleft(code, 56).alias("code"))
    # as many rows as there are counters: parts of 1,024 in order, then the parts in order
    parts = every.groupBy(F.shiftright("c", 10).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "code"))), lambda x: x["code"]).alias("codes"))
    return frozen(parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "codes"))), lambda x: x["codes"])).alias("codes")))


def with_token_keys(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """lines with ``keys`` for ``body``: its distinct tokens as numbers, the rarest first (rarity code, 56 bits of hash)."""

    def key(h: Column) -> Column:
        # never null, and said to be so: the array's type then has no nulls
        return F.coalesce(F.col("codes")[h.bitwiseAND(F.lit(COUNTERS - 1))].bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))

    # the codes are one value of the plan (a scalar subquery), not a column that rows carry: the optimizer puts it in place
    return lines.withColumn("codes", codes.scalar()).withColumn("keys", F.sort_array(F.transform(_token_hashes(F.col("body")), key))).drop("body", "codes")


def _parities(keys: str, odd: bool = False) -> Column:
    """A bitmap: for each value of six bits of a token's hash, whether the number of tokens that have it is odd.

    With ``odd``, only tokens whose seventh bit is set count: both bitmaps together tell parities of all seven bits.
    """

    values = 128 if odd else 64
    # looked up: fewer operations within an array's function, which isn't compiled
    bit = F.array(*[F.lit(0 if odd and i < 64 else (1 << i % 64) - ((1 << 64) if i % 64 == 63 else 0)).cast("long") for i in range(values)])
    return F.coalesce(F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit[k.bitwiseAND(F.lit(values - 1))])), F.lit(0).cast("long"))


def _could_match(a: str, b: str, similar: tuple[int, int]) -> Column:
    """Bitmap, positional and length filters on two different classes that share a prefix token.

    Bitmaps of parities, 128 bits in all, differ in no more places than the lines differ in tokens. Of all tokens they
    share, the first in order passes the positional filter if they are similar; as no more tokens are left than a line
    has, it is a filter on lengths too. All in whole numbers: similar lines share at least part / (part + whole) of n + n2.
    """
    part, whole = similar
    (n, pos), (n2, pos2) = [(F.shiftright(f"{x}.at", 32), F.col(f"{x}.at").bitwiseAND(F.lit((1 << 32) - 1))) for x in (a, b)]
    bits, odd = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("bits", "odd")]
    differ = F.bit_count(odd) + F.bit_count(bits.bitwiseXOR(odd))
    near = differ * (part + whole) <= (n + n2) * (whole - part)
    left = F.least(n - pos, n2 - pos2) * (part + whole) >= (n + n2) * part
    other = (F.col(f"{a}.cls") != F.col(f"{b}.cls")) | (bits != 0)
    return (F.col(f"{a}.token") == F.col(f"{b}.token")) & near & left & other


def _sized(ids: DataFrame, row_bytes: int | Column) -> DataFrame:
    """The table, to be broadcast if its rows are small in all: their number and width are measured."""
    held = ids.agg(F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(ids) if held <= BROADCAST_BYTES else ids


def document(key: str, text: str) -> Column:
    """A row's identity: a hash of its key and its text. Rows with one key and different texts are documents of their own."""
    return F.xxhash64(key, text)


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc, lines): the numbers, from 0, of each ``document``'s lines that match an earlier line; without lines, no row.

    Lines match if the Jaccard similarity of their sets of tokens is at least ``similar``; (key, document, number) is their
    order, null keys first. Rows with one key and one text are one document here.
    """
    spark = docs.sparkSession
    codes = rarity_codes(docs, text)
    written = Written(spark)
    lines = written(_described(docs, key, text, codes, similar))
    release(spark)
    # combined before they are shuffled: a line that is everywhere arrives as a few rows a task
    classes = lines.groupBy("cls", "bits", "odd", "n").agg(F.min(F.struct("key", "doc", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"))
    classes = written(classes)
    release(spark)
    gone = _with_earlier_match(docs, key, text, codes, classes, similar, written).withColumn("gone", F.lit(True))
    judged = classes.select("cls", "bits", "first", "copies").join(gone, ["cls", "bits"], "left").where("copies > 1 or gone").select("cls", "bits", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = lines.select("doc", "line", "cls", "bits").join(judged, ["cls", "bits"]).where(F.col("gone") | (F.col("doc") != F.col("first.doc")) | (F.col("line") != F.col("first.line")))
    out = frozen(out.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    del classes, lines, gone, judged
    written.drop()
    release(spark)
    return out


def _described(docs: DataFrame, key: str, text: str, codes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Lines (key, doc, line), a class for each set of tokens (cls, bits: 128 bits of the set; odd), its size n and its prefix.

    A prefix has 31 bits of each token's hash: different tokens that share them only make more candidates.
    """
    part, whole = similar
    size = F.size("keys")
    longest = size - F.ceil(size * part / F.lit(float(whole)) - 1e-9).cast("int") + 1
    return with_token_keys(trimmed_lines(docs, text, F.col(key).alias("key"), document(key, text).alias("doc")), codes).select(
        "key", "doc", "line", F.xxhash64("keys").alias("cls"), size.alias("n"),
        F.transform(F.slice("keys", 1, longest), lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"),
        _parities("keys").alias("bits"), _parities("keys", odd=True).alias("odd"),
    )


def _with_earlier_match(docs: DataFrame, key: str, text: str, codes: DataFrame, classes: DataFrame, similar: tuple[int, int], written: Written) -> DataFrame:
    """(cls, bits): classes that match one that occurs first at an earlier place.

    Pairs are never made: a semi-join keeps, of each token's classes, those that could match any other one there; a second
    one, over those alone, those that could at the first token they share; a third one, with their sets, those that do
    match an earlier one.
    """
    part, whole = similar
    spark = docs.sparkSession
    posted = classes.select("cls", "bits", "odd", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "cls", "bits", "odd", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))

    slices, halves = (SLICES, 2) if (classes.agg(F.sum(F.size("prefix"))).first()[0] or 0) > SLICE_ROWS else (1, 1)

    def candidates(i: int) -> DataFrame:
        rows = posted.where(F.pmod("token", F.lit(slices)) == i)
        return written(rows.alias("a").join(rows.alias("b"), _could_match("a", "b", similar), "left_semi"))

    def first_shared(i: int) -> DataFrame:
        # two lines meet at each prefix token that they share; the first is enough. The cheap conditions come first
        before = F.slice("prefix", 1, F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("before")
        rows = met.where(F.pmod("token", F.lit(halves)) == i).join(classes.select("cls", "bits", "prefix"), ["cls", "bits"]).select("token", "cls", "bits", "odd", "at", before)
        first = _could_match("a", "b", similar) & ~F.arrays_overlap("a.before", "b.before")
        return written(rows.alias("a").join(rows.alias("b"), first, "left_semi").select("token", "cls", "bits", "odd", "at"))

    def matched(i: int) -> DataFrame:
        # in one order of columns, so that one shuffle serves both sides
        rows = close.where(F.pmod("token", F.lit(halves)) == i).join(sets, ["cls", "bits"]).select("token", "cls", "bits", "odd", "at", "first", "keys")
        both = F.size(F.array_intersect("a.keys", "b.keys"))
        match = both * whole >= (F.size("a.keys") + F.size("b.keys") - both) * part
        earlier = _could_match("a", "b", similar) & (F.col("b.first") < F.col("a.first"))
        return written(rows.alias("a").join(rows.alias("b"), earlier & match, "left_semi").select("cls", "bits").distinct())

    met = reduce(DataFrame.unionByName, _one_by_one(spark, candidates, slices))
    close = reduce(DataFrame.unionByName, _one_by_one(spark, first_shared, halves))
    sets = written(_token_sets(docs, key, text, codes, classes.join(close.select("cls", "bits").distinct(), ["cls", "bits"], "left_semi")))
    release(spark)
    return reduce(DataFrame.unionByName, _one_by_one(spark, matched, halves)).distinct()


def _one_by_one(spark: SparkSession, part: Callable[[int], DataFrame], parts: int) -> list[DataFrame]:
    """The written parts; nothing refers to the plan of one when its shuffle files are released."""
    out = []
    for i in range(parts):
        out.append(part(i))
        release(spark)
    return out


def _token_sets(docs: DataFrame, key: str, text: str, codes: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, bits, first, keys) of the classes, from the lines where they occur first: only those are taken apart."""
    asked = frozen(classes.select("cls", "bits", "first"))
    where = asked.select(F.col("first.doc").alias("doc"), F.col("first.line").alias("line"))
    texts = docs.select(document(key, text).alias("doc"), F.col(text).alias("text")).join(_sized(where.select("doc").distinct(), 16), "doc", "left_semi")
    bodies = trimmed_lines(texts, "text", F.col("doc")).join(_sized(where.distinct(), 32), ["doc", "line"], "left_semi").select("doc", "line", "body")
    keys = with_token_keys(bodies.dropDuplicates(["doc", "line"]), codes)
    return asked.join(keys, (F.col("first.doc") == F.col("doc")) & (F.col("first.line") == F.col("line"))).select("cls", "bits", "first", "keys")


def _with_copies_marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with ``__copy``: whether a row without a key has a text that another such row, the first one, has too.

    Only rows with such texts are numbered; they are cut first, so that each keeps its number.
    """
    unnamed = F.col(key).isNull() & F.col(text).isNotNull()
    marked = docs.withColumn("__copy", F.lit(False))
    repeated = frozen(docs.where(unnamed).groupBy(document(key, text).alias("__doc")).count().where("count > 1").select("__doc"))
    if repeated.isEmpty():
        return marked
    named = docs.where(~unnamed).withColumn("__copy", F.lit(False))
    rest = docs.where(unnamed).withColumn("__doc", document(key, text))
    repeated = _sized(repeated, 16)
    copies = frozen(rest.join(repeated, "__doc", "left_semi").withColumn("__row", F.monotonically_increasing_id()))
    first = frozen(copies.groupBy("__doc").agg(F.min("__row").alias("__row")).select("__row", F.lit(True).alias("__first")))
    copies = copies.join(_sized(first, 24), "__row", "left").withColumn("__copy", F.col("__first").isNull())
    rest = rest.join(repeated, "__doc", "left_anti").withColumn("__copy", F.lit(False))
    columns = [*docs.columns, "__copy"]
    return named.unionByName(rest.select(*columns)).unionByName(copies.select(*columns))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with matching later lines taken out of ``text``, and the columns n_lines and n_removed (replacing such columns).

    Null texts stay null, with no lines; a text whose lines are all removed becomes empty; blank lines are kept. The lines
    that stay are joined by line feeds, as they were. Rows with one key and one text keep the same lines; of rows with one
    text and no key, all but one lose all lines with tokens. An empty table gives no rows.
    """
    gone = removed_lines(docs, key, text, similar).select(F.col("doc").alias("__doc"), F.col("lines").alias("__lines"))
    parts = F.col("__parts")
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    marked = _with_copies_marked(docs, key, text).withColumn("__doc", document(key, text))
    joined = marked.join(_sized(gone, F.size("__lines") * 4 + F.lit(48)), "__doc", "left")
    # a column of its own: in the functions below a text would be split again for each line
    joined = joined.withColumn("__parts", F.when(F.col("__copy") | F.col("__lines").isNotNull(), F.split(F.col(text), "\n", -1)))
    joined = joined.withColumn("__lines", F.when(F.col("__copy"), F.filter(every, lambda i: F.trim(spaced(F.get(parts, i))) != "")).otherwise(F.col("__lines")))
    kept = F.transform(F.array_except(every, F.col("__lines")), lambda i: F.get(parts, i))
    return joined.withColumns({
        text: F.when(F.col("__lines").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.coalesce(F.size("__lines"), F.lit(0))).cast("long"),
    }).drop("__doc", "__copy", "__parts", "__lines")
