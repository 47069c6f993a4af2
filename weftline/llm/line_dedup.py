"""Fuzzy line dedup by MinHash.

Lines are compared in lower case and trimmed, as sets of their five-character shingles. The signature
of a line is a bottom-k MinHash: the least hashes of its longer character shingles, those that follow
a space; each two of them make a band, and lines that share a band are candidates. A line of few words
is signed by shingles from every place, and a short one by those that are compared; one in between is
signed in both ways, so that lines on either side of a border meet. An exact bound, how many bits of
the candidates' shingle maps differ, goes before the exact Jaccard similarity of their sets; links are
joined to components by distributed union-find, and the first line of each component is kept: that of
the smallest document, then the smallest line number. Lines that are equal are one class before all that.

All of it is DataFrame functions. Only the shingles after spaces are taken of every line, so that few
strings are made; the sets that are compared are those of candidates alone.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import bucket_components, passing
from .scratch import discard, stored

SHINGLE = 5
#: Least hashes that sign a line: of 11-character shingles after spaces, of 8-character ones, of those that are compared.
AFTER_SPACE, ANYWHERE, SHORT = 5, 6, 6
#: Lines with up to FEW distinct shingles after spaces are signed from every place, with MANY or more after spaces.
FEW, MANY = 8, 5
#: Lines of this many characters or more are signed by 8-character shingles, up to that many by those that are compared.
LONG, BRIEF = 16, 24
#: A longer line is signed by the latter too if one of its first so many shingles repeats: rules of dashes
#: have few shingles at any length. Without that, it has more than a line under LONG can be similar to,
#: as it has with more than VARIED distinct shingles after spaces.
WITHIN, VARIED = 16, 16
#: 64-bit words of a line's shingle map. A longer line's map tells less, and leaves more to the exact test; with
#: more words, the join's condition is a method that the JVM doesn't compile.
WORDS = 16
#: Over any doc_id; a place has a null one's lines there.
LATE = Decimal(1 << 63)


def shingles(line: Column, width: int, after: str = "") -> Column:
    """All substrings of ``width`` characters of a line, or those that follow the character ``after``."""
    return F.regexp_extract_all(line, F.lit(f"(?s){after}(?=(.{{{width}}}))"), F.lit(1))


def hashes(strings: Column) -> Column:
    return F.array_distinct(F.transform(strings, lambda x: F.xxhash64(x)))


def bottom(h: Column, k: int) -> Column:
    return F.slice(F.sort_array(h), 1, k)


def pair_bands(least: Column, salt: int, k: int) -> Column:
    """A key for each two of up to ``k`` hashes, or for the only one; none of null."""
    pairs = F.flatten(F.transform(least, lambda x, i: F.transform(F.slice(least, i + 2, F.lit(k)), lambda y: F.xxhash64(F.lit(salt), x, y))))
    return F.coalesce(F.when(F.size(least) == 1, F.transform(least, lambda x: F.xxhash64(F.lit(salt), x))).otherwise(pairs), F.array().cast("array<long>"))


def split_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, line, id, check``: lines as they are compared, and 128 bits of hashes, null under SHINGLE characters."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.lower(F.trim(F.rtrim("line", F.lit("\r")))))
    long = F.length("line") >= SHINGLE
    return rows.withColumn("id", F.when(long, F.xxhash64("line"))).withColumn("check", F.when(long, F.xxhash64(F.lit(1), "line")))


def signed_lines(docs: DataFrame) -> DataFrame:
    """Rows of ``split_lines`` with the least hashes ``after, anywhere, short`` in place of the line; null where a line is not signed so."""
    line, long = F.col("line"), F.col("id").isNotNull()
    rows = split_lines(docs).withColumn("wide", F.when(long, hashes(shingles(line, 11, " "))))
    again = F.substring(line, 1, WITHIN + SHINGLE - 1).rlike(f"(?s)(?=(.{{{SHINGLE}}})).(?=.*?\\1)")
    return rows.select(
        "doc_id", "text_hash", "line_no", "id", "check",
        F.when(F.size("wide") >= MANY, bottom(F.col("wide"), AFTER_SPACE)).alias("after"),
        F.when(long & (F.size("wide") <= FEW) & (F.length(line) >= LONG), bottom(hashes(shingles(line, 8)), ANYWHERE)).alias("anywhere"),
        F.when(long & ((F.length(line) <= BRIEF) | ((F.size("wide") <= VARIED) & again)), bottom(hashes(shingles(line, SHINGLE)), SHORT)).alias("short"),
    )


def bands() -> Column:
    return F.concat(pair_bands(F.col("after"), 1, AFTER_SPACE), pair_bands(F.col("anywhere"), 2, ANYWHERE), pair_bands(F.col("short"), 3, SHORT))


def shingle_sets(lines: DataFrame) -> DataFrame:
    """``id, n, shingles`` of ``id, line``: the distinct shingles as 32-bit hashes, and their number."""
    sets = lines.select("id", F.array_distinct(F.transform(shingles(F.col("line"), SHINGLE), lambda x: F.hash(x))).alias("shingles"))
    return sets.select("id", F.size("shingles").cast("long").alias("n"), "shingles")


def mapped(sets: DataFrame) -> DataFrame:
    """``id, trait`` of shingle sets; a trait is the number n of shingles and the parity of how many have each hash modulo the map's bits, as words m0, m1 and so on."""
    each = sets.select("id", F.explode("shingles").alias("h"))
    each = each.select("id", F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64))).alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(WORDS)]
    found = each.groupBy("id").agg(F.count("*").alias("n"), *words)
    return found.select("id", F.struct("n", *(f"m{k}" for k in range(WORDS))).alias("trait"))


def close_traits(num: int, den: int) -> Callable[[Column, Column], Column]:
    """Whether the sizes and maps of two lines allow the similarity: every bit that differs takes a shingle that only one line has."""

    def test(x: Column, y: Column) -> Column:
        apart = sum((F.bit_count(x[f"m{k}"].bitwiseXOR(y[f"m{k}"])) for k in range(WORDS)), F.lit(0))
        most = (x["n"] + y["n"]) * (den - num)
        return (F.abs(x["n"] - y["n"]) * (den + num) <= most) & (apart * (den + num) <= most)

    return test


def similar_sets(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of rows ``a, b, n_a, n_b, s_a, s_b`` with shingle sets and their sizes, the pairs ``a, b`` that are similar."""
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.where(both * (den + num) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b")


def place() -> Column:
    """A line's place as one number that orders lines by document, number and text; a null doc_id comes last."""
    number = F.col("line_no").cast("long") * F.lit(1 << 32) + F.pmod("text_hash", F.lit(1 << 32))
    return (F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(LATE)) * F.lit(LATE) + number).cast("decimal(38,0)")


def line_components(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, text_hash, line_no, first_doc_id, first_line_no, kept``: every line with the first line of its component.

    Lines link when ``den * |A & B| >= num * |A | B|``. ``docs`` needs doc_id and text; other columns
    are ignored. Lines end at line feeds. Lines of under five characters have no shingles: they link
    with nothing and are kept. A null text has no lines, an empty one has an empty line. Rows that
    repeat a doc_id and its text are one document, whose decisions hold for all of them; a line with
    a null doc_id is kept only where no other document has its like. An empty table gives no rows.
    """
    return _line_components(docs, num, den)[0]


def _line_components(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """The lines, and the stored tables that they are read from."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = stored(signed_lines(docs), "lines")
    spread = every.where("id is not null").select("id", F.explode(bands()).alias("key"))

    own: list[DataFrame] = []

    def traits_of(ids: DataFrame) -> DataFrame:
        lines = split_lines(docs).where("id is not null").select("id", "line")
        bits: list[DataFrame] = []
        wanted = passing(lines, ids, "id", bits).join(ids, "id", "left_semi").dropDuplicates(["id"])
        own.append(stored(shingle_sets(wanted), "sets", *bits))
        return stored(mapped(own[0]), "traits")

    def linked(pairs: DataFrame) -> DataFrame:
        x, y = (own[0].select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("shingles").alias(f"s_{i}")) for i in "ab")
        return stored(similar_sets(pairs.join(y, "b").join(x, "a"), num, den), "links")

    components = bucket_components(spread, linked, traits_of=traits_of, close=close_traits(num, den))
    discard(*own)
    every = stored(every.select("doc_id", "text_hash", "line_no", "id", "check"), "places", every)
    own = every.where("id is not null").groupBy("id", "check").agg(F.min(place()).alias("place"))
    if components is not None:
        own = stored(own.join(components, "id", "left").withColumn("component", F.coalesce("component", "id")), "own", components)
        head = stored(own.groupBy("component").agg(F.min("place").alias("place")), "heads")
        own = stored(own.select("id", "check", "component").join(head, "component").select("id", "check", "place"), "firsts", own, head)
    tables = [every, *([own] if components is not None else [])]
    low = F.pmod("place", F.lit(LATE))
    doc = ((F.col("place") - low) / F.lit(LATE)).cast("decimal(20,0)")
    own = own.select("id", "check", F.when(doc < F.lit(LATE), doc.cast("long")).alias("d"), low.cast("long").alias("low"))
    own = own.select("id", "check", "d", F.shiftright("low", 32).cast("int").alias("l"), (F.col("low") % F.lit(1 << 32)).alias("t"))
    first = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l")) & (F.pmod("text_hash", F.lit(1 << 32)) == F.col("t"))
    out = every.where("id is not null").join(own, ["id", "check"])
    out = out.select("doc_id", "text_hash", "line_no", F.col("d").alias("first_doc_id"), F.col("l").alias("first_line_no"), first.alias("kept"))
    short = every.where("id is null").select("doc_id", "text_hash", "line_no", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"), F.lit(True).alias("kept"))
    return out.unionByName(short), tables


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the kept lines of each text; other columns stay, n_chars (if there) is counted anew.

    A document goes when lines of it were removed and nothing but blank lines is left; one that had no
    lines to remove stays as it is, as do null and empty texts.
    """
    found, tables = _line_components(docs, num, den)
    gone = found.where("not kept").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_set("line_no").alias("gone"))
    gone = stored(gone, "gone-lines", *tables)  # the decisions are all that is kept
    # the document stands as one value beside the keys, so that no column of its own can clash with them
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = whole.join(gone, F.col("own").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t")), "left")

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # the text is split once, as the element of an array, not anew for each line
    left = F.when(F.col("gone").isNotNull(), F.transform(F.array(F.split("text", "\n")), kept)[0])
    out = joined.select("doc", left.alias("left")).where(F.col("left").isNull() | F.col("left").rlike(r"\S"))
    new = {"text": F.coalesce("left", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("left").isNull(), F.col("doc.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every line of all documents, with the first line of its component."""
    return line_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


QUERIES = {"op1_line_dedup": query}
