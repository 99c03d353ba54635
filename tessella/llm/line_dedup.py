"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line of n characters is cut into edits + 1 segments of nearly equal length. Another line of n to n + edits characters
within that distance has one of these segments as it stands, in one of few places that the segment's number and the
lines' lengths allow. So each different line gives a key for each of its segments (with its length and the segment's
number) and for each of its substrings that may be a segment of a line that is as long or shorter.

1. Keys are counted, which shuffles one number for a key and task; only keys that a segment has and several lines meet in
   are looked at again. Of a key that many lines meet in, the rest of these lines is cut once more in the same way.
2. A line is compared with the first line of each of its keys; only lines that are not found near to it are compared with
   all earlier lines of the key. So a large group of near copies gives one pair for each line.
3. Pairs are verified by a banded bit-parallel edit distance: a column's differences within the band are bits of a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import maybe_among, texts, written

#: From so many characters on, so many edits make a near copy. A shorter line is another line once it is edited.
BANDS = ((5, 1), (20, 2))
#: Lines of a key that more lines meet in are cut once more.
HOT = 64


def _places(bands: tuple[tuple[int, int], ...]) -> list[tuple[int, bool, int, int, int]]:
    """(edits, own, shorter, number, shift): where a line's segments, and its substrings that may be segments of lines
    `shorter` characters shorter, stand."""
    out = []
    for edits in sorted({e for _, e in bands}):
        for i in range(edits + 1):
            out.append((edits, True, 0, i, 0))
            for shorter in range(edits + 1):
                # a match that leaves at most i edits before the segment and edits - i after it
                for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                    if shorter or shift:
                        out.append((edits, False, shorter, i, shift))
    return out


def _edits(length: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(0)
    for least, edits in sorted(bands):
        out = F.when(length >= least, edits).otherwise(out)
    return out


def _keys(rows: DataFrame, line: Column, n: Column, banded: Column, wanted: Column, bands: tuple[tuple[int, int], ...], *more: Column) -> DataFrame:
    """rows with key, own, shorter, at and size for each wanted place of a line of n characters. banded: the length by which
    a band is chosen. Places are rows of their own, so that all is compiled at run time; functions over arrays would not be."""
    names = ("edits", "own", "shorter", "number", "shift")
    places = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, p, strict=True))) for p in _places(bands)))
    edits, shorter, number, shift = (F.col(c) for c in ("edits", "shorter", "number", "shift"))
    at, size = F.col("at"), F.col("size")
    least, parts = n - shorter, edits + 1
    base, first_long = F.floor(least / parts).cast("int"), parts - least % parts
    own = rows.select("*", F.inline(places)).filter(wanted & (edits == _edits(banded - shorter, bands)))
    # the last least % parts segments are one longer
    cut = own.withColumns({"at": base * number + F.greatest(F.lit(0), number - first_long) + 1 + shift, "size": base + (number >= first_long).cast("int")})
    keyed = cut.filter((at >= 1) & (at + size - 1 <= n)).withColumn("key", F.xxhash64(*more, least, number, F.substring(line, at, size)))
    return keyed.select(*rows.columns, "key", "own", "shorter", "at", "size")


def keys_of(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """lines (line, n, ...) with key, own, shorter, at and size for each key of each line."""
    return _keys(lines, F.col("line"), F.col("n"), F.col("n"), F.lit(True), bands)


def _inner_keys(rows: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """(lid, key, own) of what is left of lines without the segment by which they met others. A line whose segment it was gives
    segments of the rest; every line gives substrings of its rest for the length at which they met."""
    size = F.col("size")
    rest = F.concat(F.substring(F.col("line"), F.lit(1), F.col("at") - 1), F.substring(F.col("line"), F.col("at") + size, F.col("n")))
    rows = rows.select("lid", F.col("key").alias("outer"), F.col("own").alias("index"), F.col("shorter").alias("by"), "n", rest.alias("line"), (F.col("n") - size).alias("left"))
    # a segment in place is a substring too: lines of equal length meet by it
    wanted = F.when(F.col("own"), F.col("by") == 0).otherwise(F.col("shorter") == F.col("by"))
    out = _keys(rows, F.col("line"), F.col("left"), F.col("n"), wanted, bands, F.col("outer"))
    return out.select("lid", "key", (F.col("own") & F.col("index")).alias("own")).distinct()


def _met(keys: DataFrame) -> DataFrame:
    """(key, m): keys that a segment has and several rows meet in."""
    counts = keys.groupBy("key").agg(F.count_if("own").alias("own"), F.count("*").alias("m"))
    return counts.filter("own > 0 and m > 1").select("key", "m")


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two texts if it is `edits` at most (30 at most), else a larger number; null if either is null.

    Bit p of a column j's longs stands for row j - edits + p of the band: whether the row's value is one more (vp) or one
    less (vn) than that of the row above. The value is followed down the band's last diagonal, then along a's last row.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    n_rows, n_columns = F.length(a), F.length(b)
    long = lambda x: F.lit(x).cast("long")
    bit = lambda x, p: F.call_function("shiftrightunsigned", x, p).bitwiseAND(long(1))

    def step(s: Column, j: Column, texts_: Column) -> Column:
        char = F.get(texts_["columns"], j - 1)
        same = long(0)
        for p in range(width):
            same = same + F.when(F.get(texts_["rows"], j + p) == char, long(1 << p)).otherwise(long(0))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["value"].alias("value"), same.alias("same"), j.alias("j"))

    def diagonal(s: Column) -> Column:
        vp, vn, same = s["vp"], s["vn"], s["same"]
        kept = ((same.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(same).bitwiseOR(vn).bitwiseAND(long(mask))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["value"].alias("value"), kept.alias("d0"), s["j"].alias("j"))

    def across(s: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(long(mask))
        return F.struct(s["value"].alias("value"), d0.alias("d0"), s["j"].alias("j"), hp.alias("hp"), d0.bitwiseAND(vp).alias("hn"))

    def down(s: Column) -> Column:
        d0, hp, hn = s["d0"], s["hp"], s["hn"]
        past = (s["j"] + edits - n_rows).cast("int")  # rows of the band below the last one
        at = F.lit(width - 1) - past
        value = F.when(past <= 0, s["value"] + 1 - bit(d0, F.lit(width - 1))).otherwise(s["value"] + bit(hp, at) - bit(hn, at))
        above = F.shiftrightunsigned(d0, 1)
        vp = hn.bitwiseOR(F.bitwise_not(above.bitwiseOR(hp))).bitwiseAND(long(mask))
        return F.struct(vp.alias("vp"), above.bitwiseAND(hp).alias("vn"), value.cast("long").alias("value"))

    def bound(x: Column, f) -> Column:
        """f(x) with x computed once: it is an element that a transform sees."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def column(s: Column, j: Column, texts_: Column) -> Column:
        return bound(bound(bound(step(s, j, texts_), diagonal), across), down)

    # in column 0, and in the band's place of column 1, rows 1 to edits + 1 are one more than the row above
    start = F.struct(long(((1 << (edits + 1)) - 1) << edits).alias("vp"), long(0).alias("vn"), long(edits).alias("value"))
    # `edits` places without a character stand before and after the rows, so that every place of the band is one
    none = F.array_repeat(F.lit("").cast("string"), edits + 1)
    chars = F.struct(F.concat(none, F.split(a, ""), none).alias("rows"), F.split(b, "").alias("columns"))
    followed = bound(chars, lambda t: F.aggregate(F.sequence(F.lit(1), n_columns), start, lambda s, j: column(s, j, t))["value"])
    long_enough = (n_columns >= 1) & (F.abs(n_rows - n_columns) <= edits) & (n_rows >= edits)
    far = F.when(F.abs(n_rows - n_columns) > edits, F.lit(edits + 1))
    return F.when(long_enough, followed.cast("int")).otherwise(F.coalesce(far, F.levenshtein(a, b)))


#: Frequent letters of Latin scripts.
LETTERS = "eantiorslhducmpg"


def _letters(line: Column) -> Column:
    """How often each of a few letters stands in a line."""
    return F.array(*(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c))) for c in LETTERS))


def _alike(a: Column, b: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """Whether letters' counts of lines (n, letters) allow the distance: an edit changes two of them by one."""
    off = F.aggregate(F.zip_with(a["letters"], b["letters"], lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return off <= 2 * _edits(F.least(a["n"], b["n"]), bands)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line): texts split at line feeds. A null text has one empty line."""
    return texts(docs).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _named(lines: DataFrame) -> DataFrame:
    """lines that are not blank, with 128 bits of each, a and b."""
    return lines.filter(F.trim("line") != "").withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit("b"), F.col("line"))})


def different_lines(docs: DataFrame) -> DataFrame:
    """(lid, a, b, first, times, line, n) of each different line: a number, where it first stands, how often it does."""
    lines = _named(lines_of(docs)).select("a", "b", F.struct("doc_id", "line_no").alias("place"), "line")
    found = lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("times"), F.min("line").alias("line"))
    return written(found.select(F.monotonically_increasing_id().alias("lid"), "*", F.length("line").alias("n")), "lines-different")


def _near(pairs: DataFrame, text: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """Of pairs (early, late) those within the distance of the shorter line's band."""
    x, y = (text.select(F.col("lid").alias(side), F.col("line").alias(name), F.col("size.n").alias(f"n{name}")) for side, name in (("early", "x"), ("late", "y")))
    both = pairs.join(x, "early").join(y, "late")
    least, near = F.least("nx", "ny"), F.lit(False)
    for chars, edits in sorted(bands):
        near = F.when(least >= chars, banded_distance(F.col("x"), F.col("y"), edits) <= edits).otherwise(near)
    return both.filter(near).select("early", "late")


def near_lines(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, hot: int = HOT) -> DataFrame:
    """(lid) of the lines for which a different line within the distance first stands earlier. lines: see different_lines.

    Lines below all bands are never near to another. Places are by (doc_id, line_no), null ids first; of lines
    that first stand in one place (rows that share a doc_id) the one with the smaller lid is earlier.
    """
    if any(chars < 2 * edits + 1 for chars, edits in bands):
        raise ValueError("a band begins at twice its edits and one, so that segments of what a segment leaves have a character")
    every = keys_of(lines.select("lid", "line", "n"), bands)
    met = written(_met(every), "lines-keys")
    rows = written(maybe_among(every, met, "key").join(met, "key").select("lid", "key", "own", "shorter", "at", "size", "m"), "lines-met")
    ends = written(rows.select("lid").distinct(), "lines-ends")
    text = maybe_among(lines.select("lid", "line", "n", "first"), ends, "lid").join(ends, "lid")
    text = written(text.select("lid", "line", F.struct("first", "lid").alias("place"), F.struct("n", _letters(F.col("line")).alias("letters")).alias("size")), "lines-texts")
    often = rows.filter(F.col("m") > hot).drop("m").join(text.select("lid", "line", F.col("size.n").alias("n")), "lid")
    inner = written(_inner_keys(often, bands), "lines-inner")
    inner = inner.join(written(_met(inner), "lines-keys"), "key").select("lid", "key", "own")
    rows = rows.filter(F.col("m") <= hot).select("lid", "key", "own").unionByName(inner)
    rows = written(rows.join(text.select("lid", "place", F.col("size").alias("has")), "lid"), "lines-rows")

    # each line with the first one of each of its keys
    firsts = rows.groupBy(F.col("key").alias("of")).agg(F.min_by(F.struct("lid", "own", "has"), "place").alias("f"))
    led = rows.join(firsts, (F.col("key") == F.col("of")) & (F.col("lid") != F.col("f.lid")) & (F.col("own") | F.col("f.own")) & _alike(F.col("has"), F.col("f.has"), bands))
    pairs = written(led.select(F.col("f.lid").alias("early"), F.col("lid").alias("late")).distinct(), "lines-pairs")
    near = written(_near(pairs, text, bands).select(F.col("late").alias("lid")).distinct(), "lines-near")
    # the others with all that stand earlier
    late = rows.join(near, "lid", "left_anti").select(F.col("lid").alias("late"), F.col("key").alias("of"), F.col("own").alias("late_own"), F.col("place").alias("late_place"), F.col("has").alias("late_has"))
    early = rows.select(F.col("lid").alias("early"), "key", "own", "place", "has")
    met = (F.col("key") == F.col("of")) & (F.col("place") < F.col("late_place")) & (F.col("own") | F.col("late_own")) & _alike(F.col("has"), F.col("late_has"), bands)
    rest = late.join(early, met).select("early", "late").distinct()
    rest = written(rest.join(pairs, ["early", "late"], "left_anti"), "lines-pairs")
    return near.unionByName(_near(rest, text, bands).select(F.col("late").alias("lid")).distinct())


def flagged_lines(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """(doc_id, line_no, drop): drop is 'exact' where the same line stands earlier, 'near' where a different one within
    the distance first stands earlier, else null. Earlier is by (doc_id, line_no), null ids first.

    bands: from so many characters of the shorter line on, so many edits; below all of them only the same line is a copy.
    Lines that are blank are not named. Repeated rows of a doc_id are one place, so they do not drop each other's lines. Texts are
    taken whole, other columns are not looked at, and an empty table gives no rows.
    """
    different = different_lines(docs)
    near = written(near_lines(different, bands), "lines-near").withColumn("near", F.lit(True))
    # lines that stand once and are near to none need no mark
    marked = different.select("lid", "a", "b", "first", "times").join(near, "lid", "left").filter("times > 1 or near").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    places = _named(lines_of(docs)).select("doc_id", "line_no", "a", "b")
    drop = F.when(F.col("first").isNull() | F.struct("doc_id", "line_no").eqNullSafe(F.col("first")), F.when(F.col("near"), F.lit("near"))).otherwise("exact")
    return places.join(written(marked, "lines-marked"), ["a", "b"], "left").select("doc_id", "line_no", drop.alias("drop"))


def line_dedup(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """doc_id, text for each row of docs: its text without the lines that flagged_lines() drops.

    A null text becomes an empty one. Rows that share a doc_id lose the same line numbers, so doc_id should name a row. Other
    columns are not handed on; an empty table gives no rows.
    """
    gone = flagged_lines(docs, bands).filter("drop is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone = written(gone, "lines-gone").withColumnRenamed("doc_id", "gone_id")
    rows = texts(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(~F.coalesce(F.array_contains("gone", i), F.lit(False)), line))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("text"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (not blank), n_exact, n_near (dropped ones), dropped (their numbers, comma-joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = flagged_lines(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("drop") == "exact").alias("n_exact"),
        F.count_if(F.col("drop") == "near").alias("n_near"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("drop").isNotNull(), F.col("line_no")))), ",").alias("dropped"),
    )
    counts = counts.withColumnRenamed("doc_id", "id")
    out = docs.select("doc_id").join(counts, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_exact", "n_near")), F.coalesce("dropped", F.lit("")).alias("dropped"))
