"""Document fingerprints from closed syncmers, in column expressions only.

A text is cut into words, its k-mers are runs of K words, and the inner substrings of a k-mer are
its runs of S words. A k-mer is a closed syncmer when the smallest hash among its inner substrings
is that of the first or the last one. Whether a k-mer is chosen depends on the k-mer alone, so the
same passage gives the same anchors in every text, whatever stands around it, and at least one
k-mer in every few is chosen. Texts of every length are read in this one way.

A fingerprint keeps, of all anchors of the whole text, those with the smallest hashes (a
bottom-k sample, the same anchors for shared passages), each with the word position of its
first occurrence. Two fingerprints are compared by position: among the anchors they share,
the prevailing shift is found, and anchors count as matched when their positions agree
with it up to a slack. The likeness is the matched part of the smallest hashes of the union, an
estimate of the Jaccard similarity of the anchor sets; it is made of the two fingerprints that
are returned and of nothing else.

Texts of fewer than K words are one anchor as a whole; null counts as empty and the empty text
has an empty fingerprint, alike (1.0) only to another empty one. Runs of visible characters
longer than LONGEST_WORD are cut, so texts without spaces have words too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import prepared

K = 3
S = 1
SAMPLE = 96
SLACK = 16
LONGEST_WORD = 16
BLOCK_ROWS = 2048
SUPER_BLOCK = 4096


def _words(text: Column) -> Column:
    words = F.split(F.lower(text), r"\s+")
    pieces = F.split(F.regexp_replace(F.lower(text), rf"(\S{{{LONGEST_WORD}}})(?=\S)", "$1 "), r"\s+")
    cut = _bound(
        words, lambda w: F.when(F.exists(w, lambda x: F.length(x) > LONGEST_WORD), pieces).otherwise(w)
    )
    return F.filter(cut, lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S, sample: int = SAMPLE) -> Column:
    """The fingerprint as an array of (hash, position), smallest hashes first."""
    inner = k - s + 1

    def inner_hashes(hashes: Column) -> Column:
        """Hash of each run of s words (here: of word hashes)."""
        count = F.size(hashes) - (s - 1)
        starts = F.sequence(F.lit(0), count - 1)
        return F.when(
            count > 0,
            F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(s)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def chosen(runs: Column) -> Column:
        """Closed syncmers among the k-mers, as (hash, position)."""
        count = F.size(runs) - (inner - 1)

        def is_closed(i: Column) -> Column:
            edge = F.least(F.get(runs, i), F.get(runs, i + (inner - 1)))
            middle = [F.get(runs, i + j) for j in range(1, inner - 1)]
            return edge <= (F.least(*middle) if len(middle) > 1 else middle[0])

        starts = F.filter(F.sequence(F.lit(0), count - 1), is_closed)
        covering = [*range(0, inner - 1, s), inner - 1]
        hashed = F.transform(
            starts,
            lambda i: F.struct(F.xxhash64(*[F.get(runs, i + j) for j in covering]).alias("h"), i.alias("p")),
        )
        return F.when(count > 0, hashed)

    whole = F.array(F.struct(F.xxhash64(text).alias("h"), F.lit(0).alias("p")))
    found = _bound(
        F.transform(_words(text), lambda w: F.xxhash64(w)),
        lambda words: F.coalesce(
            _bound(inner_hashes(words), chosen), F.when(F.size(words) > 0, whole)
        ),
    )
    ordered = F.sort_array(found)
    distinct = _bound(
        ordered,
        lambda a: F.filter(
            a, lambda x, i: (i == 0) | (F.get(a, i - 1)["h"] != x["h"])
        ),
    )
    return F.coalesce(F.slice(distinct, 1, sample), F.array().cast("array<struct<h:bigint,p:int>>"))


def likeness(a: Column, b: Column, sample: int = SAMPLE, slack: int = SLACK) -> Column:
    """Likeness of two anchor arrays from 0 to 1."""

    def hashes(of: Column) -> Column:
        return F.transform(of, lambda x: x["h"])

    def compare(pair: Column) -> Column:
        left, right = pair["a"], pair["b"]
        step = F.struct(
            F.slice(F.sort_array(F.array_union(hashes(left), hashes(right))), 1, sample).alias("union"),
            F.map_from_entries(left).alias("left"),
            F.map_from_entries(right).alias("right"),
            F.array_intersect(hashes(left), hashes(right)).alias("shared"),
        )
        return (
            F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
            .when(~F.arrays_overlap(hashes(left), hashes(right)), F.lit(0.0))
            .otherwise(_bound(step, matched))
        )

    def matched(step: Column) -> Column:
        def shifts(limit: Column) -> Column:
            kept = F.filter(step["shared"], lambda h: h <= limit)
            shift = F.transform(kept, lambda h: F.element_at(step["left"], h) - F.element_at(step["right"], h))
            return F.sort_array(shift)

        def agreeing(sorted_shifts: Column) -> Column:
            middle = F.get(sorted_shifts, F.floor(F.size(sorted_shifts) / 2).cast("int"))
            near = _bound(middle, lambda m: F.size(F.filter(sorted_shifts, lambda d: F.abs(d - m) <= slack)))
            return F.coalesce(near, F.lit(0))

        found = _bound(_bound(F.array_max(step["union"]), shifts), agreeing)
        return found / F.size(step["union"])

    return _bound(F.struct(a.alias("a"), b.alias("b")), compare)


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as a string: hash and position of each anchor, in hexadecimal."""
    return F.array_join(
        F.transform(fingerprint, lambda x: F.concat(F.hex(x["h"]), F.lit("@"), F.hex(x["p"].cast("long")))),
        " ",
    )


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the anchors of each whole text."""
    return df.withColumn(out, anchors(F.coalesce(F.col(text), F.lit(""))))


def _cut(value: Column, shift: int | Column) -> Column:
    """The start of the value's block of 2^shift numbers."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _shift(width: int, blocks: int) -> int:
    """Block size for about ``blocks`` blocks, or up to twice as many, in a range."""
    return max(0, (width // max(1, blocks)).bit_length() - 1)


def _in_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, list[str], int]:
    """Adds ``block`` and, where it is needed, ``part``: rows with equal values are neighbours in
    the order of ``key, digest`` and blocks follow one another in it. Also the names added and the
    power of two of the usual block's width.

    Blocks are id ranges of one width; those that turn out to hold many more rows than they should
    (outlying or clustered ids) are cut again by the range of their own ids, and rows of one id by
    the hash of their text. A block is cut again while it holds more than eight times
    ``block_rows`` and more than one in 4096 of all rows, so fewer than 4096 such blocks are known
    to the driver at a time."""
    facts = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).head()
    usual = _shift((facts["high"] or 0) - (facts["low"] or 0), facts["n"] // block_rows)
    placed, names = rows.withColumn("block", _cut(F.col("key"), F.lit(usual))), ["block"]
    limit = max(8 * block_rows, facts["n"] // 4096)
    full = placed
    while True:
        large = (
            full.groupBy(*names)
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
                 F.min("digest").alias("first"), F.max("digest").alias("last"))
            .where((F.col("n") > limit) & ((F.col("low") < F.col("high")) | (F.col("first") < F.col("last"))))
            .collect()
        )
        if not large:
            return placed, names, usual
        cuts = []
        for r in large:
            of_key = r["low"] is not None and r["low"] < r["high"]
            low, high = (r["low"], r["high"]) if of_key else (r["first"], r["last"])
            # One step narrower at least than the range that was too full.
            shift = min(_shift(high - low, r["n"] // block_rows), (high - low).bit_length() - 1)
            cuts.append((r["block"], r["part"] if "part" in names else 0, shift if of_key else None, None if of_key else shift))
        if "part" not in names and any(c[3] is not None for c in cuts):
            names = [*names, "part"]
            placed, full = (df.withColumn("part", F.lit(0).cast("long")) for df in (placed, full))
        known = rows.sparkSession.createDataFrame(cuts, "b long, p long, of_key int, of_digest int")

        def again(df: DataFrame, how: str) -> DataFrame:
            same = df["block"].eqNullSafe(known["b"])
            if "part" in names:
                same &= df["part"] == known["p"]
            met = df.join(F.broadcast(known), same, how)
            met = met.withColumn("block", F.when(F.col("of_key").isNotNull(), _cut(F.col("key"), F.col("of_key"))).otherwise(F.col("block")))
            if "part" in names:
                met = met.withColumn(
                    "part", F.when(F.col("of_digest").isNotNull(), _cut(F.col("digest"), F.col("of_digest"))).otherwise(F.col("part")))
            return met.drop("b", "p", "of_key", "of_digest")

        placed, full = again(placed, "left"), again(full, "inner")


def _block_links(blocks: DataFrame, names: list[str], width: int) -> DataFrame:
    """``here, following``, structs of the names, for distinct blocks; after the last the first.

    Blocks are ordered within super-blocks of SUPER_BLOCK usual widths, and only the super-blocks'
    first blocks, one in SUPER_BLOCK, meet in one window."""
    tagged = blocks.select(
        _cut(F.col("block"), F.lit(min(63, width + SUPER_BLOCK.bit_length()))).alias("super"), F.struct(*names).alias("here"))
    inside = Window.partitionBy("super").orderBy("here")
    firsts = tagged.groupBy("super").agg(F.min("here").alias("first"))
    across = Window.orderBy(F.col("super").asc_nulls_first())
    entries = firsts.select(
        F.col("super").alias("entered"),
        F.coalesce(
            F.lead("first").over(across),
            F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("entry"),
    )
    linked = tagged.withColumn("inner", F.lead("here").over(inside))
    linked = linked.join(entries, linked["super"].eqNullSafe(entries["entered"]))
    return linked.select("here", F.coalesce("inner", "entry").alias("following"))


def edited_fingerprints(
    df: DataFrame, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likenesses.

    The edited text of a row has its last quarter of code points replaced by the first as many
    (or all) of the next row's text by ascending key; after the last row comes the first.
    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Rows that repeat a key follow one another by the hash of their text, then by text; rows
    without a key come first.

    The order is made within blocks of ids, and only a block's last row looks into the next
    block. Each text moves once, and its fingerprint is made behind that shuffle.
    """
    prepared(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    placed, names, width = _in_blocks(rows, block_rows)
    dealt = placed.repartition(*names)
    order = Window.partitionBy(*names).orderBy(F.col("key").asc_nulls_first(), "digest", "text")

    def marked(part: DataFrame) -> DataFrame:
        return part.withColumn("fp", anchors(F.col("text")))

    own = ["key", "text", "fp"]
    body = (
        marked(dealt)
        .withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
        .where(F.col("next_text").isNotNull())
        .select(*own, "next_text", "next_fp")
    )
    # The rows at the blocks' ends, one or two of each block.
    edges = dealt.withColumns(
        {"here": F.struct(*names), "first": F.lag("text").over(order).isNull(), "last": F.lead("text").over(order).isNull()}
    )
    starts = marked(edges.where("first")).select(
        F.col("here").alias("following"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp")
    )
    links = _block_links(placed.select(*names).distinct(), names, width)
    ends = marked(edges.where("last")).join(links, "here").join(starts, "following")
    paired = body.unionByName(ends.select(*own, "next_text", "next_fp"))

    n_chars = F.char_length("text")
    moved = F.floor(n_chars / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n_chars - moved),
        F.substring(F.col("next_text"), F.lit(1), moved),
    )
    made = paired.withColumn("edited", edited).withColumn("edited_fp", anchors(F.col("edited")))
    return made.select(
        F.col("key").alias(key),
        n_chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
