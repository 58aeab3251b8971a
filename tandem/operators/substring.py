"""Batched substring search: records whose text matches ``%query%``, first k by id.

One query is a literal predicate on the scan. For many queries the join needs an equality,
so each pattern is probed by something every matching text must contain:

* a whole word that has a non-word character on both sides inside the pattern, else
* a literal n-gram (three characters, fewer for shorter patterns).

The rarest probe of a pattern decides; records are joined on it alone and then checked
against the whole pattern. Wildcards in the query text keep their meaning, so probes are
taken from the longest run between them; a pattern made of wildcards alone is probed by the
empty n-gram, which every text has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.cells import quoted
from tandem.functions.patterns import ilike_contains
from tandem.functions.text import distinct_tokens
from tandem.session import materialise

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct n-grams of a text, found in one pass by overlapping matches."""
    if n == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


_WORD_INSIDE = r"(?<=[^\p{L}\p{N}])([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"


def _probes(queries: DataFrame) -> DataFrame:
    """``query_id, query_text, kind, probe``; kind -1 is a word, n >= 0 an n-gram."""
    # A backslash quotes the next character in a pattern; such pairs also end a run.
    runs = F.transform(
        F.split(F.lower("query_text"), r"\\.|[%_\\]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))
    )
    longest = F.element_at(F.sort_array(runs), -1)
    with_run = queries.select("query_id", "query_text", longest["run"].alias("run"))
    with_words = with_run.withColumn("words", F.array_distinct(F.regexp_extract_all("run", F.lit(_WORD_INSIDE), F.lit(1))))
    grams = _grams(F.col("run"), GRAM)
    for n in range(GRAM - 1, -1, -1):
        grams = F.when(F.length("run") == n, _grams(F.col("run"), n)).otherwise(grams)
    has_word = F.size("words") > 0
    return with_words.select(
        "query_id",
        "query_text",
        F.when(has_word, F.lit(-1)).otherwise(F.least(F.lit(GRAM), F.length("run"))).alias("kind"),
        F.explode(F.when(has_word, F.col("words")).otherwise(grams)).alias("probe"),
    )


def _tagged(probes: Column, kind: int) -> Column:
    return F.transform(probes, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("probe")))


def _record_probes(records: DataFrame, id_col: str, texts: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``id, kind, probe`` limited to probes some query asks for, before anything is shuffled."""
    # At most GRAM + 2 values: the kinds of probes in use.
    kinds = sorted(r[0] for r in wanted.select("kind").distinct().collect())
    found = []
    for kind in kinds:
        for t in texts:
            text = F.lower(F.coalesce(quoted(t), F.lit("")))
            probes = distinct_tokens(text) if kind < 0 else _grams(text, kind)
            found.append(_tagged(probes, kind))
    if not found:
        return records.select(F.col(id_col).alias("id"), F.lit(0).alias("kind"), F.lit("").alias("probe")).limit(0)
    exploded = records.select(F.col(id_col).alias("id"), F.inline(F.concat(*found)))
    asked = exploded.join(wanted, ["kind", "probe"], "left_semi")
    return asked if len(texts) == 1 else asked.distinct()


def substring_topk(
    records: DataFrame,
    queries: DataFrame,
    k: int,
    texts: Sequence[str],
    id_col: str = "id",
) -> DataFrame:
    """``query_id, id, rank`` for records where any of ``texts`` contains the query text."""
    probes = _probes(queries)
    have = materialise(_record_probes(records, id_col, texts, probes.select("kind", "probe").distinct()), "probes")
    spread = have.groupBy("kind", "probe").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("query_id").orderBy("n", "probe")
    # A probe no record has rules the query out: counted as 0, chosen first, joins nothing.
    chosen = (
        probes.join(spread, ["kind", "probe"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("__place", F.row_number().over(rarest))
        .where(F.col("__place") == 1)
    )
    candidates = chosen.select("query_id", "query_text", "kind", "probe").join(have, ["kind", "probe"]).drop("kind", "probe")
    whole = reduce(or_, [F.coalesce(ilike_contains(quoted(t), F.col("query_text")), F.lit(False)) for t in texts])
    verified = (
        candidates.join(records.select(F.col(id_col).alias("id"), *[quoted(t) for t in texts]), "id")
        .where(whole)
    )
    order = Window.partitionBy("query_id").orderBy("id")
    return (
        verified.select("query_id", "id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    )


def substring_search(records: DataFrame, query: str, k: int, texts: Sequence[str], id_col: str = "id") -> DataFrame:
    """One query: a predicate on the scan, first k rows by id."""
    return records.where(reduce(or_, [ilike_contains(quoted(t), query) for t in texts])).orderBy(id_col).limit(k)
