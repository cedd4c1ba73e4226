"""Filter interaction audit: what each filter removes at each step of every order of the filters.

Orders that begin with the same filters, however arranged, leave the same survivors, so the trie of
orders has one state per set of filters applied.  States are visited depth first: a state's
survivors are a persisted DataFrame made from its parent's by one more filter, and what each
remaining filter removes from them is counted there; a state met again by another
order is not applied again.  The trie is walked before anything runs: one job then fills each
persisted state from its parent's, and all are released after it.

Verdicts on a text are reached once, in one pass over the documents.  Documents of one part with
equal verdicts and labels are told apart by no filter, and travel as one row that counts them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_io import absent, small_or_not, table, written

_SPACE = r"[\x20\x09-\x0D]+"


def rules(text: Column) -> dict[str, Column]:
    """The four failure conditions that read a text: too short, too repetitive, too many capitals, telling symbols."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": capitals * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], duplicate: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """part, a boolean per filter (whether it fails the document), good, toxic: a row per row of ``docs``.

    ``conditions`` are columns of ``docs``; ``duplicate`` names the filter that fails a text which a
    smaller id has too, anywhere in the table.  Ids that are null are smaller than none and larger
    than none, and have no labels; a null text is empty, a null part the empty string.  A document is
    good (toxic) if any label row of its id says so.
    """
    key, digest, part = absent(docs, "key", "digest", "part")
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.select(
        F.col(id_col).alias(key), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias(part), *[F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions.items()],
        F.unhex(F.sha2(text.cast("binary"), 256)).alias(digest),
    )
    judged = written(judged)
    names = list(conditions)
    if duplicate:
        # texts that several rows have, and the least id of each; copies are combined before the shuffle
        least = judged.groupBy(digest).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(digest).alias("same"), "least")
        judged = judged.join(small_or_not(written(least)), F.col(digest) == F.col("same"), "left").withColumn(duplicate, F.coalesce(F.col(key) > F.col("least"), F.lit(False)))
        names.append(duplicate)
    marks = labels.groupBy(F.col(id_col).alias("labelled")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    told = judged.join(small_or_not(written(marks)), F.col(key) == F.col("labelled"), "left")
    return told.select(F.col(part).alias("part"), *names, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def edges(judged: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """part, state, n, lost: a row per part and state of the trie of ``verdicts``' filters.

    ``state`` is the letters applied so far, in order of the alphabet, ``n`` its survivors, and ``lost`` maps each
    filter to what it would remove from them: removed, good_lost, toxic_lost (an applied one removes nothing).
    Parts of which a state has no survivors have no row for it.
    """
    held = written(judged.groupBy("part", *filters, "good", "toxic").agg(F.count(F.lit(1)).alias("n")))
    # the same columns in every state, so that Spark compiles them once
    total = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    lost = F.create_map(*[c for f in filters for c in (F.lit(f), F.struct(total(F.col(f), "removed"), total(F.col(f) & F.col("good"), "good_lost"), total(F.col(f) & F.col("toxic"), "toxic_lost")))])
    sums = [F.sum("n").alias("n"), lost.alias("lost")]
    counted: dict[frozenset[str], DataFrame] = {}  # by state, whatever the order that led there
    persisted: list[DataFrame] = []

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        if not rest or state in counted:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        persisted.append(survivors)
        counted[state] = survivors.groupBy("part").agg(*sums).withColumn("state", F.lit("".join(sorted(state))))
        for f in rest:
            visit(state | {f}, survivors.where(~F.col(f)))

    # survivors stay where their part is, so that no state shuffles
    visit(frozenset(), held.repartition("part"))
    out = written(reduce(DataFrame.unionByName, counted.values()))
    for survivors in reversed(persisted):
        survivors.unpersist()
    return out


def audit(judged: DataFrame, filters: tuple[str, ...] = ("A", "B", "C", "D", "E")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step.

    ``kept`` counts what is left after the step, ``removed`` what it removes, ``redundant`` what it would have
    removed had it not gone earlier, ``unique_fails`` what its filter alone fails, ``shapley`` its filter's
    removals summed over all orders.  Parts of which nothing is left have zeros; no parts, no rows.
    """
    # a part has few states (31, of five filters), whatever the tables hold
    parts = edges(judged, filters).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "lost")))).alias("states"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    walked = parts.select("part", "states", F.explode(orders).alias("filter_order"))
    letters = F.split("filter_order", "")
    walked = walked.select("*", F.posexplode(letters).alias("before", "filter"))
    others = F.array_join(F.array_sort(F.filter(letters, lambda f: f != F.col("filter"))), "")
    state = F.array_join(F.array_sort(F.slice(letters, F.lit(1), F.col("before"))), "")
    seen = walked.select("part", "filter_order", (F.col("before") + 1).cast("int").alias("step"), "filter", *[F.col("states")[k].alias(c) for k, c in ((F.lit(""), "root"), (state, "at"), (others, "last"))])
    lost = lambda place, c: F.coalesce(F.col(place)["lost"][F.col("filter")][c], F.lit(0)).cast("long")
    removed = lost("at", "removed")
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    steps = seen.select(
        "part", "filter_order", "step", "filter", (F.coalesce(F.col("at")["n"], F.lit(0)) - removed).alias("kept"), removed.alias("removed"), (lost("root", "removed") - removed).alias("redundant"),
        lost("last", "removed").alias("unique_fails"), lost("at", "good_lost").alias("good_lost"), lost("at", "toxic_lost").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", shapley).drop("filter")


def op12_permutation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters by source, over all ``documents``; edge cases are ``verdicts``'s and ``audit``'s."""
    docs = table(spark, sf_dir, "documents")
    return audit(verdicts(docs, table(spark, sf_dir, "labels"), rules(F.coalesce(F.col("text"), F.lit("")))))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             list_filter([CASE WHEN len(words) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                          CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
                          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END], lambda x: x IS NOT NULL) AS fails
      FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT '' AS o UNION ALL SELECT o || f FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, CAST(step AS INT) AS step, substr(o, step, 1) AS f, string_split(substr(o, 1, step), '') AS upto FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM v GROUP BY ALL),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT list_has_any(fails, upto)), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (list_intersect(fails, upto) = [f]), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (list_contains(fails, f) AND len(list_intersect(fails, upto)) > 1), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (list_intersect(fails, upto) = [f]), 0)::BIGINT AS good_lost,
             coalesce(sum(n_toxic) FILTER (list_intersect(fails, upto) = [f]), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
