"""Mixing by soft membership, with DataFrame functions only.

A classifier learned from a labelled table gives every document a posterior over domains.
Projected-gradient least squares then finds a nonnegative rate for every document, such that
the expected tokens of each domain (the sum of rate x tokens x posterior) meet their targets:
each round moves every document's rate against its gradient and projects it onto the
document's bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import absent, table, written


@dataclass(frozen=True)
class MixConfig:
    """``sample``: labelled rows to learn from, at most; ``stem``: letters of a word that count;
    ``buckets``: of hashed stems; ``prior``: the weight, in words, of the corpus in a domain's
    frequencies; ``deviation``: how many standard deviations the documents of a domain that hold a
    bucket must differ from all documents for the bucket to count by itself; ``ridge``: what moving a
    rate costs; ``least``: the least rate of a document that is as likely in the anchor's domain as in
    any other; ``least_others``, ``most``: the least of any other document, and the greatest of all; ``removed``: domains whose documents, likelier in one of them than in any other domain,
    go whatever the targets; ``rounds``: at most; ``tolerance``: of the last round's moves (root of
    their mean square, by tokens); ``chained``: rounds after which the rates are written."""

    sample: int = 12_000
    stem: int = 5
    buckets: int = 1 << 16
    prior: float = 200.0
    deviation: float = 3.5
    ridge: float = 1e-4
    least: float = 0.0
    least_others: float = 0.0
    most: float | None = None
    removed: tuple[str, ...] = ()
    rounds: int = 100
    tolerance: float = 1e-6
    chained: int = 8


def _words(text: Column) -> Column:
    """What stands between white space and the marks of sentences; an empty text has one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n\f\u000b.,;:!?")), r"[\s.,;:!?]+")


def bucketed(docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """row, id, the columns ``keep`` as keep0 and so on, and ``buckets``: of each word's first letters, in lower case; none of a null or wordless text.

    A written table, so that ``row`` is the same whoever reads it, and words are split once.
    """
    (words,) = absent(docs, "words")
    split = docs.select("*", F.filter(_words(F.col(text_col)), lambda w: w != "").alias(words))
    bucket = lambda w: F.pmod(F.xxhash64(F.lower(F.substring(w, 1, config.stem))), F.lit(config.buckets)).cast("int")
    return written(split.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.transform(words, bucket).alias("buckets")))


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], config: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep``, ``tokens`` (words) and ``posterior`` (an array, in the order of ``domains``) of every row of ``docs``.

    ``labelled`` has the id and ``domain``; ids and domains that are null or unknown are left out,
    and of an id's several domains the first in order counts, and of its several texts the longest.  The classifier is
    naive Bayes over buckets of words' first letters.  A bucket counts by itself if the share of a domain's
    documents that hold it stands out; all others count as one, as common words differ between domains only by
    what else the domains differ in, a language for instance, and that difference would count once a word.
    A text without words, or null, has the prior of the labelled rows; without labelled rows, every domain is as likely.
    """
    size = len(domains)
    rows = bucketed(docs, config, id_col, text_col, keep)
    chosen = (
        labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(config.sample)
    )
    # the sample has config.sample rows at most
    first = rows.select("id", "buckets").join(F.broadcast(written(chosen)), "id").groupBy("id", "domain").agg(F.max_by("buckets", F.struct(F.size("buckets"), F.xxhash64("buckets"))).alias("buckets"))
    texts = written(first.select("domain", "buckets"))
    by_domain = {r[0]: (r[1], r[2]) for r in texts.groupBy("domain").agg(F.count(F.lit(1)), F.sum(F.size("buckets"))).collect()}
    docs_in = [float(by_domain.get(d, (0, 0))[0]) for d in domains]
    words_in = [float(by_domain.get(d, (0, 0))[1]) for d in domains]
    everyone, everything = max(1.0, sum(docs_in)), max(1.0, sum(words_in))
    each = texts.select("domain", F.explode("buckets").alias("bucket"), F.lit(0).alias("d")).unionByName(texts.select("domain", F.explode(F.array_distinct("buckets")).alias("bucket"), F.lit(1).alias("d")))
    counted = each.groupBy("bucket").agg(*[F.sum(((F.col("domain") == x) & (F.col("d") == k)).cast("double")).alias(f"{n}{i}") for k, n in enumerate("nd") for i, x in enumerate(domains)])
    plus = lambda n: sum((F.col(f"{n}{i}") for i in range(size)), F.lit(0.0))
    counted = counted.withColumns({"share": plus("n") / everything, "held": plus("d") / everyone})
    stands_out = F.lit(False)
    for i, n in enumerate(docs_in):
        spread = F.sqrt(n * F.col("held") * (1 - F.col("held")) + 1)
        stands_out |= F.abs(F.col(f"d{i}") - n * F.col("held")) >= config.deviation * spread
    counted = written(counted.withColumn("alone", stands_out))  # config.buckets rows at most
    sums = counted.where("alone").agg(F.coalesce(F.sum("share"), F.lit(0.0)), *[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(size)]).first()
    rest_share = max(1e-9, 1 - sums[0])
    rest = [math.log(float(n - sums[i + 1] + config.prior * rest_share) / (n + config.prior) / rest_share) for i, n in enumerate(words_in)]
    ratio = [F.when(F.col("alone"), F.log((F.col(f"n{i}") + config.prior * F.col("share")) / (n + config.prior) / F.col("share")) - rest[i]).otherwise(0.0) for i, n in enumerate(words_in)]
    # -1 stands for a document as such
    none = docs.sparkSession.range(1).select(F.lit(-1).alias("bucket"), *[F.lit(0.0).alias(f"w{i}") for i in range(size)])
    weights = F.broadcast(counted.select("bucket", *[x.alias(f"w{i}") for i, x in enumerate(ratio)]).unionByName(none))
    prior = [math.log((n + 0.01) / (sum(docs_in) + 0.01 * size)) for n in docs_in]
    carried = ["id", *[f"keep{i}" for i in range(len(keep))], "tokens"]
    words = rows.withColumn("tokens", F.size("buckets").cast("long")).select("row", *carried, F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"))
    summed = words.join(weights, "bucket").groupBy("row").agg(*[F.first(c).alias(c) for c in carried], *[F.sum(f"w{i}").alias(f"w{i}") for i in range(size)])
    logs = F.array(*[F.round(F.col(f"w{i}") + F.col("tokens") * rest[i] + prior[i], 6) for i in range(size)])
    odds = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return (
        summed.select(*carried, logs.alias("logs"))
        .select(*carried, odds.alias("odds"))
        .select(F.col("id").alias(id_col), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "tokens", F.transform("odds", lambda x: F.round(x / total, 6)).alias("posterior"))
    )


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, anchor: str | None = None, config: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``: id, the columns ``keep``, tokens, posterior and ``rate``, its expected number of copies; beside them, alike in all rows, ``target`` and ``expected`` (shares of all tokens, in the order of domains' names) and ``residual``.

    ``targets`` gives each domain's share of ``budget`` times the tokens of ``docs``, or, with an
    ``anchor``, of as many tokens as make its own share ``budget`` times what it has.  Documents of
    ``removed`` domains have rate 0 and count for no target; what the others hold of such a domain, times
    ``budget``, is its target.  The rates minimise

        sum over domains of (expected - target)^2 / own + ridge x sum over documents of tokens x (rate - 1)^2

    (own: what a domain has at rates of 1; all in shares of all tokens) over rates within the bounds that the
    configuration sets: of ``least`` or more for documents that are likeliest in the anchor's domain.  As posteriors sum to 1, the slope changes by no more than 1 + ridge times a
    move, which gives the step.  Rounds have Nesterov's momentum, dropped where it points uphill, and end when
    ``residual``, the size of a round's moves, is within the tolerance, or after ``rounds``: a larger residual says that they haven't
    converged, and ``expected`` what of a target is out of reach.  A round is one aggregate over a narrow table.  Null and wordless
    texts have 0 tokens and the rate of their posterior; an empty table gives no rows.
    """
    domains = sorted(targets)
    if not domains or any(v < 0 for v in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative, and one of them positive")
    size = len(domains)
    rows = domain_posteriors(docs, labelled, domains, config, id_col, text_col, keep)
    p = [F.element_at("posterior", i + 1) for i in range(size)]
    gone = F.lit(False)
    if removed := [i for i, d in enumerate(domains) if d in config.removed]:
        others = [p[i] for i in range(size) if i not in removed]
        gone = F.array_max(F.array(*[p[i] for i in removed])) > F.array_max(F.array(*others, F.lit(0.0)))
    floor = F.lit(float(config.least_others))
    if anchor is not None and config.least:
        floor = F.when(p[domains.index(anchor)] >= F.array_max("posterior"), config.least).otherwise(floor)
    names = [id_col, *keep, "tokens", "posterior"]
    low, high, rate, last, to, slope_ = absent(rows, "low", "high", "rate", "last", "ahead", "down")
    rows = written(rows.select(*names, F.when(gone, 0.0).otherwise(floor).alias(low), F.when(gone, 0.0).alias(high)))
    here = F.when(F.col(high).isNull(), F.col("tokens")).otherwise(0)
    stats = rows.agg(F.sum("tokens"), *[F.sum(here * x) for x in p]).first()
    total, own = float(stats[0] or 0), [0.0] * size
    want, got, residual = [0.0] * size, [0.0] * size, 0.0
    state = rows.select("*", F.greatest(F.lit(1.0), low).alias(rate)).withColumn(rate, F.coalesce(high, rate)).withColumn(last, F.col(rate))
    if total:
        own = [float(x) / total for x in stats[1:]]
        whole = sum(targets.values())
        want = [targets[d] / whole * (budget if anchor is None else 1.0) for d in domains]
        if anchor is not None:
            i = domains.index(anchor)
            if not want[i]:
                raise ValueError("the anchor's target must be positive")
            want = [x * own[i] / want[i] * budget for x in want]
        want = [budget * o if i in removed else w for i, (w, o) in enumerate(zip(want, own, strict=True))]
        moments = lambda c: [F.sum(F.col("tokens") * c * x) / total for x in p]
        got = before = [float(x) for x in state.agg(*moments(F.col(rate))).first()]
        momentum = 1.0
        for n in range(1, config.rounds + 1):
            faster = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
            beta = (momentum - 1) / faster
            slope = [(g + beta * (g - b) - w) / o if o > 0 else 0.0 for g, b, w, o in zip(got, before, want, own, strict=True)]
            ahead = F.col(rate) + beta * (F.col(rate) - F.col(last))
            down = sum((x * s for x, s in zip(p, slope, strict=True)), F.lit(0.0))
            held = [*names, low, high]
            state = state.select(*held, F.col(rate).alias(last), ahead.alias(to), down.alias(slope_))
            moved = F.col(to) - (F.col(slope_) + config.ridge * (F.col(to) - 1)) / (1 + config.ridge)
            bounded = F.greatest(F.col(low), moved if config.most is None else F.least(F.lit(float(config.most)), moved))
            state = state.select(*held, last, to, F.coalesce(high, bounded).alias(rate))
            if n % config.chained == 0:
                state = written(state)
            move = F.col(rate) - F.col(to)
            now = state.agg(*moments(F.col(rate)), F.sum(F.col("tokens") * move * move) / total, F.sum(F.col("tokens") * move * (F.col(last) - F.col(rate))) / total).first()
            before, got = got, [float(x) for x in now[:size]]
            momentum = 1.0 if now[size + 1] > 0 else faster
            residual = math.sqrt(now[size])
            if residual <= config.tolerance:
                break
        if n % config.chained:
            state = written(state)  # a filter on the rate would be pushed through all rounds
    constant = lambda xs: F.array(*[F.lit(round(x, 9)) for x in xs])
    return state.select(*names, F.round(rate, 6).alias("rate"), constant(want).alias("target"), constant(got).alias("expected"), F.lit(round(residual, 9)).alias("residual"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: ``toxic``, else ``low`` or ``good`` quality; null labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


#: The shares of tokens of a training mix.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op6_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
    each = [(d, F.lit(i + 1)) for i, d in enumerate(sorted(TARGETS))]
    return mixed.select(
        "doc_id", "tokens", *[F.element_at("posterior", i).alias(f"p_{d}") for d, i in each], "rate", *[F.round(F.element_at("expected", i) - F.element_at("target", i), 9).alias(f"off_{d}") for d, i in each], "residual"
    )
