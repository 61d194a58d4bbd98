"""URL filter: host and path rules, and a ratio of two character language models.

URLs that a rule allows or blocks train one smoothed variable-order Markov model each; the
others are judged by the difference of their log likelihoods per character, against a
threshold calibrated on URLs that the models did not see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import lower_ascii, packed, small_or_shuffled, written

#: Characters of context at most.
ORDER = 4
#: Weight of the shorter context's estimate, in observations.
SMOOTHING = 2.0
#: Characters that a model reckons with.
ALPHABET = 256
#: One URL in so many is left to the calibration.
HELD_OUT = 5
#: Differences are calibrated in steps of this size within plus and minus REACH.
STEP, REACH = 0.01, 8.0
#: Stands before a URL and after it.
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class UrlRule:
    """``where`` is a host, a slash and the beginning of a path; it holds for subdomains too."""

    verdict: str
    where: str


# Fixed values.
RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    there = F.coalesce(at > 0, F.lit(False))
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct (where, verdict), else null; of equal lengths the first."""
    fitting = []
    for rule in sorted(rules, key=lambda r: -len(r.where)):
        name, _, begin = rule.where.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith("/" + begin)
        fitting.append((fits, F.struct(F.lit(rule.where).alias("where"), F.lit(rule.verdict).alias("verdict"))))
    if not fitting:
        return F.lit(None).cast("struct<where:string,verdict:string>")
    return reduce(lambda found, x: found.when(*x), fitting[1:], F.when(*fitting[0]))


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """Every character of ``text`` and its end as a gram of ORDER + 1 characters, ``keep`` beside it."""
    marked = F.concat(F.lit(START * ORDER), F.col("text"), F.lit(END))
    return texts.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(marked, i, F.lit(ORDER + 1)))).alias("gram"))


def fit(texts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | the others) of the accepted less the rejected model.

    ``texts`` holds (text, accepted); ``accepted`` is null for texts that are only scored.
    All grams of all texts are in the result.  A context that was seen mixes its own counts
    with the estimate of the context that is one character shorter, down to no context and
    an equal chance for each of ALPHABET characters.
    """
    good, bad = F.count(F.when(F.col("accepted"), 1)), F.count(F.when(~F.col("accepted"), 1))
    counted = written(_grams(texts, "accepted").groupBy("gram").agg(good.alias("good"), bad.alias("bad")), "url-grams")
    both = ("good", "bad")
    estimate = None
    for k in range(1, ORDER + 2):
        seen = counted.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(*[F.sum(c).alias(c) for c in both])
        if estimate is None:
            totals = seen.agg(*[F.sum(c).alias(f"{c}_all") for c in both])  # one row
            mixed = seen.crossJoin(F.broadcast(totals))
            lower = {c: F.lit(1 / ALPHABET) for c in both}
        else:
            context = seen.groupBy(F.substring("g", 1, k - 1).alias("context")).agg(*[F.sum(c).alias(f"{c}_all") for c in both])
            mixed = (
                seen.withColumn("context", F.substring("g", 1, k - 1)).join(context, "context")
                .withColumn("shorter", F.right("g", F.lit(k - 1))).join(estimate, "shorter")
            )
            lower = {c: F.col(f"p_{c}") for c in both}
        chance = {
            c: (F.col(c) + SMOOTHING * lower[c]) / (F.coalesce(f"{c}_all", F.lit(0)) + SMOOTHING) for c in both
        }
        named = "gram" if k == ORDER + 1 else "shorter"
        made = mixed.select(F.col("g").alias(named), *[chance[c].alias(f"p_{c}") for c in both])
        estimate = written(made, f"url-model-{k}")
    return estimate.select("gram", F.round(F.log("p_good") - F.log("p_bad"), 9).alias("ratio"))


def differences(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, difference): mean log-likelihood difference per character, the end included."""
    total = F.sum(F.col("ratio").cast("decimal(28,9)"))
    return (
        _grams(texts, "text").join(small_or_shuffled(model), "gram")
        .groupBy("text").agg((total.cast("double") / F.count(F.lit(1))).alias("difference"))
    )


def threshold(scored: DataFrame) -> float:
    """The difference with the lowest mean error over (difference, accepted); 0 without both kinds.

    Counts are kept per step of the difference, of which there are 2 * REACH / STEP.
    """
    step = F.round(F.least(F.greatest("difference", F.lit(-REACH)), F.lit(REACH)) / STEP).cast("int")
    bins = scored.groupBy(step.alias("step")).agg(
        F.count(F.when(F.col("accepted"), 1)).alias("good"), F.count(F.when(~F.col("accepted"), 1)).alias("bad")
    )
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    errors = bins.select(
        "step",
        (F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(every)
         + (F.sum("bad").over(every) - F.coalesce(F.sum("bad").over(below), F.lit(0))) / F.sum("bad").over(every)).alias("error"),
    ).filter("error is not null")
    best = errors.orderBy(F.round("error", 9), F.abs("step"), "step").first()
    return 0.0 if best is None else (best["step"] - 0.5) * STEP


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, difference.

    The rule's verdict stands where a rule fits.  The others are allowed if their mean
    log-likelihood difference (``difference``, given for every row) reaches the calibrated
    threshold; a null url counts as an empty text.  With no URL that the rules allow, or
    none that they block, all others are allowed.
    """
    url = F.col("row.url")
    host, path = host_and_path(url)
    rows = (
        packed(pages)
        .select("row.page_id", host.alias("host"), path.alias("path"), F.coalesce(url, F.lit("")).alias("text"))
        .withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "text", F.col("found.where").alias("rule"), F.col("found.verdict").alias("verdict"))
    )
    # Equal URLs are scored once and weigh once in the models.
    texts = written(rows.groupBy("text").agg(F.first("verdict").alias("verdict")), "urls")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    accepted = F.when(~held, F.col("verdict") == "allow")
    scores = written(differences(texts, fit(texts.select("text", accepted.alias("accepted")))), "url-scores")
    judged = texts.filter(held & F.col("verdict").isNotNull()).join(scores, "text")
    kinds = {r[0] for r in texts.select("verdict").distinct().collect()} - {None}  # allow, block
    limit = threshold(judged.select("difference", (F.col("verdict") == "allow").alias("accepted")))
    by_model = F.when(F.col("difference") >= limit, "allow").otherwise("block") if len(kinds) == 2 else F.lit("allow")
    return rows.join(scores, "text").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "difference"
    )
