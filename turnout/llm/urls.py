"""URL filters: host and path rules, and a character language-model ratio for what no rule fits.

Two variable-order Markov models over characters, of the URLs that rules allow and of those that
they block, are smoothed by Witten-Bell interpolation from order 0 to ORDER. A character's score
is the log ratio of both models at the longest context in which it was seen; a URL's score is the
mean over its characters. The threshold lies between the mean scores of the two training sets, in
proportion to their spreads. All of it is DataFrame functions.

Whole URLs are modelled, with scheme, query and fragment. Digits are folded to one, as the numbers
in URLs (ids, pages, dates) differ from one to the next without telling anything: a model would see
each of them once. So the work and the joins follow the number of distinct folded URLs.

A character is one row, with the longest context before it. Shorter contexts are taken of the
distinct longest ones, of which there are few: in training after their counts are summed, in scoring
when each is given its ratio, which the characters then get by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import free_name, stored

ORDER = 4
SYMBOLS = 256.0
#: Characters that are cut from a URL at once, so that work on a very long one doesn't grow with its square.
PIECE = 256
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts like its own.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; null without any."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """A row for each character of ``text`` and its end, as the last of the ``gram`` of the ``order``
    characters before it and itself."""
    n, width = F.length("text") + 1, F.lit(PIECE)
    padded = F.concat(F.lit(_START * order), F.col("text"), F.lit(_END))
    pieces = texts.select("*", F.explode(F.sequence(F.lit(0), ((n - 1) / PIECE).cast("int"))).alias("p")).withColumns({
        "piece": F.substring(padded, F.col("p") * PIECE + 1, F.lit(PIECE + order)),
        "size": F.least(width, n - F.col("p") * PIECE)})
    return pieces.select("*", F.explode(F.sequence(F.lit(1), "size")).alias("at")).withColumn(
        "gram", F.substring("piece", F.col("at"), F.lit(order + 1))).select(*texts.columns, "gram")


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """A row for each context length k: the end of ``gram`` with k + 1 characters as ``short``."""
    return grams.select("*", F.explode(F.array(*map(F.lit, range(order + 1)))).alias("k")).withColumn(
        "short", F.substring("gram", order + 1 - F.col("k"), F.col("k") + 1))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, k, ratio): log ratio of the two models for each context and character seen.

    ``texts`` has distinct texts with their numbers of allowed and blocked URLs (allowed,
    blocked)."""
    longest = _grams(texts, order).groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    counted = stored(_shorter(longest, order).groupBy(F.col("short").alias("gram"), "k").agg(
        F.sum("allowed").cast("double").alias("allowed"), F.sum("blocked").cast("double").alias("blocked")),
        "grams")
    context = F.expr("substring(gram, 1, k)")
    known = counted.groupBy(context.alias("context"), F.col("k").alias("size")).agg(*[
        f.alias(n) for c in ("allowed", "blocked") for f, n in
        ((F.sum(c), f"{c}_all"), (F.sum((F.col(c) > 0).cast("double")), f"{c}_kinds"))])
    known = stored(known, "contexts")
    level, levels = None, []
    for k in range(order + 1):
        own = counted.where(F.col("k") == k).withColumn("context", context).join(
            known.where(F.col("size") == k).drop("size"), "context")
        if level is None:
            own = own.withColumn("low_allowed", F.lit(1 / SYMBOLS)).withColumn("low_blocked", F.lit(1 / SYMBOLS))
        else:
            own = own.withColumn("rest", F.expr("substring(gram, 2, k)")).join(
                level.select(F.col("gram").alias("rest"), F.col("p_allowed").alias("low_allowed"),
                             F.col("p_blocked").alias("low_blocked")), "rest")

        def mixed(c):
            total = F.col(f"{c}_all") + F.col(f"{c}_kinds")
            return F.when(total > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"low_{c}")) / total).otherwise(
                F.col(f"low_{c}"))

        level = stored(own.select("gram", "k", mixed("allowed").alias("p_allowed"),
                                  mixed("blocked").alias("p_blocked")), "level")
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.select("gram", "k", (F.log("p_allowed") - F.log("p_blocked")).alias("ratio"))


def scores(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, score): the mean over characters of the log ratio at the longest context seen."""
    characters = _grams(texts.select("text"), order)
    ratios = _shorter(characters.select("gram").distinct(), order).join(
        model.select(F.col("gram").alias("short"), "ratio"), "short").groupBy("gram").agg(
        F.max(F.struct("k", "ratio"))["ratio"].alias("ratio"))
    return characters.join(stored(ratios, "ratios"), "gram").groupBy("text").agg(
        (F.sum("ratio") / (F.length("text") + 1)).alias("score"))


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` (with url) and host, path, rule, verdict, score of each row.

    A null URL or one without ``://`` has empty host and path. What no rule fits and no character
    of the models is in is allowed, as is everything if the rules allow or block nothing. Repeated
    rows stay; columns of ``pages`` with these names are replaced.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("rule", "verdict", "score").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text_name = free_name(pages, "_text")
    rows = rows.withColumns({"rule": rule, "verdict": verdict, text_name: F.regexp_replace(
        F.coalesce("url", F.lit("")), "[0-9]", "0")})
    count = lambda what: F.sum((F.col("verdict") == what).cast("long")).alias(f"n_{what}")
    texts = stored(rows.groupBy(F.col(text_name).alias("text")).agg(count("allow"), count("block")).select(
        "text", F.coalesce("n_allow", F.lit(0)).alias("allowed"), F.coalesce("n_block", F.lit(0)).alias("blocked")),
        "url-texts")
    sums = texts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    if not (sums.a and sums.b):
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn(
            "verdict", F.coalesce("verdict", F.lit("allow"))).drop(text_name)
    model = stored(train(texts.where("allowed + blocked > 0"), order), "url-model")
    found = stored(scores(texts, model, order).join(texts, "text"), "url-scores")
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("score") ** 2 * F.col(c)) / F.sum(c)
                                         - (F.sum(F.col("score") * F.col(c)) / F.sum(c)) ** 2))
    s = found.agg(*[f.alias(n) for c, n, f in (("allowed", "ma", None), ("blocked", "mb", None))
                    for f in (F.sum(F.col("score") * F.col(c)) / F.sum(c),)],
                  spread("allowed").alias("sa"), spread("blocked").alias("sb")).first()
    width = s.sa + s.sb
    threshold = (s.ma * s.sb + s.mb * s.sa) / width if width > 0 else (s.ma + s.mb) / 2
    out = rows.join(found.select(F.col("text").alias(text_name), "score"), text_name, "left")
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", by_model)).drop(text_name)
