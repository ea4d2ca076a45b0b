"""URL filters: fixed host and path rules, and mined association rules.

Rules name a host and the start of a path. URLs that no rule fits are judged by
association rules: FP-growth mines combinations of URL tokens that go with the
label "block" or "allow" on labelled URLs; rules are pruned by support and
confidence and matched through an inverted index from tokens to rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import ascii_lower, saved
from tastemill.operators.skew import fits_broadcast, lookup_join

# Host and path, and the verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
LABELS = ("class=allow", "class=block")
LEAST_SUPPORT = 0.02
LEAST_CONFIDENCE = 0.8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host equals or is a parent of ``host`` and whose path starts ``path``; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL: scheme, host labels, path steps, parameter names.

    A path step of digits is one token, whatever its number.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.transform(steps, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("number")).otherwise(F.substring(x, 1, 64)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), ascii_lower(F.coalesce(F.substring_index(url, "://", 1), F.lit(""))))),
            F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
            F.transform(named, lambda x: F.concat(F.lit("step="), x)),
            F.transform(names, lambda x: F.concat(F.lit("name="), F.substring(x, 1, 64))),
        )
    )


def mined_rules(
    labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE
) -> DataFrame:
    """Rules from ``tokens`` and ``label``: ``antecedent``, ``label``, ``confidence``, ``support``.

    A rule is left out if another with a part of its tokens, or the same, is at
    least as confident. There are at most as many tokens per URL and as many
    rules as the support allows, whatever the number of URLs.
    """
    n = labelled.count()
    # Rare tokens can be in no rule; without them transactions are short.
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    frequent = saved(counts.where(F.col("count") >= least_support * n).select("token"))
    keyed = labelled.select(F.array_sort("tokens").alias("tokens"), "label").groupBy("tokens", "label").count()
    keyed = saved(keyed.withColumn("row", F.monotonically_increasing_id()))
    side = F.broadcast(frequent) if fits_broadcast(frequent) else frequent
    kept = keyed.select("row", F.explode("tokens").alias("token")).join(side, "token", "left_semi")
    kept = kept.groupBy("row").agg(F.collect_set("token").alias("kept"))
    rows = keyed.join(kept, "row", "left").select(
        F.array_append(F.coalesce("kept", F.array().cast("array<string>")), F.concat(F.lit("class="), "label")).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"),
    )
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(rows.select("items"))
    rules = saved(
        model.associationRules.where(F.array_contains(F.lit([*LABELS]), F.get("consequent", 0)))
        .where(~F.exists("antecedent", lambda x: F.array_contains(F.lit([*LABELS]), x)))
        .select(
            F.array_sort("antecedent").alias("antecedent"),
            F.substring_index(F.get("consequent", 0), "=", -1).alias("label"),
            F.round("confidence", 6).alias("confidence"),
            F.round("support", 9).alias("support"),
        )
    )
    # Each smaller rule is met through its first token.
    shorter = rules.select(
        F.get("antecedent", 0).alias("token"), F.col("antecedent").alias("part"), F.col("confidence").alias("better")
    )
    longer = rules.select("*", F.explode("antecedent").alias("token"))
    beaten = (
        longer.join(shorter, "token")
        .where((F.size("part") < F.size("antecedent")) & (F.col("better") >= F.col("confidence")))
        .where(F.size(F.array_except("part", "antecedent")) == 0)
        .select("antecedent", "label")
        .distinct()
    )
    return rules.join(beaten, ["antecedent", "label"], "left_anti")


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The label of the best matching rule for each row of ``url`` and ``tokens``; rows without one are left out.

    Each rule is indexed under its rarest token, so a URL meets few rules, and
    the other tokens are checked. The most confident rule wins, then the one
    with more support, then with more tokens, then by its tokens and label.
    """
    often = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    under = rules.select("*", F.explode("antecedent").alias("token")).join(often, "token")
    index = under.groupBy("antecedent", "label", "confidence", "support").agg(
        F.min_by("token", F.struct("count", "token")).alias("token")
    )
    index = saved(index)
    side = F.broadcast(index) if fits_broadcast(index) else index
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(side, "token")
    met = met.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent"), "antecedent", "label")
    return met.groupBy("url").agg(F.max(F.struct(rank.alias("rank"), "label", "antecedent")).alias("best")).select(
        "url", F.col("best.label").alias("mined"), F.array_join("best.antecedent", " ").alias("mined_rule"), F.col("best.rank.confidence").alias("confidence")
    )


def url_verdicts(
    pages: DataFrame,
    rules: dict[str, str] = RULES,
    *,
    labels: DataFrame | None = None,
    least_support: float = LEAST_SUPPORT,
    least_rows: int | None = None,
    least_confidence: float = LEAST_CONFIDENCE,
    id_column: str = "page_id",
) -> DataFrame:
    """Judge every URL.

    URLs that a fixed rule fits are the labelled ones, and those of ``labels``, a table of
    ``url`` and ``label`` ("allow" or "block"; other rows say nothing). ``least_rows``, where given, is the
    number of labelled rows that a rule needs, instead of a share: a host of a few
    dozen pages can then be learnt, however many rows there are. Columns: the id,
    ``host``, ``path``, ``rule``, ``verdict`` ("allow" or "block": the rule's,
    else the mined rules', else "allow"), ``mined_rule`` and ``confidence``. A
    null URL, or one without ``://``, has an empty host and path and no rule; a
    null one is allowed. Repeated rows stay repeated, null ids stay null, an
    empty table gives an empty one; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(id_column, "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda found, r: F.when(F.col("rule") == r, rules[r]).otherwise(found), rules, F.lit(None).cast("string"))
    rows = rows.withColumn("ruled", by_rule)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    labelled = rows.where("ruled is not null").select(tokens, F.col("ruled").alias("label"))
    if labels is not None:
        told = labels.where("url is not null and label in ('allow', 'block')").select("url", "label")
        told = told.select("url", host.alias("host"), path.alias("path"), "label")
        labelled = labelled.unionByName(told.select(tokens, "label"))
    n = labelled.count()
    none = [F.lit(None).cast("string").alias("mined"), F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence")]
    # Only open URLs are looked up, so that the others need no shuffle.
    asked, rest = rows.where("ruled is null and url is not null"), rows.where("ruled is not null or url is null").select("*", *none)
    if n:
        support = least_support if least_rows is None else min(1.0, least_rows / n)
        mined = mined_rules(labelled, support, least_confidence)
        open_urls = asked.groupBy("url", "host", "path").count()
        verdicts = saved(rule_verdicts(open_urls.select("url", tokens), mined))
        asked = lookup_join(asked, verdicts, "url")
    else:
        asked = asked.select("*", *none)
    return asked.unionByName(rest).select(
        id_column,
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "mined", F.lit("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )
