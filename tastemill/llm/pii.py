"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give e-mail addresses, IP addresses, card and telephone
numbers. Beyond them, identifiers are looked for that have no format of their
own, such as keys and passwords: values after a short lexical context like
``token =``. Seed values (long hexadecimal strings, card numbers) induce such
contexts; contexts and values then score each other over the graph of their
joint occurrences; contexts of high confidence mark whatever value follows them.

Everything is written with SQL functions. Positions are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
# Matches of these equal the leftmost matches of the plain patterns: quantifiers
# give nothing back because nothing that follows could use it, and a match can
# only start where a run of its first characters does, or where the last match
# ended. So long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be worth trying.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
IP_VALUE = rf"^(?:0+|{BYTE})(?:\.(?:0+|{BYTE})){{3}}$"

# A value after a context: six or more identifier characters, a digit among them.
VALUE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{6,}+"
CONTEXT_CHARS = 48
CONTEXT = r"([\p{L}\p{N}_]{2,32})[\x20\t\"']{0,4}([=:])[\x20\t\"']{0,4}$"
SEED = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"
ROUNDS = 3
LEAST_CONFIDENCE = 0.6
LEAST_VALUES = 3
BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, value, left), in order.

    ``left`` holds the characters before the match, ``CONTEXT_CHARS`` at most,
    back to the match before it. Lengths are summed up in blocks, so the work
    stays linear in the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.struct(found.alias("found"), between.alias("between"))

    def spans(both: Column) -> Column:
        found, between = both["found"], both["between"]
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
        total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
        starts = lambda sizes: F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, b: F.struct(
                (acc["at"] + total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))).alias("at"),
                F.array_append(acc["out"], acc["at"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        summed = F.struct(sizes.alias("sizes"), starts(sizes).alias("starts"))

        def placed(s: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = F.get(s["starts"], block) + total(F.slice(s["sizes"], block * BLOCK + 1, i % BLOCK))
                start = start + F.length(F.get(between, i))
                left = F.get(between, i)
                return F.struct(
                    start.alias("start"),
                    (start + F.length(m)).alias("end"),
                    m.alias("value"),
                    F.right(left, F.lit(CONTEXT_CHARS)).alias("left"),
                )

            return F.transform(found, one)

        return F.element_at(F.transform(F.array(summed), placed), 1)

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    return F.coalesce(F.when(F.size(found) > 0, F.element_at(F.transform(F.array(parts), spans), 1)), none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    digits = F.reverse(digits_of(value))

    def term(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + term(i))
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP_VALUE),
    "card": lambda v: F.when(F.length(digits_of(v)).between(16, 19), passes_luhn(v)).otherwise(False),
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a fixed pattern; failing ones are dropped without another try."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    found = F.when(text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind]), lambda m: VALID[kind](m["value"])))
    return F.coalesce(found, none)


def _described(documents: DataFrame, id_column: str) -> DataFrame:
    """One row per document, without its text: its key, base spans, and values after a context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    rows = documents.select(
        F.col(id_column).alias("id"),
        F.xxhash64(id_column, text).alias("row_key"),
        *[base_spans(text, kind).alias(kind) for kind in KINDS],
        F.coalesce(F.when(text.rlike(r"[=:]"), F.when(text.rlike(r"[0-9]"), matches(text, VALUE))), none).alias("values"),
    )

    def free(v: Column) -> Column:
        clash = lambda b: (b["start"] < v["end"]) & (v["start"] < b["end"])
        return reduce(lambda a, b: a & b, [~F.exists(F.col(kind), clash) for kind in KINDS])

    def with_context(v: Column) -> Column:
        context = F.concat(F.regexp_extract(v["left"], CONTEXT, 1), F.regexp_extract(v["left"], CONTEXT, 2))
        return F.struct(v["start"], v["end"], v["value"], F.lower(context).alias("context"))

    short = lambda m: F.struct(m["start"], m["end"])
    return rows.select(
        "id",
        "row_key",
        *[F.transform(kind, short).alias(kind) for kind in KINDS],
        F.filter(F.transform(F.filter("values", free), with_context), lambda v: v["context"] != "").alias("values"),
    )


def trusted_contexts(
    described: DataFrame,
    rounds: int = ROUNDS,
    least_confidence: float = LEAST_CONFIDENCE,
    least_values: int = LEAST_VALUES,
) -> DataFrame:
    """Contexts that mark identifiers: ``context`` and its ``confidence``.

    A context's confidence is the mean score of its different values, with one
    value of score zero added; a value's score is 1 for a seed, else the chance
    that at least one of its contexts is right. Values and contexts are counted
    over all documents.
    """
    seen = described.select(F.explode("values").alias("v")).select("v.context", "v.value")
    edges = saved(seen.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n")))
    scores = edges.select("value").distinct().withColumn("score", F.col("value").rlike(SEED).cast("double"))
    contexts = None
    for _ in range(rounds):
        contexts = saved(
            edges.join(scores, "value")
            .groupBy("context")
            .agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count(F.lit(1)).alias("n_values"))
        )
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        reached = edges.join(contexts.where(F.col("confidence") >= least_confidence), "context").groupBy("value")
        scores = (
            edges.select("value")
            .distinct()
            .join(reached.agg((1 - wrong).alias("by_context")), "value", "left")
            .select(
                "value",
                F.when(F.col("value").rlike(SEED), 1.0).otherwise(F.coalesce("by_context", F.lit(0.0))).alias("score"),
            )
        )
    return contexts.where((F.col("confidence") >= least_confidence) & (F.col("n_values") >= least_values)).select(
        "context", "confidence"
    )


def _found(documents: DataFrame, id_column: str, **limits: float) -> DataFrame:
    """Rows of ``_described`` with ``secret``, the spans after trusted contexts."""
    described = saved(_described(documents, id_column))
    trusted = trusted_contexts(described, **limits)
    places = (
        described.where(F.size("values") > 0)
        .select("row_key", F.explode("values").alias("v"))
        .select("row_key", "v.start", "v.end", "v.context")
        .distinct()
        .join(trusted, "context", "left_semi")
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("secret"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return described.drop("values").join(places, "row_key", "left").withColumn("secret", F.coalesce("secret", none))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def personal_data(documents: DataFrame, *, id_column: str = "doc_id", **limits: float) -> DataFrame:
    """Personal data in every whole text.

    Columns: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``base_sha256``, ``n_secret`` and ``spans``. A span is ``kind:start:end``;
    spans of the kind ``secret`` come from contexts and never overlap one of the
    fixed kinds. A null or empty text has no spans (an empty string, and its
    digest). Repeated rows stay repeated, null ids stay null, an empty table
    gives an empty one, and other columns are not read.
    """
    found = _found(documents, id_column, **limits)
    base = F.concat(*[_named(kind) for kind in KINDS])
    return found.select(
        F.col("id").alias(id_column),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.size("secret").cast("long").alias("n_secret"),
        F.array_join(F.concat(base, _named("secret")), ",").alias("spans"),
    )


def redacted(documents: DataFrame, *, id_column: str = "doc_id", **limits: float) -> DataFrame:
    """``documents`` with each span of personal data replaced by its kind, as ``[EMAIL]``.

    Overlapping spans become one, named after the first. Null texts and texts
    without personal data stay unchanged; ``n_chars``, if there, is set to the
    new number of code points. Clashing extra columns pass through.
    """
    kinds = [*KINDS, "secret"]

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind.upper()}]").alias("name")))

    marked = F.concat(*map(named, kinds))
    spans = (
        _found(documents, id_column, **limits)
        .select("row_key", F.sort_array(marked).alias("spans"))
        .where(F.size("spans") > 0)
        .dropDuplicates(["row_key"])
        .select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    )
    keyed = documents.withColumn("__row_key", F.xxhash64(id_column, F.coalesce(F.col("text"), F.lit(""))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), s["name"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.aggregate("__spans", start, step, rest))
    joined = keyed.join(spans, "__row_key", "left").withColumn("__text", text)
    columns = []
    for name in documents.columns:
        if name == "text":
            columns.append(F.col("__text").alias("text"))
        elif name == "n_chars":
            kind = documents.schema[name].dataType
            new = F.when(F.col("__spans").isNull(), F.col(name)).otherwise(F.length("__text").cast(kind))
            columns.append(new.alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)
