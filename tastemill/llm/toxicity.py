"""Toxic texts: insult labellers and a linear scorer of hashed words.

Two labellers vote toxic (0), clean (1) or nothing (-1) by a list of insults;
expectation-maximisation weighs their votes, as for quality. A linear scorer is
fitted on documents with a toxic label, where a table of labels is given, and on
those that the labellers call toxic; without labels on the labellers' posterior.
It sees every word, every pair of words and every word's beginning, hashed into
WORD_SLOTS slots, so it learns words that no list has.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import map_text, saved
from tastemill.operators.skew import fits_broadcast

SLOT_BITS = 20
WORD_SLOTS = 1 << SLOT_BITS
BEGINNING = 7
TOXIC_FROM = 0.5
REGULAR, ROUNDS = 3e-6, 80
# A slot takes part if it is in so many toxic texts, so many standard deviations above chance.
LEAST_TEXTS, LEAST_DEVIATION = 3, 4.0
# Documents that the scorer is fitted on, at most about so many with a label and so many without:
# a sample by hash, which stays in Spark: only the telling slots and their weights come to the driver.
FIT_ROWS = 8_000
VOTES = ("by_insults", "by_insult_kinds")
# ASCII letters and all of non-ASCII stay; signs beyond ASCII that stand beside words are blanks too.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SIGNS = [s.encode() for s in "“”„‘’«»–—…¿¡\u00a0"]
# Words that hardly occur but as insults, of the four languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid imbecile dumbass asshole assholes bastard bastards bitch "
    "bitches cunt scum scumbag loser losers pathetic worthless disgusting retard retarded fuck fucking fucker "
    "motherfucker shithead bullshit slut whore faggot "
    "idioten blöd blödmann trottel dummkopf arschloch arschlöcher wichser hurensohn schlampe fotze missgeburt vollidiot "
    "idiote idiotes crétin crétins imbécile connard connards connasse salaud salope enculé abruti abrutis débile ordure "
    "idiota idiotas estúpido estúpida estúpidos imbécil gilipollas cabrón cabrones puta pendejo pendejos mierda asqueroso".encode().split()
)


def words_of(text: str | None) -> list[bytes]:
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    if not raw.isascii():
        for sign in SIGNS:
            raw = raw.replace(sign, b" ")
    return raw.translate(LETTERS).split()


def insult_votes(words: list[bytes]) -> tuple[int, int]:
    n, insults = len(words), sum(map(INSULTS.__contains__, words))
    if not insults:
        return (1, 1) if n >= 20 else (-1, -1)
    return 0 if insults > 0.005 * n else -1, 0 if insults > 0.002 * n and len(INSULTS.intersection(words)) > 1 else -1


def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different slots of a text and their values: roots of the shares of its words."""
    n = len(words)
    own = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    starts = np.fromiter([zlib.crc32(w[:BEGINNING], 1) for w in words if len(w) > BEGINNING], np.uint32)
    pairs = own[:-1] * np.uint32(0x9E3779B1) ^ own[1:] * np.uint32(0x85EBCA77)
    every = np.concatenate([own, starts, pairs]) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)
    found, counts = np.unique(every, return_counts=True)
    return found.astype(np.int64), np.sqrt(counts / max(n, 1))


class Toxicity:
    """What was fitted: P(toxic) for each combination of votes, the scorer's slots, sorted, their weights and its bias."""

    def __init__(self, by_votes: dict[tuple[int, int], float], slots: np.ndarray, weights: np.ndarray, bias: float):
        self.by_votes, self.slots, self.weights, self.bias = by_votes, slots, weights, bias

    def score(self, text: str | None) -> tuple[tuple[int, int], float, bool]:
        """The votes, the scorer's probability of toxic, and whether it or the votes' reach TOXIC_FROM."""
        words = words_of(text)
        cast = insult_votes(words)
        found, values = slots(words)
        odds = self.bias
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, found), len(self.slots) - 1)
            odds += float(np.dot(values, np.where(self.slots[at] == found, self.weights[at], 0.0)))
        score = round(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), 6)
        return cast, score, score >= TOXIC_FROM or self.by_votes.get(cast, 0.0) >= TOXIC_FROM


def no_words(by_votes: dict[tuple[int, int], float], bias: float) -> Toxicity:
    """A scorer that knows no word."""
    return Toxicity(by_votes, np.empty(0, np.int64), np.empty(0), bias)


def fit_words(rows: DataFrame, entries: DataFrame, telling: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the ``telling`` slots and the bias.

    ``rows`` has a number ``row`` and ``toxic``, a probability; ``entries`` has
    ``row``, the place ``at`` of a slot among the telling ones, and its ``share``.
    Both classes of a row take part with their probabilities as weights.
    """
    n = len(telling)
    sparse = F.udf(lambda held: Vectors.sparse(n, [(at, share) for at, share in held or ()]), VectorUDT())
    # Only what a text holds of the telling slots is gathered, which its own words bound.
    held = entries.groupBy("row").agg(F.collect_list(F.struct("at", "share")).alias("held"))
    classes = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("toxic").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("toxic")).alias("weight")),
    )
    made = rows.join(held, "row", "left").select(sparse("held").alias("features"), F.explode(classes).alias("as"))
    made = saved(made.select("features", "as.label", "as.weight").where("weight > 0"))
    model = LogisticRegression(weightCol="weight", regParam=REGULAR, maxIter=ROUNDS, standardization=False).fit(made)
    return model.coefficients.toArray(), float(model.intercept)


def _chosen(frame: DataFrame, share: float, id_column: str) -> DataFrame:
    # The sample goes by the hash of the id, so reruns take the same rows.
    return frame.where((F.xxhash64(id_column) / float(1 << 64) + 0.5) < share) if share < 1 else frame


def fitted(
    documents: DataFrame,
    labels: DataFrame | None,
    by_votes: dict[tuple[int, int], tuple[float, int]],
    fit_rows: int,
    id_column: str,
) -> Toxicity:
    """The scorer, from P(toxic) and the number of documents for each combination of votes.

    ``labels`` has the id and ``toxic`` (0 or 1, else the row says nothing).
    About ``fit_rows`` documents, FIT_ROWS at most, are taken from those with a label and as many
    from those without.
    """
    chance = {cast: p for cast, (p, _) in by_votes.items()}
    rows = documents.select(id_column, "text")
    n = sum(count for _, count in by_votes.values())
    fit_rows = min(fit_rows, FIT_ROWS)
    only_called = labels is not None
    if only_called:
        known = labels.where("toxic IN (0, 1)").groupBy(id_column).agg(F.max("toxic").cast("int").alias("told"))
        held = saved(_chosen(known, min(1.0, fit_rows / max(known.count(), 1)), id_column))
        side = F.broadcast(held) if fits_broadcast(held) else held
        rows = rows.join(side, id_column, "left")
        called = max(1, sum(count for p, count in by_votes.values() if p >= TOXIC_FROM))
        share = min(1.0, fit_rows / called)
    else:
        rows, share = rows.withColumn("told", F.lit(None).cast("int")), min(1.0, fit_rows / max(n, 1))
    rows = rows.where(F.col("told").isNotNull() | ((F.xxhash64(id_column) / float(1 << 64) + 0.5) < share))

    def make(block: pa.RecordBatch) -> dict[str, object]:
        made: dict[str, list] = {"slots": [], "shares": [], "toxic": []}
        for text, label in zip(block.column("text").to_pylist(), block.column("told").to_pylist()):
            words = words_of(text)
            p = chance.get(insult_votes(words), 0.0) if label is None else float(label)
            if label is None and only_called and p < TOXIC_FROM:
                continue
            found, values = slots(words)
            made["slots"].append(found)
            made["shares"].append(values)
            made["toxic"].append(p)
        return made

    rows = map_text(rows, ["text", "told"], "slots array<int>, shares array<double>, toxic double", make)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    clean, share, worst = rows.agg(F.min("toxic"), F.avg("toxic"), F.max("toxic")).first()
    # Without examples of both kinds the votes decide alone.
    if worst is None or worst < TOXIC_FROM or clean >= TOXIC_FROM:
        return no_words(chance, -30.0)
    entries = rows.select("row", "toxic", F.explode(F.arrays_zip("slots", "shares")).alias("e"))
    entries = entries.select("row", "toxic", F.col("e.slots").alias("slot"), F.col("e.shares").alias("share"))
    # Most words occur in few texts and would only be learnt by heart.
    counted = entries.groupBy("slot").agg(F.sum("toxic").alias("among"), F.count(F.lit(1)).alias("held"))
    above = F.col("among") - F.col("held") * share
    told = counted.where((F.col("among") >= LEAST_TEXTS) & (above > LEAST_DEVIATION * F.sqrt(F.col("held") * share * (1 - share))))
    # No more than WORD_SLOTS numbers, whatever the corpus.
    telling = np.sort(told.select("slot").toArrow()["slot"].to_numpy()).astype(np.int64)
    if not len(telling):
        return no_words(chance, math.log(share / (1 - share)))
    spark = documents.sparkSession
    places = spark.createDataFrame(pa.table({"slot": telling.astype(np.int32), "at": np.arange(len(telling))}))
    placed = entries.join(F.broadcast(places), "slot").select("row", "at", "share")
    return Toxicity(chance, telling, *fit_words(rows.select("row", "toxic"), placed, telling))
