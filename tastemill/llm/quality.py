"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good, bad or nothing on every document.
2. Expectation-maximisation over all documents estimates how often each labeller
   votes what, given the unknown class. It needs only the number of documents
   with each combination of votes, which Spark counts.
3. Posterior labels, as weights, train a linear scorer on hashed word shapes.

Every document is then scored by the linear scorer. Toxicity is a question of its
own, with labellers and a scorer of its own: see ``toxicity.py``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import reduce
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import map_text, saved
from tastemill.llm.toxicity import VOTES, Toxicity, fitted as fitted_toxicity, insult_votes, no_words, words_of

# Size of the hashed feature space.
SLOTS = 256
# Documents that the scorer is fitted on, about: a bounded sample by hash. The
# labellers' accuracies come from all documents.
FIT_ROWS = 20_000
ROUNDS = 50
# Documents scored below this are rejected.
KEEP_FROM = 0.5
# Votes bad and good to expect of a labeller that votes, for bad and for good documents:
# each kind of bad text is noticed by few labellers, good text is rarely called bad.
BELIEF = np.array([[0.3, 0.7], [0.01, 0.99]])

# Every byte's kind: capital, small (and all of non-ASCII), digit; white space and signs are themselves.
KINDS = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
STATS = ["n_words", "n_signed", "n_capital", "n_bars", "n_repeated", "n_stops", "n_lettered", "n_different"]
# Common words of the four languages.
STOP_WORDS = frozenset(
    b"the of and to in a is that it was for on with as at by be this from or an are "
    b"de la el en que y los se del las un por con una su para es al lo como "
    b"le et les des est du une dans qui il au ce pas sur ne plus par "
    b"der die und den von zu das mit sich auf ist im dem nicht ein eine als auch".split()
)


def _shape(word: bytes) -> bytes:
    """A word of kinds with runs cut to one: ``Aaaa&&&`` becomes ``Aa&``."""
    return bytes(b for i, b in enumerate(word) if not i or b != word[i - 1])


def describe(text: str | None, slots: dict[bytes, int]) -> tuple[list[int], list[float]]:
    """Counts for the labellers and the hashed features of one text.

    ``slots`` remembers the slot of each word of kinds.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = raw.translate(KINDS).split()
    n = len(words)
    shapes = Counter(kinds)
    features = [0.0] * SLOTS
    signed = capital = bars = lettered = 0
    for kind, count in shapes.items():
        shape = _shape(kind)
        slot = slots.get(kind)
        if slot is None:
            if len(slots) > 100_000:
                slots.clear()
            slot = slots[kind] = zlib.crc32(b"shape " + shape[:12]) % SLOTS
        features[slot] += count
        if b"a" in kind or b"A" in kind:
            lettered += count
            capital += count * (b"a" not in kind and kind.count(b"A") > 1)
        signed += count * (kind[-1:] in b"#$%&*!" and len(kind) > 1)
        bars += count * (kind == b"|")
    repeated = sum(map(eq, words, words[1:]))
    stops = sum(map(STOP_WORDS.__contains__, raw.lower().split()))
    features[zlib.crc32(b"repeated") % SLOTS] += repeated
    features[zlib.crc32(b"stops") % SLOTS] += stops
    total = max(n, 1)
    return [n, signed, capital, bars, repeated, stops, lettered, len(set(words))], [math.sqrt(f / total) for f in features]


def described(documents: DataFrame, *, features: bool, id_column: str = "doc_id") -> DataFrame:
    """The id, the labellers' counts and the feature vector, or else the votes on toxicity, of every row."""
    slots: dict[bytes, int] = {}

    def make(block: pa.RecordBatch) -> dict[str, object]:
        texts = block.column("text").to_pylist()
        rows = [describe(t, slots) for t in texts]
        made = {name: [counts[i] for counts, _ in rows] for i, name in enumerate(STATS)}
        if features:
            return made | {id_column: block.column(id_column), "features": [f for _, f in rows]}
        insults = [insult_votes(words_of(t)) for t in texts]
        return made | {id_column: block.column(id_column)} | {v: [c[i] for c in insults] for i, v in enumerate(VOTES)}

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, " + ", ".join(f"{s} bigint" for s in STATS)
    more = "features array<double>" if features else ", ".join(f"{v} tinyint" for v in VOTES)
    return map_text(documents, [id_column, "text"], f"{schema}, {more}", make)


def votes() -> dict[str, Column]:
    """Each labeller's vote: 1 for good, 0 for bad, -1 for none."""
    share = lambda name: F.col(name) / F.greatest("n_words", F.lit(1))
    enough = F.col("n_words") >= 20

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1).cast("tinyint")

    return {
        "by_signs": vote(share("n_signed") > 0.15, enough & (share("n_signed") < 0.02)),
        "by_capitals": vote(share("n_capital") > 0.3, enough & (share("n_capital") < 0.05)),
        "by_bars": vote(share("n_bars") > 0.15, enough & (share("n_bars") < 0.02)),
        "by_repeats": vote(share("n_repeated") > 0.15, enough & (share("n_repeated") < 0.05)),
        "by_variety": vote(enough & (share("n_different") < 0.15), enough & (share("n_different") > 0.3)),
        "by_stops": vote(enough & (share("n_stops") < 0.05), enough & (share("n_stops") > 0.12) & (share("n_stops") < 0.6)),
        "by_letters": vote(enough & (share("n_lettered") < 0.7), enough & (share("n_lettered") > 0.9)),
    }


def accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of good and P(vote | class) per labeller, by expectation-maximisation.

    ``patterns`` has every combination of votes with its number of documents: at
    most 3 to the power of the number of labellers. Returned table:
    [labeller, class, vote] with votes in the order bad, good; no vote says
    nothing about the class. It starts from ``BELIEF``, which also stays in the counts with the weight of a fifth
    of the documents, so that the classes keep their meaning.
    """
    cast = np.array([p for p, _ in patterns], int)
    weight = np.array([n for _, n in patterns], float)
    m = cast.shape[1]
    prior, table = 0.7, np.tile(BELIEF, (m, 1, 1))
    belief = BELIEF * weight.sum() * 0.2
    for _ in range(rounds):
        good = posterior(cast, prior, table)
        mass = np.stack([(1 - good) * weight, good * weight])
        prior = float((mass[1].sum() + 1) / (weight.sum() + 2))
        for j in range(m):
            for c in (0, 1):
                voted = cast[:, j] >= 0
                counts = np.bincount(cast[voted, j], mass[c, voted], 2) + belief[c]
                table[j, c] = counts / counts.sum()
    return prior, table


def posterior(cast: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(table)
    odds = math.log(prior) - math.log(1 - prior) + np.zeros(len(cast))
    for j in range(cast.shape[1]):
        odds += np.where(cast[:, j] < 0, 0.0, (logs[j, 1] - logs[j, 0])[cast[:, j]])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _posterior_column(prior: float, table: np.ndarray) -> Column:
    """The posterior as a column expression over the votes."""
    terms = [F.lit(math.log(prior) - math.log(1 - prior))]
    for name, (bad, good) in zip(votes(), table.tolist()):
        by_vote = [math.log(g / b) for b, g in zip(bad, good)]
        terms.append(F.when(F.col(name) < 0, 0.0).when(F.col(name) == 0, by_vote[0]).otherwise(by_vote[1]))
    return 1 / (1 + F.exp(-reduce(add, terms)))


def _fit(
    documents: DataFrame, toxic_labels: DataFrame | None, fit_rows: int, id_column: str
) -> tuple[float, np.ndarray, np.ndarray, float, Toxicity] | None:
    """Prior, vote table, the scorer's weights and bias, and what toxicity needs; None without documents."""
    names = [*votes(), *VOTES]
    rows = described(documents, features=False, id_column=id_column).withColumns(votes()).groupBy(*names).count().collect()
    if not rows:
        return None
    n = sum(r["count"] for r in rows)
    cast, insults = Counter(), Counter()
    for r in rows:
        cast[tuple(r)[: -1 - len(VOTES)]] += r["count"]
        insults[tuple(r)[-1 - len(VOTES) : -1]] += r["count"]
    prior, table = accuracies(sorted(cast.items()))
    clean = posterior(np.array(sorted(insults), int), *accuracies(sorted(insults.items())))
    by_votes = {v: (1 - float(p), insults[v]) for v, p in zip(sorted(insults), clean)}
    toxic = fitted_toxicity(documents, toxic_labels, by_votes, fit_rows, id_column)

    # The sample goes by the hash of the id, so reruns take the same rows.
    share = min(1.0, fit_rows / n)
    chosen = documents.where((F.xxhash64(id_column) / float(1 << 64) + 0.5) < share) if share < 1 else documents
    labelled = (
        described(chosen, features=True, id_column=id_column)
        .withColumns(votes())
        .withColumn("good", _posterior_column(prior, table))
        .select(array_to_vector("features").alias("features"), "good")
    )
    rows = saved(
        labelled.select(
            "features",
            F.explode(
                F.array(
                    F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")),
                    F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight")),
                )
            ).alias("as"),
        ).select("features", "as.label", "as.weight")
    )
    if rows.isEmpty():
        return prior, table, np.zeros(SLOTS), math.log(prior) - math.log(1 - prior), toxic
    model = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=60, standardization=False).fit(rows)
    return prior, table, model.coefficients.toArray(), float(model.intercept), toxic


def _scorer(documents: DataFrame, weights: np.ndarray, bias: float, toxic: Toxicity):
    """A function from a text to its counts and score, and one for its toxicity, for the workers."""
    shared = documents.sparkSession.sparkContext.broadcast((weights, bias, toxic.by_votes, toxic.slots, toxic.weights, toxic.bias))
    slots: dict[bytes, int] = {}

    def score(text: str | None) -> tuple[list[int], float]:
        counts, features = describe(text, slots)
        odds = float(np.dot(features, shared.value[0])) + shared.value[1]
        return counts, round(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), 6)

    def toxic_score(text: str | None) -> tuple[tuple[int, int], float, bool]:
        return Toxicity(*shared.value[2:]).score(text)

    return score, toxic_score


def quality_scores(
    documents: DataFrame,
    toxic_labels: DataFrame | None = None,
    *,
    fit_rows: int = FIT_ROWS,
    keep_from: float = KEEP_FROM,
    id_column: str = "doc_id",
) -> DataFrame:
    """Score every document.

    Columns: the id; one vote column per labeller; ``weak_label``, the posterior
    of good given the votes; ``score``, the linear scorer's probability of good,
    to six digits; ``keep``, whether it reaches ``keep_from``; the votes on
    toxicity, ``toxic_score``, the probability of toxic by the words, and
    ``toxic``. ``keep`` is about form only: a well-formed toxic text has both
    ``keep`` and ``toxic``. ``toxic_labels`` (the id and ``toxic``) need not
    cover every document. A null text counts
    as empty: no labeller votes on it for good, and its features are zero.
    Repeated rows stay repeated and get equal scores, null ids stay null. An
    empty table gives an empty one. Other columns are not read.
    """
    fitted = _fit(documents, toxic_labels, fit_rows, id_column)
    prior, table, weights, bias, toxic = fitted or (0.5, np.full((len(votes()), 2, 2), 0.5), np.zeros(SLOTS), 0.0, no_words({}, 0.0))
    score, toxic_score = _scorer(documents, weights, bias, toxic)

    def make(block: pa.RecordBatch) -> dict[str, object]:
        texts = block.column("text").to_pylist()
        rows, found = [score(t) for t in texts], [toxic_score(t) for t in texts]
        made = {name: [counts[i] for counts, _ in rows] for i, name in enumerate(STATS)}
        made |= {name: [cast[i] for cast, _, _ in found] for i, name in enumerate(VOTES)}
        made |= {"toxic_score": [s for _, s, _ in found], "toxic": [t for _, _, t in found]}
        return made | {id_column: block.column(id_column), "score": [s for _, s in rows]}

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, " + ", ".join(f"{s} bigint" for s in STATS) + ", score double, "
    schema += ", ".join(f"{v} tinyint" for v in VOTES) + ", toxic_score double, toxic boolean"
    return (
        map_text(documents, [id_column, "text"], schema, make)
        .withColumns(votes())
        .select(
            id_column,
            *votes(),
            F.round(_posterior_column(prior, table), 6).alias("weak_label"),
            "score",
            (F.col("score") >= keep_from).alias("keep"),
            *VOTES,
            "toxic_score",
            "toxic",
        )
    )


def good_documents(
    documents: DataFrame,
    toxic_labels: DataFrame | None = None,
    *,
    fit_rows: int = FIT_ROWS,
    keep_from: float = KEEP_FROM,
    id_column: str = "doc_id",
) -> DataFrame:
    """The rows of ``documents`` that ``quality_scores`` keeps and doesn't call toxic, with all their columns."""
    fitted = _fit(documents, toxic_labels, fit_rows, id_column)
    if fitted is None:
        return documents
    (score, toxic_score), names = _scorer(documents, *fitted[2:]), documents.columns

    def make(block: pa.RecordBatch) -> dict[str, object]:
        good = pa.array([score(t)[1] >= keep_from and not toxic_score(t)[2] for t in block.column("text").to_pylist()], pa.bool_())
        kept = block.filter(good)
        return {name: kept.column(name) for name in names}

    return map_text(documents, documents.columns, documents.schema, make)
