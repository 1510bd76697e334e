"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding undoes look-alike letters and digit substitutions. The lexicon holds whole words and word beginnings with
weights that are smoothed log-odds over labelled rows; exception phrases take back the matches they cover. These are
the pairs of words that hold a listed one and yet occur in clean rows only, too often for chance, and what a deployment adds. A
logistic curve over the weight and the weight by length gives the score.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import asdict, dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import written

#: Labelled rows that the lexicon and the curve are fitted on, at most; those with the least hash of their id.
TRAINING_ROWS = 20_000
#: Rows that a feature occurs in at least, and log-odds (less 1.64 standard errors) from which it is listed.
ROWS, ODDS = 3, 1.0
#: Probability below which a phrase that is never toxic is taken for harmless.
CHANCE = 0.01
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | {chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
#: Marks of stress over letters stay: they tell words apart. Full-width letters fold by their distance to ASCII.
_FOLD |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}
_WORD = re.compile(r"[^\W_]+")
#: Lengths of word beginnings that may be listed.
STEMS = (4, 5, 6)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def features(text: str) -> list[str]:
    """Distinct whole words ("=word") and word beginnings ("^stem") of a text."""
    words = set(_WORD.findall(fold(text)))
    return ["=" + w for w in words] + ["^" + w for w in {w[:n] for w in words for n in STEMS if len(w) > n}]


def phrases(text: str, weights: dict[str, float]) -> list[tuple[str, float]]:
    """Distinct pairs of neighbouring words, as they stand in the folded text, of which one is listed whole or by its
    beginning, with the greater weight of the two."""
    t, out, last = fold(text), {}, None
    for m in _WORD.finditer(t):
        w = m.group()
        weight = max([weights.get("=" + w, 0.0), *(weights.get("^" + w[:n], 0.0) for n in STEMS if len(w) > n)])
        if last is not None and max(weight, last[1]) > 0 and m.start() - last[0].end() == 1:
            out[t[last[0].start() : m.end()]] = max(weight, last[1])
        last = m, weight
    return sorted(out.items())


@dataclass(frozen=True)
class Model:
    """A fitted lexicon; small, and sent to the executors as JSON within the plan."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Matcher:
    def __init__(self, model: Model):
        self.curve = model.curve
        entries: dict[str, dict[str, float]] = defaultdict(dict)
        for key, w in model.weights.items():
            entries[key[1:]][key[0]] = w
        for phrase in model.exceptions:
            entries[fold(phrase)]["!"] = 0.0
        self.automaton = ahocorasick.Automaton()
        for word, kinds in entries.items():
            self.automaton.add_word(word, (len(word), kinds.get("="), kinds.get("^"), "!" in kinds))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def weigh(self, text: str) -> tuple[float, int]:
        """The weights of matched words, one for each word start, and the number of words or so."""
        t = fold(text)
        n = max(1, len(t) // 6)
        if self.empty:
            return 0.0, n
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        size = len(t)
        for end, (length, whole, stem, exception) in self.automaton.iter(t):
            start = end - length + 1
            if start and t[start - 1].isalnum():
                continue
            closed = end + 1 == size or not t[end + 1].isalnum()
            if exception and closed:
                spared.append((start, end))
            weight = whole if closed and whole is not None else stem if stem is not None and not closed else None
            if weight is not None and (start not in best or weight > best[start][0]):
                best[start] = (weight, end)
        if spared:
            # the farthest end of all phrases that begin at a word's start or before it
            spared.sort()
            begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            best = {s: x for s, x in best.items() if not (k := bisect_right(begins, s)) or reach[k - 1] < x[1]}
        return sum(w for w, _ in best.values()), n

    def points(self, text: str) -> tuple[float, float]:
        weight, n = self.weigh(text)
        return math.log1p(max(0.0, weight)), max(0.0, weight) / math.sqrt(n)

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.points(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


@lru_cache(maxsize=4)
def matcher(model: str) -> Matcher:
    m = json.loads(model)
    return Matcher(Model(m["weights"], tuple(m["exceptions"]), tuple(m["curve"])))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _curve(points: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve by Newton's steps with a small penalty, so that separable data stay finite."""
    x = np.column_stack([np.ones(len(y)), points])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        penalty = np.array([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """Fit on at most `rows` labelled rows that are not held out: a bounded sample, the least by hash of the id.

    labels has doc_id and toxic; rows with a null in either, and ids with both labels, teach nothing. Repeated rows
    teach once. Without rows of both kinds the lexicon is empty and every score is the share of toxic rows. All features
    and phrases that pass are listed: their number is bounded by the sample's.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select("doc_id", "y")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids and labels are broadcast, so the texts of other rows never move
    sample = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.min("y").alias("y"))
    sample = written(sample, "training-sample")

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.string()))

    totals = sample.groupBy("y").count().collect()
    n = {int(r["y"]): r["count"] for r in totals}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 0.5) / (n1 + n0 + 1)
        return Model({}, tuple(exceptions), (math.log(p / (1 - p)), 0.0, 0.0))

    counts = sample.select("y", F.explode(found("t")).alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    # log-odds with half a row added on both sides, less 1.64 standard errors: rare features must be purer
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    kept = counts.where(F.col("c1") >= ROWS).withColumn("w", sure).where(F.col("w") > ODDS).orderBy("f").collect()
    weights = {r["f"]: round(float(r["w"]), 4) for r in kept}

    @F.arrow_udf("array<struct<f:string,w:double>>")
    def paired(texts: pa.Array) -> pa.Array:
        return pa.array([[{"f": f, "w": w} for f, w in phrases(t.as_py(), weights)] for t in texts], pa.list_(pa.struct([("f", pa.string()), ("w", pa.float64())])))

    # if a phrase were as toxic as its word is at least, so many clean rows and no toxic one would be this improbable
    spared = sample.select("y", F.explode(paired("t")).alias("p")).groupBy("p.f").agg(F.sum("y").alias("c1"), F.count("*").alias("c0"), F.max("p.w").alias("w")).where((F.col("c1") == 0) & (F.col("c0") >= ROWS))
    toxic = F.exp("w") * n1 / (F.exp("w") * n1 + n0)
    spared = spared.where(F.col("c0") * F.log(1 - toxic) <= math.log(CHANCE)).orderBy("f").collect()
    exceptions = tuple(dict.fromkeys([*exceptions, *(r["f"] for r in spared)]))
    first = Model(weights, exceptions, (0.0, 0.0, 0.0)).to_json()

    @F.arrow_udf("array<double>")
    def points(texts: pa.Array) -> pa.Array:
        m = matcher(first)
        return pa.array([m.points(t.as_py()) for t in texts], pa.list_(pa.float64()))

    seen = sample.select("y", points("t").alias("p")).collect()  # at most `rows` rows of three numbers
    return Model(weights, exceptions, _curve(np.array([r["p"] for r in seen], float).reshape(-1, 2), np.array([r["y"] for r in seen], float)))


def score_column(text: Column, model: Model) -> Column:
    packed = model.to_json()

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        m = matcher(packed)
        return pa.array([m.score(t.as_py() or "") for t in texts], pa.float64())

    return toxicity(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 by the text alone, without a shuffle.

    A null text scores as the empty one; texts are read whole; equal texts score alike; an empty table stays
    empty; a column called like out is replaced.
    """
    return docs.withColumn(out, score_column(F.col(text), model))
