"""Toxic passages as maximal scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.llm.arrow import row_slices, tidied, with_computed
from framegauge.llm.vocabulary import Memo
from framegauge.session import checkpointed

WORD = re.compile(r"[^\W_]+")
# Besides itself a word has its beginnings as units, so that inflections count together.
PREFIXES = (4, 5, 6)
# Strength of the Dirichlet prior, in counts.
PRIOR_COUNTS = 10_000
# A unit weighs as much as its log-odds less so many standard errors, if that is at
# least MIN_WEIGHT.
ERRORS, MIN_WEIGHT = 2.5, 1.0
# Labelled texts that a model is fitted on at most, chosen by a hash of their ids.
MAX_TRAIN = 40_000
# Capacity of the model: the heaviest units.
MAX_UNITS = 50_000
# Units counted by one task before they are handed over.
COUNT_UNITS = 200_000
# Bins of evidence that the final probability is fitted on.
EVIDENCE_STEP, MAX_EVIDENCE = 0.25, 60.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def units_of(word: str) -> list[str]:
    """The word, then its beginnings from the longest on (marked, so that they are no words)."""
    return [word, *(word[:n] + "*" for n in reversed(PREFIXES) if len(word) > n)]


def log_odds(toxic: Column, clean: Column, all_toxic: Column, all_clean: Column) -> tuple[Column, Column]:
    """Log-odds ratio of a unit between the classes and its standard error, under a
    Dirichlet prior in proportion to the unit's share of both classes together."""
    prior = F.lit(float(PRIOR_COUNTS)) * (toxic + clean) / (all_toxic + all_clean)
    t, c = toxic + prior, clean + prior
    delta = F.ln(t / (all_toxic + PRIOR_COUNTS - t)) - F.ln(c / (all_clean + PRIOR_COUNTS - c))
    return delta, F.sqrt(1 / t + 1 / c)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Every segment on the stack keeps the running total before and after it.  A new
    positive score starts a segment; while an earlier one began lower, it and
    everything since are joined if that scores more, otherwise both stand.  The
    nearest segment that began lower is remembered, so it is found without a search.
    """
    starts: list[int] = []
    ends: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    lower: list[int] = []
    total = 0.0
    for at, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        start, low = at, total
        total += score
        high = total
        while True:
            k = len(lows) - 1
            while k >= 0 and lows[k] >= low:
                k = lower[k]
            if k < 0 or highs[k] >= high:
                starts.append(start)
                ends.append(at + 1)
                lows.append(low)
                highs.append(high)
                lower.append(k)
                break
            start, low = starts[k], lows[k]
            del starts[k:], ends[k:], lows[k:], highs[k:], lower[k:]
    return [(s, e, h - w) for s, e, h, w in zip(starts, ends, highs, lows)]


@dataclass(frozen=True)
class ToxicityModel:
    """Unit weights and the extreme-value calibration; its size is bounded by MAX_UNITS."""

    weights: dict[str, float] = field(default_factory=dict)
    background: float = -0.05
    decay: float = 1.0
    density: float = 0.1
    intercept: float = -4.0
    slope: float = 1.0

    def scorer(self) -> Memo:
        known, other = self.weights, self.background

        def weight(word: str) -> float:
            return next((known[u] for u in units_of(word) if u in known), other)

        return Memo(weight)

    def passages(self, scores: list[float]) -> list[tuple[int, int, float, float]]:
        """Significant segments (start, end, score, surprise): those of which less than one
        is expected by chance in a text of this length; surprise is minus the logarithm
        of that number."""
        if not scores or max(scores) <= 0:
            return []
        chance = math.log(self.density * len(scores)) if self.density > 0 else -math.inf
        found = [(s, e, v, self.decay * v - chance) for s, e, v in maximal_segments(scores)]
        return [p for p in found if p[3] > 0]

    def evidence(self, surprises: list[float]) -> float:
        """Minus the logarithm of the chance of so many passages with so large a sum.

        The best r normalised segment scores of random text have a sum above t with
        a probability of about exp(-t) t^(r-1) / (r! (r-1)!); the most telling r counts.
        """
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(surprises, reverse=True), 1):
            total += s
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return min(best, MAX_EVIDENCE)

    def probability(self, evidence: float) -> float:
        x = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most ``max_train`` labelled rows outside the held-out third,
    every text once.  A text that is labelled several times counts as toxic if one of
    its labels says so.

    The bound makes the labels small enough to be broadcast, so no text is shuffled
    to find its label, however many documents there are.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    marks = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(marks), "doc_id").groupBy("text").agg((F.max("toxic") == 1).alias("toxic"))


def held_out(doc_id: Column) -> Column:
    """A third of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(train: DataFrame) -> DataFrame:
    """(unit, toxic, clean): texts with the unit, combined within tasks before the shuffle.

    A text counts once however often it says something, or one long rant would decide.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        units = Memo(units_of)
        counts = (Counter(), Counter())

        def flush():
            both = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([counts[1][u] for u in both], pa.int64()),
                 pa.array([counts[0][u] for u in both], pa.int64())], ["unit", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for rows in row_slices(batch):
                for text, toxic in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    counts[toxic].update(set(chain.from_iterable(map(units.__getitem__, set(words_of(text))))))
                    if len(counts[0]) + len(counts[1]) >= COUNT_UNITS:
                        yield flush()
        yield flush()

    return train.mapInArrow(tidied(run), "unit string, toxic bigint, clean bigint").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _unit_weights(train: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the toxic units, and that of all other words."""
    units = checkpointed(_counted(train))
    totals = units.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (float(n or 0) for n in totals)
    if not toxic or not clean:
        return {}, -0.05
    delta, error = log_odds(F.col("toxic"), F.col("clean"), F.lit(toxic), F.lit(clean))
    strong = units.select("unit", "toxic", "clean", (delta - ERRORS * error).alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
    kept = strong.orderBy(F.col("weight").desc(), "unit").limit(MAX_UNITS).collect()
    weights = {r["unit"]: r["weight"] for r in kept}
    # What is left to units without a weight of their own, in either class.
    rest_toxic, rest_clean = toxic - sum(r["toxic"] for r in kept), clean - sum(r["clean"] for r in kept)
    background = math.log((rest_toxic + 1) / (toxic + 1)) - math.log((rest_clean + 1) / (clean + 1))
    return weights, min(background, -0.02)


def _scores(model: ToxicityModel, texts: list[str | None]) -> Iterator[list[float]]:
    weight = model.scorer().__getitem__
    for text in texts:
        yield list(map(weight, words_of(text)))


def _decay(histogram: list[tuple[float, int]]) -> float:
    """The positive root of E[exp(x s)] = 1 over the scores of clean tokens.

    It exists where scores are negative on average and positive ones occur; weights
    that are log-odds have it at about 1, which is taken where there is none.
    """
    count = sum(n for _, n in histogram)
    if not count or max((s for s, _ in histogram), default=0) <= 0 or sum(s * n for s, n in histogram) >= 0:
        return 1.0
    low, high = 1e-3, 4.0
    for _ in range(60):
        x = (low + high) / 2
        if sum(n * math.exp(min(x * s, 700)) for s, n in histogram) > count:
            high = x
        else:
            low = x
    return min(max(low, 0.2), 2.0)


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of the chance of a toxic text by evidence; (x, toxic, clean) counts.

    Damped Newton steps with a small ridge, so that separable classes have a solution;
    the slope is held positive.
    """
    x = np.array([p[0] for p in points])
    toxic = np.array([p[1] for p in points], float)
    both = toxic + np.array([p[2] for p in points], float)
    design = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.diag([1e-3, 0.1])

    def loss(beta):
        at = design @ beta
        return (both * np.logaddexp(0, at) - toxic * at).sum() + beta @ ridge @ beta / 2

    beta = np.array([-2.0, 0.5])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (both * p - toxic) + ridge @ beta
        hessian = (design * (both * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.05))


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from up to ``max_train`` labelled rows outside the held-out third; only texts
    are looked at.

    The driver gets the unit weights (at most MAX_UNITS), a histogram of rounded
    scores and counts by binned evidence, all bounded.  Without labels of both classes
    the model has no weights, and no text is toxic.
    """
    train = checkpointed(labelled(docs, labels, doc_id, text, max_train))
    weights, background = _unit_weights(train)
    if not weights:
        return ToxicityModel()
    plain = ToxicityModel(weights, background)

    def histogram(batches):
        counts: Counter = Counter()
        above: Counter = Counter()
        for batch in batches:
            for rows in row_slices(batch):
                for scores in _scores(plain, rows.column(0).to_pylist()):
                    counts.update([round(s, 1) for s in scores if s != background])
                    above["words"] += len(scores)
                    above["other"] += sum(s == background for s in scores)
                    above.update(min(int(v), 60) for _, _, v in maximal_segments(scores) if v >= 1)
        rows = [("score", s, n) for s, n in counts.items()] + [
            (str(k), 0.0, n) for k, n in above.items() if isinstance(k, str)] + [
            ("segments", float(k), n) for k, n in above.items() if not isinstance(k, str)]
        yield pa.RecordBatch.from_pylist([{"kind": a, "value": b, "n": c} for a, b, c in rows], pa.schema(
            [("kind", pa.string()), ("value", pa.float64()), ("n", pa.int64())]))

    clean = train.where("not toxic").select("text").mapInArrow(tidied(histogram), "kind string, value double, n bigint")
    tables: dict[str, dict[float, int]] = defaultdict(dict)
    for r in clean.groupBy("kind", "value").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"]][r["value"]] = r["n"]
    count = tables["words"].get(0.0, 0)
    scores = [*tables["score"].items(), (background, tables["other"].get(0.0, 0))]
    decay = _decay(scores)
    # Segments above a score are expected density * words * exp(-decay * score) times;
    # the density is set by the score where clean text has the most, within 1e-6 to 1.
    density, more = 1e-6, 0
    for value in sorted(tables["segments"], reverse=True):
        more += tables["segments"][value]
        density = max(density, min(1.0, more / max(count, 1) * math.exp(min(decay * value, 50))))
    placed = ToxicityModel(weights, background, decay, density)

    def binned(batches):
        counts: Counter = Counter()
        for batch in batches:
            for rows in row_slices(batch):
                marks = rows.column(1).to_pylist()
                for scores, toxic in zip(_scores(placed, rows.column(0).to_pylist()), marks):
                    evidence = placed.evidence([p[3] for p in placed.passages(scores)])
                    counts[round(evidence / EVIDENCE_STEP), toxic] += 1
        yield pa.RecordBatch.from_pylist([{"bin": b, "toxic": t, "n": n} for (b, t), n in counts.items()], pa.schema(
            [("bin", pa.int64()), ("toxic", pa.bool_()), ("n", pa.int64())]))

    bins: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    counted = train.mapInArrow(tidied(binned), "bin bigint, toxic boolean, n bigint").groupBy("bin", "toxic").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        bins[r["bin"]][0 if r["toxic"] else 1] += r["n"]
    intercept, slope = _logistic([(b * EVIDENCE_STEP, t, c) for b, (t, c) in bins.items()])
    return ToxicityModel(weights, background, decay, density, intercept, slope)


def toxic_passages(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns toxicity (0 to 1) and passages, an array of (start, end,
    score, surprise, text): every significant toxic passage by word positions, with the
    words it spans as they stand in the text.

    Null and empty texts have no passages and the model's lowest score.  Very long
    texts are scanned once, whole.  A column called toxicity or passages is replaced,
    all others are passed through, ``text`` itself only with ``keep_text``.  Rows are
    independent, repeated ones score alike; there is no shuffle.
    """
    fields = T.StructType.fromDDL("toxicity double, passages array<struct<start:int,end:int,score:double,surprise:double,text:string>>").fields
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surprise", pa.float64()),
                      ("text", pa.string())])

    def convert(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        values, passages = [], []
        for t, scores in zip(texts, _scores(model, texts)):
            found = model.passages(scores)
            values.append(model.probability(model.evidence([p[3] for p in found])))
            passages.append(spans(t, found) if found else [])
        return [pa.array(values, pa.float64()), pa.array(passages, pa.list_(item))]

    return with_computed(docs, text, fields, convert, keep_text)


def spans(text: str, found: list[tuple[int, int, float, float]]) -> list[dict]:
    """The passages with their words, cut out of the lower-cased text."""
    lowered = text.lower()
    bounds = [m.span() for m in WORD.finditer(lowered)]
    return [{"start": s, "end": e, "score": v, "surprise": x, "text": lowered[bounds[s][0]:bounds[e - 1][1]]}
            for s, e, v, x in found]
