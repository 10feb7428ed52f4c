"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the word classes of a clause: insults and threats put out weight, a target close by raises it, negation
and reported speech lower it, by the distance.  Composed, they are one table, and all clauses are walked through it in step; a
text's matched clauses, not its isolated words, make up its score: no feature is taken from a word that the machine has not put
out.  Which words are insults, and how heavy, is learned from labelled texts: words, and stems that come back within a text, that
toxic texts hold far more often than chance allows.  How much a trigger changes a word is learned too, by trigger and distance,
from the labelled texts' matched clauses: targets may only raise, negation and report only lower.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import discard, lean, only, stored, tune

#: Labelled texts that the grammar is fitted on, those of the lowest key hash; each is read whole.
FIT_ROWS = 8000
#: How unlikely by chance a word's share of toxic texts must be.
CHANCE = 3e-5
STEMS = (5, 6, 7, 8)
LETTERS = textvec.byte_class((0, 64), (91, 96), (123, 127))
CLAUSE_END = textvec.byte_class((10, 10), (33, 33), (46, 46), (59, 59), (63, 63))

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    THREAT: "kill hurt destroy shoot stab strangle burn beat crush töten schlagen tuer frapper matar golpear",
    TARGET: "you your yourself he she they him them du dich dein sie ihr tu toi vous ton te usted ustedes tú",
    NEGATION: "not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca",
    REPORT: "said says saying reported quoted called calling sagte genannt dit disait appelé dijo llamó",
}
#: What a threat weighs, before its gain; insults have learned weights.
THREAT_WEIGHT = 3.0
#: trigger, words it reaches, classes it changes, gain before anything is learned; above 1 it may only raise, below 1 only lower.
TIMERS = ((TARGET, 4, (INSULT,), 1.5), (TARGET, 3, (THREAT,), 4.0), (NEGATION, 2, (INSULT, THREAT), 0.5), (REPORT, 6, (INSULT, THREAT), 0.6))
#: Matched words that outweigh the gain before learning, and the bounds of learned gains.
PRIOR, LEAST, MOST = 50, 0.1, 6.0
FEATURES = 6


@dataclass(frozen=True)
class Transducer:
    """step[state, class] is the next state; gain[state, class] multiplies the weight of the word just read."""

    step: np.ndarray
    gain: np.ndarray


def timer(trigger: int, gains: np.ndarray, on: tuple[int, ...]) -> Transducer:
    """After a word of class ``trigger``, the d-th word, if of the classes ``on``, weighs gains[d - 1] times as much.

    The state is how many words the trigger still reaches.
    """
    span = len(gains)
    step = np.maximum(np.arange(span + 1)[:, None] - 1, 0).repeat(6, axis=1)
    step[:, trigger] = span
    weight = np.ones((span + 1, 6))
    weight[1:, list(on)] = np.asarray(gains)[::-1, None]
    return Transducer(step, weight)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: the states are pairs, the gains multiply."""
    n = len(b.step)
    step = a.step[:, None, :] * n + b.step[None, :, :]
    gain = a.gain[:, None, :] * b.gain[None, :, :]
    return Transducer(step.reshape(-1, 6), gain.reshape(-1, 6))


def first_gains() -> list[np.ndarray]:
    """The gains of TIMERS by distance, before learning."""
    return [np.full(span, gain) for _, span, _, gain in TIMERS]


def grammar(gains: list[np.ndarray] | None = None) -> Transducer:
    """Insults and threats emit; each of TIMERS changes what comes within its reach."""
    out = Transducer(np.zeros((1, 6), dtype=int), np.array([[0, 1, 0.25, 0, 0, 0]]))
    for (trigger, _, on, _), g in zip(TIMERS, gains or first_gains(), strict=True):
        out = compose(out, timer(trigger, g, on))
    return out


def distances(state: np.ndarray) -> list[np.ndarray]:
    """For each of TIMERS how many words ago its trigger was read (0: out of reach), from states of the composed machine."""
    out = []
    for _, span, _, _ in reversed(TIMERS):
        left = state % (span + 1)
        out.append(np.where(left > 0, span + 1 - left, 0))
        state = state // (span + 1)
    return out[::-1]


def walk(machine: Transducer, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain, and state before it, of every word of the clauses kind[first : last + 1]; all clauses go one word at a time."""
    gain, before = np.zeros(len(kind)), np.zeros(len(kind), dtype=np.int64)
    order = np.argsort(first - last, kind="stable")
    first, lens = first[order], (last - first + 1)[order]
    state = np.zeros(len(first), dtype=np.int64)
    for t in range(int(lens[0]) if len(lens) else 0):
        m = int(np.searchsorted(-lens, -t, side="left"))  # clauses longer than t
        at = first[:m] + t
        before[at] = state[:m]
        gain[at] = machine.gain[state[:m], kind[at]]
        state[:m] = machine.step[state[:m], kind[at]]
    return gain, before


def word_key(word: str) -> np.uint64:
    body = textvec._LOWER[np.frombuffer(word.encode(), dtype=np.uint8)]
    return textvec.span_keys(body, np.array([0]), np.array([len(body)]))[0]


def tokens(texts: pa.Array) -> tuple:
    """Word keys, counts, stem keys by length (0: the word is shorter), and the clause number of each word."""
    body, offsets = textvec.raw(texts)
    starts, stops, keys, counts = textvec.words(body, offsets, LETTERS)
    low = textvec._LOWER[body]
    stems = {}
    for n in STEMS:
        long = stops - starts > n
        out = np.zeros(len(starts), dtype=np.uint64)
        out[long] = textvec.span_keys(low, starts[long], starts[long] + n)
        stems[n] = out
    # A new text begins a new clause.
    owner = np.repeat(np.arange(len(counts)), counts)
    clause = np.searchsorted(np.flatnonzero(CLAUSE_END[body]), starts) + owner
    return keys, counts, stems, clause


def _repeated(x: np.ndarray) -> np.ndarray:
    found, n = np.unique(x[x != 0], return_counts=True)
    return found[n >= 2]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, half, text) -> (key, stem, n0, n1, n2, n3): texts that hold a word, or a stem twice, by 2 * half + y."""
    for batch in batches:
        group = 2 * batch.column("half").to_numpy().astype(np.int64) + batch.column("y").to_numpy()
        keys, counts, stems, _ = tokens(batch.column("text"))
        ends = np.cumsum(counts)
        for stem in (False, True):
            own = [np.concatenate([_repeated(s[e - n : e]) for s in stems.values()]) if stem else np.unique(keys[e - n : e]) for n, e in zip(counts, ends, strict=True)]
            found, at = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_inverse=True)
            n = np.bincount(at * 4 + np.repeat(group, [len(x) for x in own]), minlength=4 * len(found)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), stem)), *(pa.array(n[:, j]) for j in range(4))], ["key", "stem", "n0", "n1", "n2", "n3"])


def associated(t: np.ndarray, rest: np.ndarray, toxic: int, clean: int, chance: float = CHANCE) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``t`` of ``toxic`` and ``rest`` of ``clean`` texts is more than ``chance`` allows, and the log-odds."""
    base, m = toxic / max(1, toxic + clean), np.maximum(t + rest, 1)
    share = t / m
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = m * (np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    odds = np.log((t + 0.5) / (toxic - t + 0.5) * (clean - rest + 0.5) / (rest + 0.5))
    return (share > base) & (surprise >= -math.log(chance)), odds


def _weights(found: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(found))
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, weights[at], 0.0)


_NONE = np.empty(0, np.uint64), np.empty(0)


@dataclass
class Model:
    """Sorted keys of insults and insulting stems with their weights, gains of TIMERS, and the weighting of the features."""

    words: np.ndarray = field(default_factory=lambda: _NONE[0])
    word_weights: np.ndarray = field(default_factory=lambda: _NONE[1])
    stems: np.ndarray = field(default_factory=lambda: _NONE[0])
    stem_weights: np.ndarray = field(default_factory=lambda: _NONE[1])
    gains: list[np.ndarray] = field(default_factory=first_gains)
    beta: np.ndarray = field(default_factory=lambda: np.array([-6.0] + [0.0] * FEATURES))

    def matched(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Every word that the machine puts out weight for: its text, clause, form, weight and the state it was read in."""
        keys, counts, stems, clause = tokens(texts)
        weight, form = _weights(keys, self.words, self.word_weights), keys
        for own in reversed(stems.values()):  # the shortest known stem is a word's form
            w = _weights(own, self.stems, self.stem_weights)
            weight, form = np.maximum(weight, w), np.where(w > 0, own, form)
        kind = np.where(weight > 0, INSULT, OTHER).astype(np.int8)
        for c, seed in SEEDS.items():
            known = np.unique(np.array([word_key(w) for w in seed.split()], dtype=np.uint64))
            kind[(_weights(keys, known, np.ones(len(known))) > 0) & (kind == OTHER)] = c
        weight[kind == THREAT] = THREAT_WEIGHT
        hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        matched = np.unique(clause[hit])
        last = hit[np.searchsorted(clause[hit], matched, side="right") - 1]
        gain, state = walk(grammar(self.gains), kind, np.searchsorted(clause, matched), last)
        out = weight * gain
        hit = np.flatnonzero(out > 0)
        owner = np.searchsorted(np.cumsum(counts), hit, side="right")
        return {"text": owner, "clause": clause[hit], "form": form[hit], "weight": out[hit], "state": state[hit], "kind": kind[hit], "n_words": counts}

    def features(self, texts: pa.Array) -> np.ndarray:
        """Measures of each text's matched clauses; zeros without any."""
        m = self.matched(texts)
        x = np.zeros((len(texts), FEATURES))
        edges = np.searchsorted(m["text"], np.arange(len(texts) + 1))
        for k in np.unique(m["text"]):
            own = slice(edges[k], edges[k + 1])
            w = m["weight"][own]
            _, at = np.unique(m["form"][own], return_inverse=True)
            by_form = np.bincount(at, w)
            x[k] = np.log1p([w.sum(), len(by_form), len(w), 100 * w.sum() / m["n_words"][k], by_form.max(), len(np.unique(m["clause"][own]))])
        return x

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.beta[1:] + self.beta[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Intercept and slopes by Newton steps; the ridge spares the intercept."""
    z = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (p - y) + penalty @ beta
        beta = beta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, grad)
    return beta


def lexicon(counts: dict[str, np.ndarray], totals: np.ndarray, halves: tuple[int, ...], chance: float = CHANCE) -> Model:
    """A model that knows the words and stems of the texts in ``halves``; its gains and weighting are not learned yet."""
    t, rest = (sum(counts[f"n{2 * h + y}"] for h in halves) for y in (1, 0))
    toxic, clean = (int(sum(totals[2 * h + y] for h in halves)) for y in (1, 0))
    if not toxic or not clean:
        return Model()
    keep, odds = associated(t, rest, toxic, clean, chance)
    parts = []
    for stem in (False, True):
        own = keep & (counts["stem"] == stem)
        order = np.argsort(counts["key"][own])
        parts += [counts["key"][own][order], odds[own][order]]
    return Model(*parts)


def learned_gains(tally: np.ndarray) -> list[np.ndarray]:
    """Gains by trigger and distance.  tally[timer, distance, y]: matched words of clean and toxic texts; distance 0 is out of reach.

    A trigger matters as much as the share of toxic texts among matched words differs within and out of its reach.
    """
    out = []
    for (_, span, _, prior), n in zip(TIMERS, tally, strict=True):
        odds = np.log((n[: span + 1, 1] + 1) / (n[: span + 1, 0] + 1))
        seen = n[1 : span + 1].sum(axis=1)
        gain = np.exp((seen * (odds[1:] - odds[0]) / 2 + PRIOR * math.log(prior)) / (seen + PRIOR))
        out.append(np.clip(gain, 1.05, MOST) if prior > 1 else np.clip(gain, LEAST, 0.95))
    return out


def _crossed(model_of: dict[int, Model], read, schema_names: list[str]):
    """(y, half, text) -> what ``read`` makes of the texts, each half with the model of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            for h, model in model_of.items():
                own = np.flatnonzero(half == h)
                if len(own):
                    part = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(read(model, part.column("text"), part.column("y").to_numpy()), schema_names)

    return run


def _tallied(model: Model, texts: pa.Array, y: np.ndarray) -> list[pa.Array]:
    """Matched words by timer, distance and label."""
    m = model.matched(texts)
    label, n = y[m["text"]], np.zeros((len(TIMERS), 8, 2), dtype=np.int64)
    for k, ((_, _, on, _), d) in enumerate(zip(TIMERS, distances(m["state"]), strict=True)):
        own = np.isin(m["kind"], on)
        np.add.at(n, (k, d[own], label[own]), 1)
    return [pa.array([n.ravel().tolist()], pa.list_(pa.int64()))]


def _featured(model: Model, texts: pa.Array, y: np.ndarray) -> list[pa.Array]:
    return [pa.array(y), pa.array(list(model.features(texts)), pa.list_(pa.float64()))]


def fit(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled ids, those of the lowest key hash, each text whole.

    Texts stay on the executors: what reaches the driver are counts of associated words, tallies, and a short row of features for
    each text.  The weighting is learned on each half of the ids with the other half's lexicon, then the lexicon on all; half the
    texts show half the evidence, on the scale of its logarithm.  Null ids, texts and labels teach nothing; an id labelled twice
    has the larger label; of texts that share an id the one of the lowest hash counts, once.  Without labels, or of one label only,
    the score is the same for all texts.  Further columns are not read.
    """
    tune(df.sparkSession)
    known = only(labels, **{doc_id: "doc", label: "y"}).where("doc is not null and y is not null").groupBy("doc").agg((F.max("y") > 0).cast("long").alias("y"))
    known = known.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    docs = only(df, **{doc_id: "doc", text: "text"}).where(F.col("text").isNotNull())
    half = F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(2)).cast("long").alias("half")
    one = docs.join(F.broadcast(known), "doc").groupBy("doc", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sample = stored(one.select("y", half, "t.text"))
    totals = np.zeros(4, dtype=np.int64)
    for r in sample.groupBy("half", "y").count().collect():
        totals[2 * r["half"] + r["y"]] = r["count"]
    if not totals[1::2].any() or not totals[::2].any():
        discard(sample)
        return Model(beta=np.array([6.0 if totals.any() and totals[1::2].any() else -6.0] + [0.0] * FEATURES))
    counted = sample.mapInArrow(lean(_counted), "key long, stem boolean, n0 long, n1 long, n2 long, n3 long").groupBy("key", "stem").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(4)))
    # Only what may be associated on all or on half the texts comes to the driver: more than two toxic texts in which it is over-represented.
    t, c = F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2")
    base = float(totals[1::2].sum() / totals.sum())
    share = t / (t + c)
    gain = t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
    got = counted.where((t >= 2) & (share > base) & (gain >= -math.log(CHANCE) / 3)).toPandas()
    counts = {name: got[name].to_numpy() for name in got.columns} | {"key": got["key"].to_numpy().astype(np.int64).astype(np.uint64)}
    half_of = {h: lexicon(counts, totals, (1 - h,), math.sqrt(CHANCE)) for h in (0, 1)}
    model = lexicon(counts, totals, (0, 1))
    tallies = sample.mapInArrow(lean(_crossed(half_of, _tallied, ["n"])), "n array<bigint>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    tally = np.zeros(len(TIMERS) * 16, dtype=np.int64)
    for r in tallies:
        tally[r["pos"]] = r["n"]
    model.gains = half_of[0].gains = half_of[1].gains = learned_gains(tally.reshape(len(TIMERS), 8, 2))
    rows_ = sample.mapInArrow(lean(_crossed(half_of, _featured, ["y", "x"])), "y long, x array<double>").toPandas()
    discard(sample)
    order = sorted(range(len(rows_)), key=lambda i: (rows_["y"][i], tuple(rows_["x"][i])))
    x = np.vstack([np.asarray(rows_["x"][i]) for i in order])
    model.beta = logistic(x, rows_["y"].to_numpy()[order].astype(float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, 0 to 1.  Null and empty texts have no matched clause and get the lowest score.

    Every row is scored by its whole text alone: repeated rows alike, an empty table gives no rows.  A column that is already
    called ``out`` is replaced; others may have any name.
    """
    tune(df.sparkSession)

    @F.pandas_udf("double")
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(lambda own: (pd.Series(model.score(pa.array(c, pa.string(), from_pandas=True))) for c in own))(columns)

    return df.withColumn(out, scored(F.col(f"`{text}`")))
