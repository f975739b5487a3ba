"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's feature counts are its character n-grams inside words (word edges marked by one space), hashed into
``BUCKETS``; its vector is the mean of their embeddings. As everything before the softmax is linear, the trained
model folds into one table of a logit per bucket and language, which executors apply to whole texts with array
arithmetic. Probabilities are calibrated by a temperature fitted to validation documents. As a softmax is sure of
texts in no learned language too, a second table holds the log-frequency of each bucket in each language; a text's
mean of it, standardised by what right validation predictions of its length show, is its *fit*. Below ``reject``
(a probability) or below ``least_fit`` a prediction counts as rejected. Both lie between right validation predictions
and negatives: validation texts whose language is held back, and, for the fit, such with their letters shuffled. With
one language, ``least_fit`` is what SCARCE of the right ones don't reach.

Fitting sees at most ``fit_docs`` labelled documents, those that come first by a hash of doc_id: a model needs no
more, and the bound keeps the driver's memory. Prediction sees only the text.

Edge cases: null text or text without a letter is ``und`` with score 0; rows of null lang don't train; with no
labelled row at all every text is ``und``; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, hash_sample, held_out, map_texts

BUCKETS, DIM, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
FIT_DOCS, EPOCHS, BATCH, RATE = 2400, 6, 32, 0.5
SCARCE = 0.001
#: Share of a bucket's log-frequency that comes from no text, for buckets that a language doesn't use.
UNSEEN = 0.05
#: Code points below this are told letters from others by a table, the rest one by one.
TABLE = 0x3000
#: Code points featurised at a time.
RUN = 1 << 18

_LETTER = None


def codes(text: str) -> np.ndarray:
    """Lower-case code points; whatever isn't a letter becomes 32."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(TABLE)])
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(c, TABLE - 1)]
    if len(c) and c.max() >= TABLE:
        high = c >= TABLE
        known = {int(x): chr(x).isalpha() for x in np.unique(c[high])}
        letter = letter.copy()
        letter[high] = [known[int(x)] for x in c[high]]
    return np.where(letter, c, np.uint32(32))


def counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs, over the whole text; None if it has no letter."""
    c = codes(text)
    if not (c != 32).any():
        return None
    c = np.concatenate(([32], c, [32])).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(c), RUN):
        part = c[max(0, at - max(GRAMS) + 1) : at + RUN]
        skip = min(at, max(GRAMS) - 1)
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            inside = np.ones(m, bool)
            for k in range(n):
                h = (h + part[k : k + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1 or n == 1:
                    inside &= part[k : k + m] != 32
            if n > 1:  # not two edges of words only
                inside &= (part[:m] != 32) | (part[n - 1 :] != 32)
            inside[: max(0, skip - n + 1)] = False  # ends in the part before
            total += np.bincount((h >> np.uint64(50)).astype(np.int64)[inside], minlength=BUCKETS)
    return total


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs
    bias: np.ndarray
    temperature: float
    reject: float
    logs: np.ndarray  # BUCKETS x langs
    mean: np.ndarray  # of logs per language
    spread: tuple[float, float]  # variance, and variance times n-grams
    least_fit: float

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected)."""
        n = counts(text) if text and self.langs else None
        if n is None:
            return "und", 0.0, True
        total = n.sum()
        at = np.flatnonzero(n)
        n = n[at] / total
        p = softmax((n @ self.table[at] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        fit = (n @ self.logs[at, k] - self.mean[k]) / np.sqrt(self.spread[0] + self.spread[1] / total)
        return self.langs[k], float(p[k]), bool(p[k] < self.reject or fit < self.least_fit)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """SGD over the rows in order of a seeded shuffle; every fifth row only calibrates."""
    sparse, known, whole = [], [], []
    for text, lang in zip(texts, langs):
        c = counts(text or "")
        if c is not None:  # only what occurs is kept: a row of all buckets would cost the driver 128 KB
            at = np.flatnonzero(c)
            sparse.append((at.astype(np.int32), (c[at] / c.sum()).astype(np.float32)))
            known.append(lang)
            whole.append(text)
    names = sorted(set(known))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0, np.zeros((BUCKETS, 0)), np.zeros(0), (1.0, 0.0), 0.0)
    y = np.array([names.index(v) for v in known])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check = order[::5] if len(y) >= 50 else order
    fit = np.setdiff1d(order, check, assume_unique=True) if len(y) >= 50 else order
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    steps = max(steps, 150)
    ge, gw = np.full(BUCKETS, 1e-6, np.float32), np.float32(1e-6)
    while done < steps:
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            x = np.zeros((len(part), BUCKETS), np.float32)
            for i, r in enumerate(part):
                x[i, sparse[r][0]] = sparse[r][1]
            h = x @ e
            d = softmax(h @ w + b)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            de, dw = x.T @ (d @ w.T), h.T @ d
            ge += (de * de).mean(1)  # Adagrad: a rate per bucket
            gw += (dw * dw).mean()
            e -= RATE * de / np.sqrt(ge)[:, None]
            w -= RATE * 0.2 * dw / np.sqrt(gw)
            b -= RATE * 0.2 * d.sum(0)
            done += 1
            if done >= steps:
                break
    table = (e @ w).astype(np.float64)
    z = np.array([sparse[r][1] @ table[sparse[r][0]] + b for r in check])
    yc = y[check]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(yc)), yc] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(z / temperature)
    bad = np.array([])
    if len(names) > 2:  # each text as if its language hadn't been learned
        rest = z.copy()
        rest[np.arange(len(yc)), yc] = -np.inf
        bad = log_odds(rest / temperature)
    reject = float(1 / (1 + np.exp(-between(log_odds(z / temperature)[p.argmax(1) == yc], np.append(bad, 0.0))))) if len(names) > 1 else 0.0
    return Model(names, table, b.astype(np.float64), temperature, reject, *fit_bounds([sparse[r] for r in fit], y[fit], [whole[r] for r in check], yc, z, rng))


def scarce(values: np.ndarray) -> float:
    """The value under which SCARCE of the distribution falls: of few values, that of a normal law, if it is less."""
    if not len(values):
        return -np.inf
    return float(min(np.quantile(values, SCARCE), values.mean() + NormalDist().inv_cdf(SCARCE) * values.std()))


def between(good: np.ndarray, bad: np.ndarray) -> float:
    """Midway between ``scarce(good)`` and what nine in ten of ``bad`` under it don't reach."""
    low = scarce(good)
    under = bad[bad < low]
    return (low + float(np.quantile(under, 0.9))) / 2 if len(under) else low


def log_odds(z: np.ndarray) -> np.ndarray:
    """ln(p / (1 - p)) of the most probable language."""
    top = np.sort(z, 1)
    return -np.log(np.exp(top[:, :-1] - top[:, -1:]).sum(1) + 1e-300)


def fit_bounds(sparse: list, y: np.ndarray, texts: list[str], yc: np.ndarray, z: np.ndarray, rng) -> tuple:
    """(logs, mean, spread, least_fit) from training rows and validation ``texts`` with their languages and logits."""
    k = z.shape[1]
    seen = np.zeros((BUCKETS, k))
    for (at, share), lang in zip(sparse, y):
        seen[at, lang] += share
    logs = np.log((1 - UNSEEN) * seen / np.maximum(seen.sum(0), 1e-9) + UNSEEN / BUCKETS)

    def value(text: str) -> tuple[np.ndarray, int]:
        c = counts(text)
        at = np.flatnonzero(c)
        return (c[at] / c.sum()) @ logs[at], int(c.sum())

    own = [value(t) for t in texts]
    v, n = np.array([o[0] for o in own]), np.array([o[1] for o in own], float)
    rows = np.arange(len(yc))
    right = z.argmax(1) == yc
    mean = np.array([np.average(v[yc == i, i], weights=np.minimum(n[yc == i], 1000)) if (yc == i).any() else v.max(1).mean() for i in range(k)])
    off = v[rows, yc] - mean[yc]  # its variance a + b / n: b from the shorter half, a from the longer
    short = n <= np.median(n)
    spread = (float(max(np.mean(off[~short] ** 2) if (~short).any() else 0.0, 1e-4)), float(np.mean(off[short] ** 2 * n[short])))
    fits = lambda v, n, i: (v[np.arange(len(i)), i] - mean[i]) / np.sqrt(spread[0] + spread[1] / n)
    good = fits(v, n, yc)[right]
    bad = []
    if k > 1:  # each text as if its language hadn't been learned
        rest = z.copy()
        rest[rows, yc] = -np.inf
        bad.append(fits(v, n, rest.argmax(1)))
    mixed = [value("".join(np.array(list(t))[rng.permutation(len(t))])) for t in texts]
    mv, mn = np.array([o[0] for o in mixed]), np.array([o[1] for o in mixed], float)
    bad.append(fits(mv, mn, yc))
    bad = np.concatenate(bad)
    # shuffled letters alone lie so far off that midway would let other languages pass
    return logs, mean, spread, between(good, bad) if k > 1 else scarce(good)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model from at most ``fit_docs`` rows of non-null lang that aren't held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = hash_sample(rows.select("doc_id", "text", "lang"), fit_docs, "doc_id", "text")
    table = picked.select("text", "lang").toArrow()
    return train(table["text"].to_pylist(), table["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and lang_rejected, in one pass without a shuffle.

    Columns of these names give way; a ``prefix`` keeps them.
    """
    added = [prefix + c for c in ("lang_pred", "score", "lang_rejected")]
    keep = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the corpus

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found = [m.judge(t) for t in column(batch, "text").to_pylist()]
        names, scores = [f[0] for f in found], [f[1] for f in found]
        refused = [f[2] for f in found]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], [*keep, *added])

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return map_texts(docs.select(*keep), kernel, schema)
