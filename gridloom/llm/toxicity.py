"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters, lower case) are hashed into ``BUCKETS`` buckets; those that at least LEAST_DOCS training
documents hold get an embedding, all others share one that is zero, so that an unseen word says nothing. Filters of several widths slide over
the word sequence, each filter's largest response is kept (max pooling), and a linear layer gives the logit. All
parameters start at random; each training step takes a share of the words for unknown (word dropout).
Training stops at the epoch with the least log loss on validation rows. The product of embedding and filter is precomputed for every embedding and filter position, so that scoring a whole text
is a few array gathers a word, on executors, without a shuffle.

Scores are calibrated on validation rows by logistic (Platt) scaling, and each language gets its own threshold:
the score with the best F1 on its validation rows, or the overall one where a language has under LEAST_POSITIVE
toxic rows. The language chooses a threshold only; labels, lang, source and doc_id never enter a score.

Fitting sees at most ``fit_docs`` labelled documents, those that come first by a hash of doc_id.

Edge cases: null, empty and letterless texts score as a text without words; null toxic doesn't train; with no
labelled row, or labels of one kind only, every score is that kind's share; repeated doc_ids in labels count each;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import column, hash_sample, held_out, map_texts
from gridloom.llm.langid import codes

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 16, (1, 2, 3), 16
FIT_DOCS, EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 6000, 40, 300, 32, 0.01, 0.03
#: Share of words that a training step takes for unknown, so that no filter rests on a few words.
DROPPED = 0.6
LEAST_DOCS = 3
LEAST_POSITIVE = 20
#: Code points hashed at a time; longer texts are cut between words.
RUN = 1 << 20
THRESHOLD = 0.3

_R = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for r in (_R, inverse):
            a = np.full(RUN + 64, r, np.uint64)
            a[0] = 1
            _POW.append(np.multiply.accumulate(a))
    return _POW[0], _POW[1]


def words(text: str | None) -> np.ndarray:
    """The bucket of every word, in order, of the whole text."""
    c = codes(text or "")
    out = []
    while len(c):
        cut = len(c)
        if cut > RUN:  # between words where there is a gap
            gap = np.flatnonzero(c[:RUN] == 32)
            cut = int(gap[-1]) + 1 if len(gap) else RUN
        part, c = c[:cut], c[cut:]
        letter = np.concatenate(([False], part != 32, [False]))
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        up, down = _powers()
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        h = (run[ends] - run[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        out.append((h * np.uint64(0x94D049BB133111EB) >> np.uint64(44)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' buckets behind one another, each followed by padding (0, the zero embedding); where each starts."""
    pad = np.zeros(max(WIDTHS), np.int32)
    starts = np.concatenate(([0], np.cumsum([len(d) + len(pad) for d in docs])[:-1]))
    return np.concatenate([x for d in docs for x in (d, pad)]), starts.astype(np.int64)


def highest(z: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest response per filter and where its windows end; none reaches into the next text."""
    ends = np.append(starts[1:] - width + 1, len(z))
    return np.maximum.reduceat(z, np.stack([starts, ends], 1).ravel()[:-1], axis=0)[::2], ends


def relu(x):
    return np.maximum(x, 0)


@dataclass
class Model:
    index: np.ndarray | None = None  # embedding of each bucket, 0 for the zero one
    tables: list[list[np.ndarray]] = field(default_factory=list)  # by width, by position: embeddings x FILTERS
    shift: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD
    prior: float = 0.0

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        flat, starts = pack([self.index[d] for d in docs])
        parts = []
        for tables, shift in zip(self.tables, self.shift):
            n = len(flat) - len(tables) + 1
            z = tables[0][flat[:n]]
            for k in range(1, len(tables)):
                z = z + tables[k][flat[k : k + n]]
            parts.append(relu(highest(z, starts, len(tables))[0] + shift))
        return np.concatenate(parts, axis=1)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.out is None:
            return np.full(len(docs), self.prior)
        z = np.clip(self.slope * self.logits(docs).astype(np.float64) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def train(docs: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = 5) -> Model:
    """Adam on the log loss; every fourth row calibrates and isn't trained on."""
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)])
    check, fit = order[::4], np.delete(order, np.s_[::4])
    if len(fit) == 0 or y[fit].min() == y[fit].max():
        check = fit = order
    n_docs = np.bincount(np.concatenate([np.unique(docs[i]) for i in fit]), minlength=BUCKETS)
    common = np.flatnonzero(n_docs >= LEAST_DOCS)
    index = np.zeros(BUCKETS, np.int32)
    index[common] = np.arange(1, len(common) + 1)
    inner = [index[d] for d in docs]
    params = [rng.normal(0, 0.01, (len(common) + 1, DIM)).astype(np.float32)]
    params[0][0] = 0
    for w in WIDTHS:
        params += [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32)]
    params += [np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32), np.full(1, np.log(y.mean() / (1 - y.mean())), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps, done, best = max(LEAST_STEPS, EPOCHS * -(-len(fit) // BATCH)), 0, (np.inf, None)
    while done < steps:
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            flat, starts = pack([inner[i] for i in part])
            flat = np.where(rng.random(len(flat)) < DROPPED, 0, flat)
            emb, grads = params[0], [np.zeros_like(p) for p in params[1:]]
            x = emb[flat]
            pooled, where = [], []
            for j, w in enumerate(WIDTHS):
                n = len(flat) - w + 1
                z = sum(x[k : k + n] @ params[1 + 2 * j][k] for k in range(w))
                top, ends = highest(z, starts, w)
                arg = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends)])
                pooled.append(top + params[2 + 2 * j])
                where.append(arg)
            h = np.concatenate(pooled, 1)
            a = relu(h)
            p = 1 / (1 + np.exp(-np.clip(a @ params[-2] + params[-1], -30, 30)))
            d = (p - y[part]) / len(part)
            grads[-2][:], grads[-1][:] = a.T @ d, d.sum()
            dh = (d[:, None] * params[-2]) * (h > 0)
            rows, vals = [], []
            for j, w in enumerate(WIDTHS):
                dj = dh[:, j * FILTERS : (j + 1) * FILTERS]
                grads[2 * j + 1] += dj.sum(0)
                for k in range(w):
                    at = flat[where[j] + k]  # docs x filters
                    grads[2 * j][k] = np.einsum("nfd,nf->df", emb[at], dj)
                    rows.append(at.ravel())
                    vals.append((dj[:, :, None] * params[1 + 2 * j][k].T[None]).reshape(-1, DIM))
            rows, vals = np.concatenate(rows), np.concatenate(vals)
            touched, inv = np.unique(rows, return_inverse=True)
            ge = np.zeros((len(touched), DIM), np.float32)
            np.add.at(ge, inv, vals)
            ge += DECAY / len(part) * emb[touched]
            ge[touched == 0] = 0
            done += 1
            scale = RATE * np.sqrt(1 - 0.999**done) / (1 - 0.9**done)
            for i, (p_, g) in enumerate(zip(params[1:], grads), 1):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                p_ -= scale * first[i] / (np.sqrt(second[i]) + 1e-7)
            m, v = first[0], second[0]  # rows without a gradient rest
            m[touched] += 0.1 * (ge - m[touched])
            v[touched] += 0.001 * (ge * ge - v[touched])
            emb[touched] -= scale * m[touched] / (np.sqrt(v[touched]) + 1e-7)
            if done >= steps:
                break
        model = fold(index, params)
        z = np.concatenate([model.logits([docs[i] for i in check[at : at + 64]]) for at in range(0, len(check), 64)])
        best = min(best, (float(np.logaddexp(0, np.where(y[check] == 1, -z, z)).mean()), model), key=lambda x: x[0])
    model = best[1]
    calibrate(model, [docs[i] for i in check], y[check], [langs[i] for i in check])
    return model


def fold(index: np.ndarray, params: list[np.ndarray]) -> Model:
    model = Model(index=index, out=params[-2].copy(), bias=float(params[-1][0]))
    for j, w in enumerate(WIDTHS):
        model.tables.append([params[0] @ params[1 + 2 * j][k] for k in range(w)])
        model.shift.append(params[2 + 2 * j].copy())
    return model


def calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None]) -> None:
    """Platt scaling by Newton steps on smoothed targets, then a threshold per language."""
    z = np.concatenate([model.logits(docs[i : i + 64]) for i in range(0, len(docs), 64)]).astype(np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))

    def best(at: np.ndarray) -> float:
        grid = np.arange(0.1, 0.91, 0.05)
        f1 = [2 * (y[at] * (p[at] >= c)).sum() / max(1, y[at].sum() + (p[at] >= c).sum()) for c in grid]
        return float(np.mean(grid[np.flatnonzero(np.isclose(f1, max(f1)))]))  # the middle of the best

    names = np.array([x or "" for x in langs])
    model.threshold = best(np.arange(len(y)))
    for lang in np.unique(names):
        at = np.flatnonzero(names == lang)
        if y[at].sum() >= LEAST_POSITIVE:
            model.thresholds[str(lang)] = best(at)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model from at most ``fit_docs`` labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = hash_sample(known.filter(~held_out()), fit_docs, "doc_id", "toxic")
    has_lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", has_lang.alias("lang")).join(F.broadcast(known), "doc_id")  # fit_docs rows at most

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [words(t).tobytes() for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), column(batch, "toxic"), column(batch, "lang"), column(batch, "doc_id")], ["words", "toxic", "lang", "doc_id"])

    table = map_texts(rows, kernel, "words binary, toxic int, lang string, doc_id long").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("words", "ascending")])
    return train([np.frombuffer(b, np.int32) for b in table["words"].to_pylist()], np.array(table["toxic"].to_pylist(), np.float32), table["lang"].to_pylist())


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with score and toxic_rejected, by the threshold of the row's language.

    Columns of these names give way; a ``prefix`` keeps them.
    """
    added = [prefix + c for c in ("score", "toxic_rejected")]
    keep = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = np.zeros(0)
        texts = [words(t) for t in column(batch, "text").to_pylist()]
        for at in range(0, len(texts), 32):
            s = np.append(s, m.scores(texts[at : at + 32]))
        langs = column(batch, "lang").to_pylist() if "lang" in keep else [None] * len(texts)
        refused = s >= np.array([m.thresholds.get(x or "", m.threshold) for x in langs])
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(s, pa.float64()), pa.array(refused, pa.bool_())], [*keep, *added])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.BooleanType())])
    return map_texts(docs.select(*keep), kernel, schema)
