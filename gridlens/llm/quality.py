"""Quality and toxicity classification by co-training two views of a document.

The text view sees the words; the metadata view sees language, source, length
and the make-up of the page (lines and classes of characters).  Both are
logistic regressions that start from a bounded sample of labelled rows.  In each
round both score all unlabelled texts (copies count once), each passes all of which
it is confident to the other as pseudo-labels, and both are fitted on, by gradients
summed over the tasks, those of all models in one pass.  Each view is then calibrated on labelled rows kept out of fitting, and a third regression on these
rows combines the calibrated views, which scores all documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Tables, cut_lineage
from .textvec import NOT_SPACE, flat, prefix_hash, range_hash, slices, words

FIT_ROWS = 4000          # labelled rows in the sample; a quarter of them calibrate
SURE = 0.95              # calibrated probability from which a view is confident
ROUNDS = 2
TEXT_BITS, META_BITS = 18, 10
STEPS, RATE, RIDGE = 120, 0.05, 1e-4
SHARED_STEPS = 15        # of a round, on labelled rows and pseudo-labels
POINT = 2.0 ** 32        # gradients are summed as whole numbers of 1 / POINT: in any order the same
APART = 4                # standard errors
NO_ID = -2 ** 63


def _classes() -> list[np.ndarray]:
    code = np.arange(256)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    digit, blank = (code >= 48) & (code <= 57), np.isin(code, [9, 11, 12, 13, 32])
    return [(code >= 65) & (code <= 90), digit, blank, code == 10, code >= 128, (code < 128) & ~letter & ~digit & ~blank & (code != 10)]


CLASSES = _classes()
META_DENSE = len(CLASSES) + 3


@dataclass
class Features:
    """Sparse (row, bucket, value) entries and a dense block."""
    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def text_features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    starts, ends = words(data, offsets, NOT_SPACE)
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes = range_hash(prefix_hash(data), starts, ends)
    key = np.unique((row.astype(np.int64) << TEXT_BITS) | (hashes >> np.uint64(64 - TEXT_BITS)).astype(np.int64))
    at, bucket = key >> TEXT_BITS, key & ((1 << TEXT_BITS) - 1)
    kinds, total = np.bincount(at, minlength=n), np.bincount(row, minlength=n)
    return Features(at, bucket, (1 / np.sqrt(np.maximum(kinds, 1)))[at], np.stack([kinds / np.maximum(total, 1), np.log1p(total)], 1))


def meta_features(data: np.ndarray, offsets: np.ndarray, labels: list[list[str | None]]) -> Features:
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    shares = []
    for members in CLASSES:
        sums = np.concatenate([[0], np.cumsum(members[data])])
        shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    lines = shares[3] * size + 1
    dense = np.stack([*shares, np.log1p(np.diff(offsets)), np.log1p(lines), np.log1p(size / lines)], 1)
    bucket = [zlib.crc32(f"{j}:{v}".encode()) & ((1 << META_BITS) - 1) for j, column in enumerate(labels) for v in column]
    return Features(np.tile(np.arange(n), len(labels)), np.array(bucket, np.int64), np.ones(len(bucket)), dense)


@dataclass
class View:
    """A logistic regression with its calibration."""
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray            # the last is the constant
    slope: float = 1.0
    shift: float = 0.0
    chosen: np.ndarray | None = None     # the only buckets it sees, whatever a text's length (None: all, by their values)

    def seen(self, f: Features) -> Features:
        if self.chosen is None:
            return f
        keep = self.chosen[f.bucket]
        return Features(f.row[keep], f.bucket[keep], np.ones(keep.sum()), f.dense)

    def raw(self, f: Features) -> np.ndarray:
        n, f = len(f.dense), self.seen(f)
        z = np.bincount(f.row, weights=self.weights[f.bucket] * f.value, minlength=n)
        return z + (f.dense - self.mean) / self.scale @ self.dense[:-1] + self.dense[-1]

    def logit(self, f: Features) -> np.ndarray:
        return self.slope * self.raw(f) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Adam:
    """Steps on arrays in place."""
    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.step = parts, 0
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]

    def move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, (m, s), d in zip(self.parts, self.state, grads):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            p -= RATE * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.999 ** self.step)) + 1e-9)


def fit_view(f: Features, y: np.ndarray, bits: int) -> View:
    """Full-batch Adam on the ridge-penalised likelihood; the same rows give the same view."""
    n = len(y)
    mean, scale = f.dense.mean(0), f.dense.std(0) + 1e-9
    dense = np.c_[(f.dense - mean) / scale, np.ones(n)]
    used, bucket = np.unique(f.bucket, return_inverse=True)
    parts = [np.zeros(len(used)), np.zeros(dense.shape[1])]
    adam = Adam(parts)
    for _ in range(STEPS):
        z = np.bincount(f.row, weights=parts[0][bucket] * f.value, minlength=n) + dense @ parts[1]
        g = (sigmoid(z) - y) / n
        adam.move([np.bincount(bucket, weights=g[f.row] * f.value, minlength=len(used)) + RIDGE * parts[0], dense.T @ g + RIDGE * parts[1]])
    weights = np.zeros(1 << bits)
    weights[used] = parts[0]
    return View(weights, mean, scale, parts[1])


def telling(f: Features, y: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of three or more rows whose share of label 1 lies ``APART`` standard errors from that of all rows: a few
    words in a long text tell that it is toxic, and would be lost among all others."""
    rows, ones = np.bincount(f.bucket, minlength=1 << bits), np.bincount(f.bucket, weights=y[f.row], minlength=1 << bits)
    return (rows >= 3) & (np.abs(ones - rows * y.mean()) >= APART * np.sqrt(rows * y.mean() * (1 - y.mean())))


def words_view(f: Features, y: np.ndarray, bits: int) -> View:
    """A view of the telling buckets only."""
    view = View(np.zeros(1 << bits), np.zeros(2), np.ones(2), np.zeros(3), chosen=telling(f, y, bits))
    fitted = fit_view(view.seen(f), y, bits)
    fitted.chosen = view.chosen
    return fitted


def slope_of(view: View, f: Features, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The likelihood's gradient over rows of weight ``w``: of the buckets' weights and the dense ones."""
    f = view.seen(f)
    g = (sigmoid(view.raw(f)) - y) * w
    return [np.bincount(f.bucket, weights=g[f.row] * f.value, minlength=len(view.weights)), np.c_[(f.dense - view.mean) / view.scale, np.ones(len(g))].T @ g]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a few columns and a constant (the last), towards smoothed labels."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.c_[x, np.ones(len(y))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (target - p) - ridge * w)
    return w


@dataclass
class Model:
    text: View
    meta: View
    mixed: np.ndarray            # of the text view's logit, the metadata view's and the constant

    def scores(self, text: Features, meta: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return a, b, self.mixed[0] * a + self.mixed[1] * b + self.mixed[2]


def _flat_model(share: float) -> Model:
    """Without rows of both classes: every document gets the smoothed share of good rows."""
    def none(bits, k):
        return View(np.zeros(1 << bits), np.zeros(k), np.ones(k), np.zeros(k + 1))
    return Model(none(TEXT_BITS, 2), none(META_BITS, META_DENSE), np.array([0, 0, np.log(share / (1 - share))]))


def _pick(f: Features, rows: np.ndarray) -> Features:
    place = np.full(len(f.dense), -1)
    place[rows] = np.arange(len(rows))
    keep = place[f.row] >= 0
    return Features(place[f.row[keep]], f.bucket[keep], f.value[keep], f.dense[rows])


def _featured(rows: DataFrame, meta_cols: list[str], extra: list[str]) -> DataFrame:
    """Features of the rows without their texts: ``extra``, tb, td, mb, md."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("_text")):
                part = batch.slice(a, b - a)
                text, meta = _features(part, meta_cols)
                order = np.argsort(meta.row, kind="stable")
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in extra],
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text.row, minlength=b - a))]).astype(np.int32)), pa.array(text.bucket.astype(np.int32))),
                    pa.array(text.dense.tolist(), pa.list_(pa.float64())), pa.array(meta.bucket[order].reshape(b - a, -1).tolist(), pa.list_(pa.int32())),
                    pa.array(meta.dense.tolist(), pa.list_(pa.float64()))], [*extra, "tb", "td", "mb", "md"])

    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra] + ["tb array<int>", "td array<double>", "mb array<int>", "md array<double>"])
    return rows.mapInArrow(run, schema)


def _read(batch: pa.RecordBatch) -> tuple[Features, Features]:
    """The features back from the columns of ``_featured``."""
    def ragged(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)

    n, parts = batch.num_rows, []
    for buckets, dense, even in (("tb", "td", True), ("mb", "md", False)):
        sizes, bucket = ragged(buckets)
        row = np.repeat(np.arange(n), sizes)
        value = (1 / np.sqrt(np.maximum(sizes, 1)))[row] if even else np.ones(len(row))
        parts.append(Features(row, bucket.astype(np.int64), value, ragged(dense)[1].reshape(n, -1)))
    return parts[0], parts[1]


def _collected(rows: DataFrame, meta_cols: list[str], extra: list[str]) -> tuple[Features, Features, dict[str, np.ndarray]]:
    """Features of a bounded number of rows, on the driver; texts stay with the tasks."""
    got = sorted(_featured(rows, meta_cols, extra).collect(), key=lambda r: tuple((v is None, v or 0) for v in (r[c] for c in extra)))
    sizes = np.array([len(r.tb) for r in got], int)
    text = Features(np.repeat(np.arange(len(got)), sizes), np.array([b for r in got for b in r.tb], np.int64),
                    np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes), np.array([r.td for r in got], float).reshape(len(got), 2))
    meta = Features(np.repeat(np.arange(len(got)), len(meta_cols)), np.array([b for r in got for b in r.mb], np.int64),
                    np.ones(len(got) * len(meta_cols)), np.array([r.md for r in got], float).reshape(len(got), META_DENSE))
    return text, meta, {c: np.array([r[c] for r in got]) for c in extra}


def _label(labels: DataFrame, col: str) -> DataFrame:
    """(_id, _y): the least label of each id; none where there is no such column."""
    label = F.col(col) if col in labels.columns else F.lit(None)
    return labels.select(F.col("doc_id").cast("long").alias("_id"), label.cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y"))


def _unlabelled(rows: DataFrame, labelled: DataFrame, meta_cols: list[str]) -> DataFrame:
    """Features of each text of rows without a label, once: of the row with the least id.
    Only features are shuffled, by id and text hash, so that copies do not meet."""
    keyed = rows.withColumn("_k", F.coalesce("_id", F.lit(NO_ID)))
    first = keyed.select("_id", "_k", "_h").join(labelled.select("_id"), "_id", "left_anti").groupBy("_h").agg(F.min("_k").alias("_k"))
    return _featured(keyed, meta_cols, ["_k", "_h"]).join(first, ["_k", "_h"]).dropDuplicates(["_k", "_h"])


def _summed(feats: DataFrame, size: int, fn) -> np.ndarray:
    """The sum over all rows of ``fn`` (text features, metadata features) -> ``size`` whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += fn(*_read(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = feats.select("tb", "td", "mb", "md").mapInArrow(run, "sum binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(size, np.int64)


def _taught(z: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, weight) of the rows by the other view's logit; an unsure row weighs nothing."""
    sure = float(np.log(SURE / (1 - SURE)))
    return (z > 0).astype(float), np.where(z >= sure, weight[1], np.where(z <= -sure, weight[0], 0.0))


def _features(batch: pa.RecordBatch, meta_cols: list[str]) -> tuple[Features, Features]:
    data, offsets = flat(batch.column("_text"))
    return text_features(data, offsets), meta_features(data, offsets, [batch.column(f"_m{j}").to_pylist() for j in range(len(meta_cols))])


def _scored(rows: DataFrame, models, meta_cols: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("_text")):
                part = batch.slice(a, b - a)
                good, toxic = [m.scores(*features) for features in [_features(part, meta_cols)] for m in models.value]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_h"), *[pa.array(z) for z in (*good, toxic[2])]], ["_id", "_h", "zt", "zm", "z", "zx"])

    return rows.mapInArrow(run, "_id long, _h long, zt double, zm double, z double, zx double")


def _combined(views: list[View], held: tuple[Features, Features, np.ndarray]) -> Model:
    """Calibrate both views on the held-out rows and combine them there."""
    for view, f in zip(views, held):
        view.slope, view.shift = fit_logistic(view.raw(f)[:, None], held[2])
    logits = np.stack([v.logit(f) for v, f in zip(views, held)], 1)
    return Model(*views, fit_logistic(logits, held[2]))


def _told(model: Model, f: tuple[Features, Features]) -> tuple[np.ndarray, np.ndarray]:
    """What each view hears: the logit of the other one."""
    return model.meta.logit(f[1]), model.text.logit(f[0])


def _taught_views(feats: DataFrame, models: list[Model], own: list[tuple[Features, Features, np.ndarray]], picks: list[float]) -> list[list[View]]:
    """For each model both views fitted on, on its labelled rows and on all pseudo-labels that the other
    view gives; those of a class weigh as much as ``picks`` labelled rows at most.  A pass over the
    features sums the gradients of all models."""
    context = feats.sparkSession.sparkContext
    views = [[View(v.weights.copy(), v.mean, v.scale, v.dense.copy(), chosen=v.chosen) for v in (m.text, m.meta)] for m in models]
    teachers = context.broadcast(models)

    def count(*f: Features) -> np.ndarray:
        told = [_taught(z, np.ones(2)) for m in teachers.value for z in _told(m, f)]
        return np.array([((label == c) & (w > 0)).sum() for label, w in told for c in (0, 1)], np.int64)

    counts = _summed(feats, 4 * len(models), count).reshape(-1, 2, 2)         # model, view, class
    moved = [k for k in range(len(models)) if counts[k].any()]
    if not moved:
        return views
    weight = [np.minimum(1, p / np.maximum(c, 1)) for p, c in zip(picks, counts)]
    total = [len(base[2]) + (w * c).sum(1) for base, w, c in zip(own, weight, counts)]
    places = [[np.arange(len(v.weights)) if v.chosen is None else np.flatnonzero(v.chosen) for v in pair] for pair in views]     # of the weights that move
    ends = np.cumsum([size for k in moved for v, at in zip(views[k], places[k]) for size in (len(at), len(v.dense))])
    steps = [[Adam([v.weights, v.dense]) for v in pair] for pair in views]
    for _ in range(SHARED_STEPS):
        now = context.broadcast(views)

        def gradient(*f: Features) -> np.ndarray:
            parts = []
            for k in moved:
                for view, at, own_f, z, w in zip(now.value[k], places[k], f, _told(teachers.value[k], f), weight[k]):
                    buckets, dense = slope_of(view, own_f, *_taught(z, w))
                    parts += [buckets[at], dense]
            return np.rint(np.concatenate(parts) * POINT).astype(np.int64)

        sums = iter(np.split(_summed(feats, int(ends[-1]), gradient) / POINT, ends[:-1]))
        for k in moved:
            y = own[k][2]
            for j, (view, adam) in enumerate(zip(views[k], steps[k])):
                told = [np.zeros(len(view.weights)), None]
                told[0][places[k][j]], told[1] = next(sums), next(sums)
                labelled = slope_of(view, own[k][j], y, np.ones(len(y)))
                adam.move([(a + b) / total[k][j] + RIDGE * p for a, b, p in zip(told, labelled, adam.parts)])
        now.destroy()
    return views


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], label_col: str, toxic_col: str,
          fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, picks: float | None = None) -> tuple[DataFrame, list[Model]]:
    """(rows to score, the models of ``label_col`` and ``toxic_col``).  The driver holds the weights and the
    features of at most ``fit_rows`` labelled rows a model.  All sure texts of ids without any label
    are pseudo-labels; those of a class weigh together as much as ``picks`` labelled rows at most
    (None: half of the labelled ones)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       *[F.col(c).cast("string").alias(f"_m{j}") for j, c in enumerate(meta_cols)])
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    given = [_label(labels, c) for c in (label_col, toxic_col)]
    models, bases = [], {}
    for k, (one, text_view) in enumerate(zip(given, (fit_view, words_view))):
        known = F.broadcast(cut_lineage(one.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)))      # at most fit_rows rows
        text, meta, got = _collected(rows.join(known, "_id"), meta_cols, ["_id", "_h", "_y"])
        y = got["_y"].astype(float)
        if len(set(y.tolist())) < 2 or min(y.sum(), (1 - y).sum()) < 4:
            models.append(_flat_model((y.sum() + 1) / (len(y) + 2)))
            continue
        held = np.flatnonzero([zlib.crc32(str(i).encode()) % 4 == 0 for i in got["_id"].tolist()])
        if len(set(y[held].tolist())) < 2:
            held = np.arange(len(y))
        own = np.setdiff1d(np.arange(len(y)), held) if len(held) < len(y) else held
        if len(set(y[own].tolist())) < 2:
            own = np.arange(len(y))
        out, base = [(_pick(text, at), _pick(meta, at), y[at]) for at in (held, own)]
        models.append(_combined([text_view(base[0], base[2], TEXT_BITS), fit_view(base[1], base[2], META_BITS)], out))
        bases[k] = base, out
    if rounds and bases:
        tables = Tables(docs.sparkSession)
        feats = tables.store(_unlabelled(rows, reduce(DataFrame.unionByName, given), meta_cols))
        learned = list(bases)
        base, out = [[bases[k][j] for k in learned] for j in (0, 1)]
        weigh = [len(b[2]) / 2 if picks is None else picks for b in base]
        for _ in range(rounds):
            taught = _taught_views(feats, [models[k] for k in learned], base, weigh)
            for k, pair, held in zip(learned, taught, out):
                models[k] = _combined(pair, held)
        tables.clear()
    return rows, models


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: list[str] | None = None,
                   label_col: str = "quality", keep_from: float = 0.5, toxic_col: str = "toxic", **fit) -> DataFrame:
    """One row per input row: doc_id, text_hash, text_score, meta_score, score (0 to 1), keep (score >= ``keep_from``),
    toxic_score (0 to 1) and toxic (toxic_score > 0.5).  Quality and toxicity are judged apart: a kept row can be toxic.

    ``labels`` has doc_id, ``label_col`` (1 good, 0 bad) and perhaps ``toxic_col`` (1 toxic, 0 clean); the least counts
    where an id is labelled twice.  A null text is scored as empty, null metadata as a value of its
    own; null ids and repeated rows keep their rows.  Without labels of both classes all
    rows get the smoothed share of good or toxic labels (0.5 without labels, which keeps them).  An
    empty table gives an empty one."""
    meta_cols = ["lang", "source"] if meta_cols is None else meta_cols
    rows, models = train(docs, labels, id_col, text_col, meta_cols, label_col, toxic_col, **fit)
    scored = _scored(rows, docs.sparkSession.sparkContext.broadcast(models), meta_cols)

    def share(z: str):
        return 1 / (1 + F.exp(-F.col(z)))
    return scored.select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), share("zt").alias("text_score"), share("zm").alias("meta_score"),
                         share("z").alias("score"), (share("z") >= keep_from).alias("keep"), share("zx").alias("toxic_score"), (F.col("zx") > 0).alias("toxic"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: list[str] | None = None,
              label_col: str = "quality", keep_from: float = 0.5, toxic_col: str = "toxic", **fit) -> DataFrame:
    """The documents, with all their columns, whose score reaches ``keep_from`` and which are not toxic; texts are
    not shuffled: the rows are judged where they are read."""
    meta_cols = ["lang", "source"] if meta_cols is None else meta_cols
    _, models = train(docs, labels, id_col, text_col, meta_cols, label_col, toxic_col, **fit)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    level = float(np.log(keep_from / (1 - keep_from)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(names.index(text_col))):
                part = batch.slice(a, b - a)
                own = pa.RecordBatch.from_arrays([part.column(names.index(text_col)), *[part.column(names.index(c)).cast(pa.string()) for c in meta_cols]],
                                                 ["_text", *[f"_m{j}" for j in range(len(meta_cols))]])
                features = _features(own, meta_cols)
                good, toxic = [m.scores(*features)[2] for m in sent.value]
                yield part.filter(pa.array((good >= level) & ~(toxic > 0)))

    return docs.mapInArrow(run, docs.schema)
