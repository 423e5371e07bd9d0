"""Document quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Statistics of the whole text: lengths, kinds of characters, repetition of words, word pairs and
   lines, punctuation on words.  Nothing else of a row is used.
2. cos(xW + b) with Gaussian W approximates a Gaussian kernel on the standardised statistics.
3. Ridge scores from normal equations, summed by partition and then by block of rows, so that what
   reaches the driver depends on the number of features alone.
4. Isotonic regression of the labels on the scores that the two halves of the training rows give each
   other, over `BINS` bins of the score; it makes scores probabilities.

Training uses at most about `max_rows` labelled rows, chosen by a hash of the id (all, where fewer).

Null or empty texts have a score like any other.  Labels other than 0 and 1, and null ones, are not
used; a document with several labels counts once for each.  Without usable labels every score is
0.5; with one kind only, it is that kind's share.  A null id is not held out.  Other columns of the
tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import saved
from leafmill.llm.memory import lean
from leafmill.llm.rolling import U64, buffer_of, fingerprints, mix, pieces, words_of

FEATURES, WIDTH, RIDGE, BINS, BLOCKS, SEED = 320, 0.35, 1e-3, 400, 8, 7
MAX_ROWS = 20_000
#: Where words and lines are hashed, in the prime field of `rolling`; figures of a text are the same in every run.
BASE = 0x0B4D15C0FFEE1234

_KIND = np.zeros(256, np.int64)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1
_KIND[0x0A] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 7
_KIND[128:] = 8
N_STATISTICS = 19


def _per_row(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[cut[1:]] - total[cut[:-1]]


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many of its values are distinct and how often the commonest occurs."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    count = np.diff(np.concatenate((first, [len(h)])))
    most = np.zeros(n)
    np.maximum.at(most, r[first], count)
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of figures for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    counts = [_per_row(kind == k, offsets) for k in range(1, 9)]
    space, line, digit, upper, lower, mark, symbol, wide = counts
    starts, ends, cut = words_of(data, offsets)
    words = np.diff(cut).astype(float)
    rows = np.repeat(np.arange(n), np.diff(cut))
    length = (ends - starts).astype(float)
    hashes = mix(fingerprints(data, starts, ends, BASE))
    distinct, most = _repeats(hashes, rows, n)
    pair = rows[1:] == rows[:-1] if len(rows) > 1 else np.zeros(0, bool)
    pairs, _ = _repeats((hashes[1:] * U64(31) + hashes[:-1])[pair], rows[1:][pair], n)
    lines_at = np.flatnonzero(kind == 2)
    edge = np.unique(np.concatenate((offsets[:-1], offsets[1:], lines_at + 1))) if n else np.zeros(1, np.int64)
    edge = edge[edge <= len(data)]
    line_row = np.searchsorted(offsets, edge[:-1], side="right") - 1
    lines, _ = _repeats(fingerprints(data, edge[:-1], edge[1:], BASE), line_row, n)
    n_lines = np.bincount(line_row, minlength=n).astype(float)[:n]
    last, head = (kind[ends - 1], kind[starts]) if len(starts) else (np.zeros(0), np.zeros(0))
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    ended = _per_row(last == 7, cut) / w
    return np.stack(
        [
            np.log1p(size), np.log1p(words), _per_row(length, cut) / w, np.sqrt(np.maximum(0, _per_row(length**2, cut) / w - (_per_row(length, cut) / w) ** 2)),
            space / b, np.sqrt(line / b), digit / b, upper / np.maximum(upper + lower, 1), lower / b, mark / b, np.sqrt(symbol / b), wide / b,
            distinct / w, most / w, pairs / np.maximum(words - 1, 1), lines / np.maximum(n_lines, 1),
            ended, _per_row(head == 4, cut) / w, _per_row((length == 1) & (head == 7), cut) / w,
        ],
        1,
    )


def _statistics_of(texts: pa.Array) -> np.ndarray:
    data, offsets = buffer_of(texts)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


class Model:
    """Scores of document statistics.  Small: it goes to the executors with the code."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATISTICS, FEATURES)) * WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: list[np.ndarray] = []
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), x, np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray, which: int = -1) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        # A block of rows at a time: the features take twenty times the statistics' room.
        return np.concatenate([self.features(x[a : a + 512]) @ self.weights[which] for a in range(0, len(x), 512)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def held_out(id_col: str) -> Column:
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing fit of total/weight on x."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x.tolist(), total.tolist(), weight.tolist(), strict=True):
        blocks.append([a, a, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high = blocks[-2], blocks.pop()
            blocks[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    knots = [(p, t / w) for a, b, t, w in blocks for p in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model learnt from labelled rows that are not held out."""
    good = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    good = good.where(~held_out("id"))
    n = good.count()
    # The bound holds up to chance: each row is in with probability max_rows / n by a hash of its id.
    chosen = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics_of(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    train = saved(rows.select("id", "y", "text").mapInArrow(lean(measure), "id long, y int, x array<double>"), "statistics")
    sums = train.agg(F.count("*"), *[f(F.col("x")[k]) for k in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = Model(np.array(sums[1::2], float), np.maximum(np.array(sums[2::2], float), 1e-6))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    width = FEATURES + N_STATISTICS + 1

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, width + 1))
        for batch in batches:
            z, y = model.features(np.array(batch["x"].to_pylist(), float).reshape(-1, N_STATISTICS)), batch["y"].to_numpy().astype(float)
            which = batch["half"].to_numpy()
            for k in (0, 1):
                own = z[which == k]
                total[k] += own.T @ np.concatenate((own, y[which == k, None]), 1)
        rows = [(k, b, part.tobytes()) for k in (0, 1) for b, part in enumerate(np.array_split(total[k], BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["half", "block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer()) for p in table["part"])
        return pa.table({"half": table["half"][:1].cast(pa.int32()), "block": table["block"][:1].cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    shape = "half int, block int, part binary"
    blocks = train.select("y", "x", half).mapInArrow(accumulate, shape).groupBy("half", "block").applyInArrow(add, shape).collect()
    halves = [np.concatenate([np.frombuffer(r.part) for r in sorted(blocks, key=lambda r: r.block) if r.half == k]).reshape(width, width + 1) for k in (0, 1)]
    for own in (halves[1], halves[0], halves[0] + halves[1]):  # weights 0 are for half 0 and come from half 1
        count = max(own[-1, width - 1], 1.0)
        penalty = np.full(width, RIDGE * count)
        penalty[-1] = 1e-9
        model.weights.append(np.linalg.solve(own[:, :width] + np.diag(penalty), own[:, width]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, which = np.array(batch["x"].to_pylist(), float).reshape(-1, N_STATISTICS), batch["half"].to_numpy()
            raw = np.where(which == 0, model.raw(x, 0), model.raw(x, 1))
            place = np.clip(np.round(raw * BINS / 2), -BINS, 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch["y"]], names=["bin", "y"])

    bins = train.select("y", "x", half).mapInArrow(told, "bin int, y int").groupBy("bin").agg(F.sum("y"), F.count("*")).collect()
    bins = np.array(sorted(tuple(r) for r in bins), float)
    model.knots = isotonic(bins[:, 0] * 2 / BINS, bins[:, 1], bins[:, 2])
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, score (0 to 1), predicted (1 where the score is at least 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_statistics_of(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that the classifier does not reject."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_statistics_of(batch.column(place).cast(pa.string()))) >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
