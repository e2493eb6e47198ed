"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams (3 to 6 characters) of the lower-cased text with runs of white space as one
blank, as counts over the root of their number. They are scaled by the n-gram's log-count ratio r = log(p/|p|) - log(q/|q|),
where p and q count the toxic and the other training texts that hold the n-gram; n-grams in fewer than
``MIN_DOCS`` training texts have ratio 0. A logistic regression is fitted on the scaled features.

Labelled ids are chosen first, those with the smallest hashes (``training_sample``): ``RATIO_SAMPLE`` of each class for the ratios, ``SAMPLE`` of each class
for the regression, weighted back to the sizes of the classes. N-grams are counted in the tasks that read the texts; no text is shuffled. Each task of the ratios
sends its counts packed, the regression's rows meet packed in one task, and the driver sees the table of 2**HASH_BITS ratios and weights only. Scoring
adds up one weight per n-gram where the documents lie; whole texts are scored, in blocks.

Cases: a null or empty text has no n-grams and gets the score of the intercept; a null label, a null id and repeated
labels: rows without a label are not learned from, an id labelled more than once is toxic if any label says
so; every row of a chosen id counts for the ratios, the smallest by its features for the regression; a training set with no row or with one class only gives the share of toxic rows as every score; equal texts get
equal scores; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import keep_rows, map_rows, text_rows
from ledgerlens.llm.training_sample import held_out, labelled_ids, one_row_per_id, rows_of, smallest_hashes

HASH_BITS = 18
SIZES = (3, 4, 5, 6)
MIN_DOCS = 3
#: Training ids of each class that the regression is fitted on, and those that the ratios are counted on.
SAMPLE = 2_000
RATIO_SAMPLE = 50_000
#: Parts of the table of n-grams that are added up side by side.
SLICES = 16
#: Sampled rows that are unpacked at a time while fitting.
FIT_ROWS = 64
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 18
SMOOTHING = 1.0
PENALTY = 0.01
ROUNDS = 120
RATE = 0.5
SCALE = 1.0
WIDTH = 1 << HASH_BITS


def _normal(text: str | None) -> np.ndarray:
    return np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le"), dtype=np.uint32)


def ngram_blocks(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, a block of characters at a time."""
    data = _normal(text)
    if len(data) <= 2:
        return
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + max(SIZES) - 1] + np.uint32(1)
        own = min(BLOCK, len(data) - start)
        for size in SIZES:
            n = min(own, len(part) - size + 1)
            if n <= 0:
                continue
            h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(size):
                h ^= part[k : k + n]
                h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            yield h >> np.uint32(32 - HASH_BITS)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text with their counts; a long text is counted block by block."""
    if len(text or "") < BLOCK // 4:
        blocks = list(ngram_blocks(text))
        if not blocks:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.unique(np.concatenate(blocks), return_counts=True)
    counts = np.zeros(WIDTH, dtype=np.int64)
    for block in ngram_blocks(text):
        counts += np.bincount(block, minlength=WIDTH)
    grams = np.flatnonzero(counts)
    return grams, counts[grams]


@dataclass(frozen=True)
class Model:
    """``weights`` already hold the log-count ratios."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        total = grams = 0.0
        for block in ngram_blocks(text):
            total += float(self.weights[block].sum(dtype=np.float64))
            grams += len(block)
        z = self.intercept + (total / np.sqrt(grams) * SCALE if grams else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of the ids that may be learned from; kind is 1 for toxic."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("kind"))
    return rows.where(~held_out(F.col("doc_id")))


_PACKED = "slice int, counts binary"


def _packed(table: np.ndarray) -> bytes:
    return zlib.compress(table.astype("<i4").tobytes(), 1)


def _gram_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram the texts of either kind that hold it."""
    documents = np.zeros((2, WIDTH), dtype=np.int32)
    rows = 0
    for batch in batches:
        for text, kind in text_rows(batch, ["text", "kind"]):
            seen = np.zeros(WIDTH, dtype=bool)
            for block in ngram_blocks(text):
                seen[block] = True
            documents[kind] += seen
            rows += 1
    if rows:
        parts = [_packed(part) for part in np.split(documents, SLICES, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((2, WIDTH // SLICES), dtype=np.int64)
    for packed in parts["counts"]:
        total += np.frombuffer(zlib.decompress(packed), dtype="<i4").reshape(2, -1)
    return pd.DataFrame([(key[0], total.astype("<i8").tobytes())], columns=["slice", "counts"])


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """r of every n-gram, from training rows (text, kind)."""
    documents = np.zeros((2, WIDTH), dtype=np.int64)
    for part in rows.select("text", "kind").mapInArrow(_gram_documents, _PACKED).groupBy("slice").applyInPandas(_added, _PACKED).collect():
        width = WIDTH // SLICES
        documents[:, part["slice"] * width : (part["slice"] + 1) * width] = np.frombuffer(part["counts"], dtype="<i8").reshape(2, -1)
    q, p = documents + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[documents.sum(axis=0) < MIN_DOCS] = 0.0
    return ratio


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression on rates scaled by the ratios: full gradients with a step size per weight.

    Gradients are added up over blocks of rows, so that besides the rows themselves only one block is unpacked.
    """
    n = len(rows)
    w, b = np.zeros(WIDTH), 0.0
    seen_w, seen_b = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(ROUNDS):
        g, gb = np.zeros(WIDTH), 0.0
        for start in range(0, n, FIT_ROWS):
            part = rows[start : start + FIT_ROWS]
            row = np.repeat(np.arange(len(part)), [len(grams) for grams, _ in part])
            column = np.concatenate([grams for grams, _ in part])
            value = np.concatenate([rates for _, rates in part]) * ratio[column]
            z = np.bincount(row, value * w[column], len(part)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[start : start + FIT_ROWS]) * weight[start : start + FIT_ROWS]
            g += np.bincount(column, value * error[row], WIDTH)
            gb += error.sum()
        g = (g + PENALTY * w) / n
        seen_w += g * g
        w -= RATE * g / np.sqrt(seen_w)
        seen_b += (gb / n) ** 2
        b -= RATE * gb / n / np.sqrt(seen_b)
    return Model((w * ratio).astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, ratio_sample: int = RATIO_SAMPLE) -> Model:
    present, sizes = labelled_ids(docs, known_labels(labels))
    if len(sizes) < 2:
        share = 1 - 1e-6 if 1 in sizes else 1e-6
        return Model(np.zeros(WIDTH, dtype=np.float32), float(np.log(share / (1 - share))))
    ratio = log_count_ratios(rows_of(docs, smallest_hashes(present, sizes, ratio_sample)))

    # n-grams are counted in the tasks that read the texts; a row goes on as the counts of its n-grams that have a ratio
    def features(row: tuple) -> tuple:
        grams, counts = ngram_counts(row[1])
        used = ratio[grams] != 0
        # ids as steps and counts as they are: small numbers that pack well
        steps = np.diff(grams[used].astype(np.int32), prepend=np.int32(0))
        return row[0], zlib.compress(steps.tobytes(), 1), zlib.compress(counts[used].astype(np.int32).tobytes(), 1), int(max(1, counts.sum())), row[2]

    def unpacked(packed: tuple) -> tuple[np.ndarray, np.ndarray]:
        steps, counts = (np.frombuffer(zlib.decompress(x), dtype=np.int32) for x in packed[:2])
        return np.cumsum(steps, dtype=np.int32), (counts / np.sqrt(packed[2]) * SCALE).astype(np.float32)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in text_rows(batch, ["steps", "counts", "total", "kind"])]
        y = np.array([row[3] for row in rows])
        # every class weighs as its rows do, the smaller one more by half of the way to balance
        taken = {k: max(1, int((y == k).sum())) for k in sizes}
        each = {0: sizes[0] / taken[0], 1: sizes[1] / taken[1] * (0.5 + 0.5 * sizes[0] / sizes[1])}
        weight = np.where(y == 1, each[1], each[0])
        model = fit_logistic([unpacked(row) for row in rows], y, weight / weight.mean(), ratio)
        columns = [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["weights", "intercept"])

    schema = "doc_id bigint, steps binary, counts binary, total bigint, kind int"
    rows = map_rows(rows_of(docs, smallest_hashes(present, sizes, sample)), ["doc_id", "text", "kind"], schema, features)
    # at most 2 * sample rows, in a fixed order; one task fits them, the driver sees the weights only
    drawn = one_row_per_id(rows).repartition(1).sortWithinPartitions("kind", F.xxhash64("steps", "counts"))
    fitted = drawn.mapInArrow(fit, "weights binary, intercept double").collect()[0]
    return Model(np.frombuffer(fitted["weights"], dtype=np.float32), fitted["intercept"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = map_rows(docs, ["doc_id", "text"], "doc_id bigint, score double", lambda r: (r[0], model.score(r[1])))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def passing(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, with all their columns."""
    return keep_rows(docs, ["text"], lambda r: model.score(r[0]) < 0.5)
