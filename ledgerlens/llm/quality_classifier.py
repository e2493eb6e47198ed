"""Document quality by hierarchical empirical Bayes: what the text says, and what its host and path say.

1. Evidence: a logistic regression on hashed byte trigrams and a few shares of the text, fitted on a bounded
   sample of labelled rows (``SAMPLE`` ids of each class, those with the smallest hashes, weighted back; ids are chosen first, so no text is shuffled), scores every whole text where it lies.
2. Posteriors: the documents' chances (labels where known and not held out) are summed by (host, path), by host and overall. A host is shrunk
   towards the overall mean, a path towards its host; how strongly follows from the spread between the groups
   (moments of the beta distribution), so sparse sites stay near their prior. A document never counts for itself: its own share is taken out first.
3. Score: the evidence's log-odds, moved by those of the path over those of the whole.

Sums are of whole numbers (millionths) and are made per task before any shuffle, so a host with a third of all rows
is no hot key; the table of sites is written once and joined by its known size.

Cases: null and empty texts have no trigrams and get the score of their shares and site; a null host or path is a site of its own; null labels are
not learned from, an id labelled twice has the smaller label; null ids are unlabelled; with labels of one class only, or none, the evidence is the
share of good rows. Equal rows get equal scores. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import column_or, map_rows
from ledgerlens.llm.training_sample import held_out, labelled_ids, one_row_per_id, rows_of, smallest_hashes
from ledgerlens.session import stage

BITS = 14
WIDTH = 1 << BITS
SHARES = 7
#: Labelled rows of each class that the evidence is fitted on.
SAMPLE = 2_000
BLOCK = 1 << 20
ROUNDS = 150
RATE = 0.3
PENALTY = 0.02
MILLION = 1_000_000


def features(text: str | None) -> np.ndarray:
    """Square roots of trigram shares, then shares of the text itself."""
    data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    out = np.zeros(WIDTH + SHARES)
    counts, classes = np.zeros(WIDTH, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + 2].astype(np.uint32)
        h = (part[:-2] * np.uint32(0x1F123BB5)) ^ (part[1:-1] * np.uint32(0x5F356495)) ^ (part[2:] * np.uint32(0x2C2C57ED))
        counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=WIDTH)
        classes += np.bincount(data[start : start + BLOCK], minlength=256)
    if counts.sum():
        out[:WIDTH] = np.sqrt(counts / counts.sum())
    n = max(1, len(data))
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    upper, digit, space = classes[65:91].sum(), classes[48:58].sum(), classes[[9, 10, 11, 12, 13, 32]].sum()
    mark = classes[33:127].sum() - digit - upper - classes[97:123].sum()
    out[WIDTH:] = (
        upper / n, digit / n, mark / n, space / n, len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10,
    )
    return out


def known_labels(labels: DataFrame) -> DataFrame:
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") != 0).cast("int")).alias("good"))
    return rows.where(~held_out(F.col("doc_id")))


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    present, sizes = labelled_ids(docs, known_labels(labels).withColumnRenamed("good", "kind"))
    if len(sizes) < 2:
        share = {frozenset(): 0.5, frozenset({1}): 1 - 1e-3, frozenset({0}): 1e-3}[frozenset(sizes)]
        return np.zeros(WIDTH + SHARES), float(np.log(share / (1 - share)))

    def sparse(row: tuple) -> tuple:
        x = features(row[1])
        at = np.flatnonzero(x)
        return row[0], at.astype(np.int32).tobytes(), x[at].astype(np.float32).tobytes(), row[2]

    chosen = rows_of(docs, smallest_hashes(present, sizes, sample))
    packed = map_rows(chosen, ["doc_id", "text", "kind"], "doc_id bigint, place binary, value binary, good int", sparse)
    # at most 2 * sample rows
    rows = sorted(one_row_per_id(packed).collect(), key=lambda r: (r["good"], r["place"], r["value"]))
    y = np.array([r["good"] for r in rows])
    place = [np.frombuffer(r["place"], dtype=np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in place])
    column = np.concatenate(place)
    value = np.concatenate([np.frombuffer(r["value"], dtype=np.float32) for r in rows]).astype(np.float64)
    weight = np.array([sizes[k] / max(1, int((y == k).sum())) for k in (0, 1)])[y]
    weight = weight / weight.mean()
    w, b, seen_w, seen_b = np.zeros(WIDTH + SHARES), 0.0, np.full(WIDTH + SHARES, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(row, value * w[column], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = (np.bincount(column, value * error[row], len(w)) + PENALTY * w) / len(rows)
        seen_w += g * g
        w -= RATE * g / np.sqrt(seen_w)
        gb = error.mean()
        seen_b += gb * gb
        b -= RATE * gb / np.sqrt(seen_b)
    return w, float(b)


def _strength(mean: float, rows: int, groups: int, squares: int, spread: float) -> float:
    """How many documents the prior of a level is worth: moments of a beta distribution between groups of unequal size."""
    within = mean * (1 - mean)
    room = rows - squares / rows
    between = (spread - (groups - 1) * within) / room if room > 0 else 0.0
    return round(float(np.clip(within / between - 1, 1.0, 1e6)), 3) if between > 0 else 1e6


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """``rows(host, path, chance)`` with chances in millionths to the sums of each (host, path) and its host, and (overall mean, strength of hosts, of paths)."""
    paths = stage(rows.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("chance").alias("path_sum")), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"), F.count("*").alias("n_paths")), "hosts")
    total, chance, groups, squares = hosts.agg(F.sum("host_n"), F.sum("host_sum"), F.count("*"), F.sum(F.col("host_n").cast("double") ** 2)).first()
    sites = stage(paths.join(hosts.drop("n_paths"), "host"), "sites")
    if not total:
        return sites, (0.5, 1e6, 1e6)
    mean = min(max(chance / MILLION / total, 1e-4), 1 - 1e-4)
    share = lambda level: F.col(f"{level}_sum") / F.col(f"{level}_n") / MILLION
    spread = hosts.agg(F.sum(F.col("host_n") * (share("host") - mean) ** 2)).first()[0]
    n_sites, inner_squares, inner = sites.agg(
        F.count("*"), F.sum(F.col("path_n").cast("double") ** 2 / F.col("host_n")), F.sum(F.col("path_n") * (share("path") - share("host")) ** 2)
    ).first()
    within = mean * (1 - mean)
    room = total - inner_squares
    between = (inner - (n_sites - groups) * within) / room if room > 0 else 0.0
    of_paths = round(float(np.clip(within / between - 1, 1.0, 1e6)), 3) if between > 0 else 1e6
    return sites, (mean, _strength(mean, total, groups, squares, spread), of_paths)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, evidence, site_posterior, score, kept (score of at least 0.5) for every row."""
    nothing = F.lit(None).cast("string")
    shaped = docs.select(
        "doc_id", "text", *[F.coalesce(F.concat(F.lit("="), column_or(docs, c, nothing).cast("string")), F.lit("")).alias(a) for c, a in ((host, "host"), (path, "path"))]
    )
    w, b = fit_evidence(docs, labels, sample)
    schema = "doc_id bigint, host string, path string, z double"
    scored = map_rows(shaped, ["doc_id", "host", "path", "text"], schema, lambda r: (*r[:3], float(features(r[3]) @ w + b)))
    z = F.greatest(F.least(F.round("z", 9), F.lit(30.0)), F.lit(-30.0))
    known = known_labels(labels)
    chance = F.coalesce(F.col("good") * MILLION, F.round(MILLION / (1 + F.exp(-z)))).cast("bigint")
    rows = stage(scored.join(known, "doc_id", "left").select("doc_id", "host", "path", z.alias("z"), chance.alias("chance")), "evidence")
    sites, (mean, of_hosts, of_paths) = site_posteriors(rows)
    own = F.col("chance")
    others = lambda level: (F.col(f"{level}_sum") - own) / MILLION
    host_mean = (others("host") + of_hosts * mean) / (F.col("host_n") - 1 + of_hosts)
    path_mean = (others("path") + of_paths * host_mean) / (F.col("path_n") - 1 + of_paths)
    site = F.greatest(F.least(path_mean, F.lit(1 - 1e-4)), F.lit(1e-4))
    moved = F.col("z") + F.log(site / (1 - site)) - float(np.log(mean / (1 - mean)))
    return (
        rows.join(sites, ["host", "path"])
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-F.col("z")))).alias("evidence"), site.alias("site_posterior"), (1 / (1 + F.exp(-moved))).alias("score"))
        .withColumn("kept", F.col("score") >= 0.5)
    )
