"""Quality rules on whole texts: counts with fixed limits, and the divergence from the language.

Two histograms of a document are held against the references of its own language, which come from all documents
of that language in the table: the shares of character classes, and the shares of the language's most common words (all
other words are one more share). The distance is the Jensen-Shannon distance (root of the divergence in
bits, 0 to 1). A document fails when a distance is above its limit; each histogram counts only for
documents long enough to fill it (minimum-length guards). A document whose language is unknown, or has too few words
for a reference, has nothing to diverge from: its distances are null and the base rule alone decides.

References are grouped sums: every task adds up words and characters per language before anything is
shuffled. They form a table of one row per language, which grows with the languages and is joined to the
documents; while it is small Spark broadcasts it, and documents are judged where they lie.

Cases: a null text counts as no words; empty texts and texts of white space fail the base rule; a null or rare language
has no distances; equal rows get equal results and all count in the references; an empty table gives an empty
result; further columns are not read. Word and character tables of very long texts are as large as the text.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.frames import column_or, fresh_name, has_column, keep_rows, map_rows, text_rows
from ledgerlens.session import stage

#: Common words of a language.
COMMON_WORDS = 64
#: Words that a language needs for a reference.
LEAST_WORDS = 2_000
#: Parsed references that a task keeps at a time.
PARSED = 64
#: Entries of a task's table of words before it is handed on.
TABLE_ENTRIES = 200_000
#: Base limits of the contract.
BASE_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3


@dataclass(frozen=True)
class Limits:
    """Largest distances, and the least characters and words for a histogram to count."""

    chars: float = 0.30
    words: float = 0.40
    least_chars: int = 200
    least_words: int = 100


# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other", "letter")


def _class_table() -> np.ndarray:
    """The class of each UTF-8 byte; bytes after the first of a character get none (8)."""
    out = np.full(256, 6, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        if b in SPACES:
            out[b] = 3
        elif b in SYMBOLS:
            out[b] = 5
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c.isprintable():
            out[b] = 4
    out[128:192] = 8
    out[192:] = 7
    return out


_TABLE = _class_table().tobytes()


def char_classes(data: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(np.frombuffer(data.translate(_TABLE), dtype=np.uint8), minlength=9)[:8]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    size = len(number)
    pair = ids[:-1] * size + ids[1:]
    if size >= 2_000_000:  # three factors would pass 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * size + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(key, twice)
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(WINDOW):
        covered[shift : shift + n] |= found
    return int(covered.sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a UTF-8 text."""
    words = data.split()  # of bytes: at ASCII white space only
    classes = char_classes(data)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    n, repeats = len(words), repeated_words(words)
    failed = n < BASE_WORDS or 100 * repeats > REPEAT_PERCENT * n
    return n, int(classes.sum() - classes[3]), int(classes[5]), len(lines) - len(set(lines)), repeats, failed


# -- references ---------------------------------------------------------------------------------


@dataclass
class Reference:
    chars: np.ndarray
    words: list[bytes]
    shares: np.ndarray
    rank: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.rank = {w: i for i, w in enumerate(self.words)}


_SUMS = "lang string, class int, word binary, n bigint"


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (class -1), and characters by class, added up per language in the task."""
    tables: dict[str | None, Counter] = {}
    entries = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            items = list(table.items())
            for start in range(0, len(items), 50_000):
                part = items[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([k if isinstance(k, int) else -1 for k, _ in part], pa.int32()),
                        pa.array([b"" if isinstance(k, int) else k for k, _ in part], pa.binary()),
                        pa.array([n for _, n in part], pa.int64()),
                    ],
                    names=["lang", "class", "word", "n"],
                )
        tables.clear()

    for batch in batches:
        for lang, text in text_rows(batch, ["lang", "text"]):
            data = (text or "").encode("utf-8").lower()
            table = tables.setdefault(lang, Counter())
            before = len(table)
            table.update(data.split())
            for c, n in enumerate(char_classes((text or "").encode("utf-8")).tolist()):
                if n:
                    table[c] += n
            entries += len(table) - before
            if entries > TABLE_ENTRIES:
                yield from emit()
                entries = 0
    yield from emit()


def languages(docs: DataFrame) -> Column:
    return column_or(docs, "lang", F.lit(None).cast("string")).cast("string")


def reference_table(docs: DataFrame) -> DataFrame:
    """(_of_lang, _reference): one row per language of at least LEAST_WORDS words; the reference as JSON."""
    texts = docs.select(languages(docs).alias("lang"), F.col("text")).where("lang IS NOT NULL")
    sums = stage(texts.mapInArrow(_sums, _SUMS).groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "words")
    is_class = F.col("class") >= 0
    sizes = sums.where(~is_class).groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_WORDS)
    # one language may hold most words: the best of each task are chosen before they meet
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("word"))
    common = sums.where(~is_class).withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON_WORDS).drop("r")
    # words are cut at ASCII white space only, so their bytes are text
    entry = F.struct(F.col("class"), F.col("word").cast("string").alias("word"), "n")
    rows = sums.where(is_class).unionByName(common).groupBy("lang").agg(F.collect_list(entry).alias("entries"))
    joined = rows.join(sizes, "lang").select(F.col("lang").alias("_of_lang"), F.to_json(F.struct("total", "entries")).alias("_reference"))
    return stage(joined, "references")


def parsed(reference: str) -> Reference:
    """A reference from its JSON: words by falling count, then by bytes."""
    held = json.loads(reference)
    chars = np.zeros(len(CLASSES))
    found = []
    for r in held["entries"]:
        if r["class"] >= 0:
            chars[r["class"]] = r["n"]
        else:
            found.append((-r["n"], r["word"].encode("utf-8")))
    found.sort()
    total = held["total"]
    counts = np.array([-n for n, _ in found] + [total + sum(n for n, _ in found)], dtype=float)
    return Reference(chars / max(1, chars.sum()), [w for _, w in found], counts / max(1, total))


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """The table of references on the driver, by language: for looking at a few languages."""
    return {r["_of_lang"]: parsed(r["_reference"]) for r in reference_table(docs).collect()}


def with_reference(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with the reference of their language in a last column, null where there is none; and that column's name."""
    lang, name = fresh_name(docs, "_of_lang"), fresh_name(docs, "_reference")
    known = reference_table(docs).toDF(lang, name)
    return docs.join(known, languages(docs) == known[lang], "left").drop(lang), name


# -- distances ----------------------------------------------------------------------------------


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of shares, base 2."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> float:
        held = x > 0
        return float((x[held] * np.log2(x[held] / m[held])).sum())

    return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))


def distances(data: bytes, reference: Reference, limits: Limits) -> tuple[float | None, float | None]:
    """Distance of characters and of words; None below the guard."""
    chars = char_classes(data)
    total = int(chars.sum())
    by_chars = js_distance(chars / total, reference.chars) if total >= max(1, limits.least_chars) else None
    words = data.lower().split()
    if len(words) < max(1, limits.least_words):
        return by_chars, None
    counts = np.zeros(len(reference.words) + 1)
    rank, last = reference.rank, len(reference.words)
    for word, n in Counter(words).items():
        counts[rank.get(word, last)] += n
    return by_chars, js_distance(counts / len(words), reference.shares)


OUTPUT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def judged(text: str | None, lang: str | None, known: dict[str | None, Reference], limits: Limits) -> tuple:
    """Base counts, verdict and both distances of one text."""
    data = (text or "").encode("utf-8")
    counts = base_counts(data)
    reference = known.get(lang)
    by_chars, by_words = (None, None) if reference is None else distances(data, reference, limits)
    far = (by_chars or 0) > limits.chars or (by_words or 0) > limits.words
    return *counts, not counts[-1] and not far, by_chars, by_words


def _judge_of(limits: Limits) -> Callable[[str | None, str | None], tuple]:
    """``judged`` by text and reference; a task parses the reference of a language once."""
    known: dict[str | None, Reference] = {}

    def run(text: str | None, reference: str | None) -> tuple:
        if reference is not None and reference not in known:
            if len(known) >= PARSED:
                known.clear()
            known[reference] = parsed(reference)
        return judged(text, reference, known, limits)

    return run


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with the base counts, both distances and the verdict."""
    shaped, name = with_reference(docs.select("doc_id", "text", languages(docs).alias("lang")))
    verdict = _judge_of(limits)
    return map_rows(shaped, ["doc_id", "text", name], OUTPUT, lambda r: (r[0], *verdict(r[1], r[2])))


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    verdict = _judge_of(limits)
    shaped, name = with_reference(docs)
    return keep_rows(shaped, ["text", name], lambda r: verdict(*r)[-3]).drop(name)
