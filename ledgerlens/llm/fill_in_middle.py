"""Fill-in-middle examples: a text is cut at two places and its parts are put in another order.

The places where a text may be cut, the starts of its code points, form a boundary set (``boundary_set``); a cut after k
units is the member of rank k, found by container search and local select. Both cuts, the form and the share of
texts left plain follow from a hash of the document's id, so every run, retry and partitioning gives the same
examples. Rows are cut where they lie: nothing is shuffled.

Forms: ``plain`` is the text; ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle, each part after its mark. A text that
contains a mark stays plain, so the text can always be rebuilt from output and form.

Cases: a null or empty text has n = 0, form plain and an empty output; a null id is hashed as the empty id (``1:``); equal rows give
equal outputs, equal ids equal draws; texts of any length are cut whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.boundary_set import character_boundaries
from ledgerlens.llm.frames import map_rows

# The marks before prefix, suffix and middle; forms by share of a hundred.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90
SPM_BELOW = 20


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id: int | None, text: bytes | None) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, code points of the prefix, of the middle, output)."""
    text = text or b""
    h1, h2, h3, h4 = draws(doc_id)
    boundaries = character_boundaries(text)
    n = len(boundaries) - 1
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = boundaries.select(first), boundaries.select(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", first, last - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", first, last - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (string) for every row."""
    raw = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    return map_rows(raw, ["doc_id", "text"], schema, lambda row: (row[0], *transform(*row))).withColumn("output", F.col("output").cast("string"))


def restored(examples: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text, rebuilt from output and form alone, as column ``restored``.

    No part holds a mark, and no mark can begin inside a part and end in the mark after it, so the marks found are the marks set.
    """
    body = F.col("output")
    psm = F.col("form") == "psm"
    one, two = PREFIX.decode(), SUFFIX.decode()
    middle = F.substring_index(body, MIDDLE.decode(), -1)
    head = F.expr(f"substring(output, {len(PREFIX) + 1}, instr(output, '{MIDDLE.decode()}') - {len(PREFIX) + 1})")
    left, right = (lambda mark: F.substring_index(head, mark, 1)), (lambda mark: F.substring_index(head, mark, -1))
    text = (
        F.when(F.col("form") == "plain", body)
        .when(psm, F.concat(left(two), middle, right(two)))
        .otherwise(F.concat(right(one), middle, left(one)))
    )
    return examples.withColumn("restored", text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    return restored(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
