"""Secrets in texts, found by one combined automaton.

All rules are one minimal automaton (see ``automaton``): a text is read once, byte by byte, whatever
the number of rules. Each document is scanned where it lies; nothing is shuffled.

Cases: a null text counts as empty, an empty text has no spans, equal rows give equal results, an
empty table gives an empty result, further columns of the table are not read. Scan time and memory
grow with the length of a text only, so very long texts need no special way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import automaton as A
from ledgerlens.llm.frames import Span, code_points, map_rows, sha256, span_text


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds, ``least`` is the shortest length kept: of the value after ``head``, or of the match without a head."""

    name: str
    pattern: str
    least: int
    ignore_case: bool = False
    head: str | None = None


_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

# The base rules, whose results are part of the contract. The first eight hexadecimal digits are written out, so that
# the scan does not stop for every short run; a run and a check of its length give the same spans.
BASE_RULES = (
    SecretRule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 6, True, _HEAD),
    SecretRule("access", "AKIA[A-Z0-9]+", 20),
    SecretRule("hex", "[0-9a-f]{8,}", 24),
)

# Public formats of further credentials.
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", 16),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    SecretRule("pem", "-----BEGIN( [A-Z]+)* PRIVATE KEY-----", 27),
)

RULES = BASE_RULES + MORE_RULES
OUTPUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_more bigint"


class SecretScanner:
    """Rules compiled for a worker."""

    def __init__(self, rules: tuple[SecretRule, ...]) -> None:
        self.rules = rules
        self.scanner = A.Scanner(A.compile_rules({r.name: (r.pattern, r.ignore_case) for r in rules}))
        self.heads = [A.walker(r.head, r.ignore_case) if r.head else None for r in rules]

    def spans(self, text: str) -> list[Span]:
        """(rule, start, end) in code points."""
        data = text.encode("utf-8")
        kept = []
        for i, start, end in self.scanner.scan(data):
            head = self.heads[i]
            value = head.longest(data, start, end, 1) if head else start
            if end - value >= self.rules[i].least:
                kept.append((self.rules[i].name, start, end))
        if not kept or len(data) == len(text):
            return kept
        place = code_points(data, [x for _, s, e in kept for x in (s, e)])
        return [(name, place[s], place[e]) for name, s, e in kept]


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> SecretScanner:
    """Compiled once in each worker; the rules are bounded, not the texts."""
    return SecretScanner(rules)


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per secret: id, kind, start, end (code points, end exclusive)."""

    def found(row: tuple) -> tuple:
        doc, text = row
        return doc, scanner(rules).spans(text or "")

    schema = "id bigint, found array<struct<kind:string,start:bigint,end:bigint>>"
    rows = map_rows(docs, [id_column, text_column], schema, lambda r: (lambda d, f: (d, [dict(zip(("kind", "start", "end"), x)) for x in f]))(*found(r)))
    return rows.select(F.col("id").alias(id_column), F.explode("found").alias("s")).select(id_column, "s.*")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans."""
    kinds = tuple(r.name for r in RULES)
    base = {r.name for r in BASE_RULES}

    def digest(row: tuple) -> tuple:
        doc, text = row
        spans = scanner().spans(text or "")
        known = [s for s in spans if s[0] in base]
        count = [sum(s[0] == k for s in known) for k in ("assign", "access", "hex")]
        return (doc, *count, sha256(span_text(known, kinds)), span_text(spans, kinds), len(spans) - len(known))

    return map_rows(docs, ["doc_id", "text"], OUTPUT, digest)
