"""Secrets against plain regular expressions, and the cases of the docstring."""

import hashlib
import random
import re

from ledgerlens.llm import secret_scan as S
from tests.conftest import DATA

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def brute(text):
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def line(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def compare(spark, docs):
    rows = docs.collect()
    got = S.secret_digest(docs).collect()
    assert len(got) == len(rows)
    want = sorted(
        (
            (r["doc_id"] is not None, r["doc_id"] or 0, *[sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")],
             hashlib.sha256(line(spans).encode()).hexdigest())
            for r in rows
            for spans in [brute(r["text"])]
        )
    )
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got)
    assert found == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_whole_table(spark):
    compare(spark, spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_random_texts(spark):
    """Pieces of the rules in any order, with letters of several bytes between them."""
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "==", "abc", "deadbeef", "0123456789abcdef",
             "AKIA", "ABCDEFGHIJKLMNOP", "Z9", "é", "漢", "\n", "-", "/", "+", "K", "ſ", "tokentoken="]
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))) for i in range(3000)]
    compare(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_cases(spark):
    long = "x " * 200_000 + "secret = abcdef" + " y" * 200_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "token: abcdef", "c"), (3, "token: abcdef", "c"), (None, "token: abcdef", None), (5, long, "d"), (6, "a" * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    compare(spark, docs)
    assert S.secret_digest(docs.limit(0)).count() == 0
    assert S.scan_secrets(docs).where("doc_id = 3").count() == 2
