"""Personal data: base spans against plain regular expressions, the field on repeated tokens, the cases of the docstring."""

import hashlib
import random
import re

from ledgerlens.llm import pii as P
from tests.conftest import DATA

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ORDER = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * 2, 10)) if i % 2 else int(c)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER.index(s[0])))


def line(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def compare(spark, docs):
    rows = docs.collect()
    got = P.pii_digest(docs).collect()
    want = sorted(
        (r["doc_id"] or -1, *[sum(s[0] == k for s in spans) for k in ORDER], hashlib.sha256(line(spans).encode()).hexdigest())
        for r in rows
        for spans in [brute(r["text"] or "")]
    )
    assert sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    return got


def test_whole_table(spark):
    compare(spark, spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_random_texts(spark):
    parts = ["a", "b.c", "@", "@x.org", "@x", ".", "..", "-", "+", "+4", " ", "(", ")", "1", "12", "255", "256", "0", "007", "4111 1111 1111 1111", "é", "漢", "\n", "٣", "%"]
    draw = random.Random(9)
    rows = [(i + 1, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(3000)]
    compare(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "mail me@x.org", "c"), (3, "mail me@x.org", "c"), (None, "mail me@x.org", None), (6, "word " * 100_000 + "1 " * 1_000 + "me@x.org", "d"), (7, "@" * 2_000 + "1." * 2_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = compare(spark, docs)
    assert len({r["spans"] for r in got if r["doc_id"] in (3, None)}) == 1
    assert P.pii_digest(docs.limit(0)).count() == 0
    clean = P.redacted(docs)
    assert clean.columns == docs.columns
    assert [r["text"] for r in clean.where("doc_id = 3").collect()] == ["mail [EMAIL]"] * 2
    assert clean.where("doc_id = 1").first()["text"] is None


def test_skip_links_join_repeats():
    nodes = P.tokens("call 555-0100200 now, or 5550100200 later; 555-0100200")
    assert P.skip_links(nodes) == [(0, 1), (0, 2), (1, 2)]


def test_repeats_agree(spark):
    """Messages over skip links: one sure occurrence carries its label to a doubtful one."""
    import numpy as np

    nodes = P.tokens("ref 5550100200 and far away 5550100200")
    own = np.zeros((P.FEATURES, len(P.LABELS)), dtype=np.float32)
    field = P.Field(own, np.zeros((5, 5)), 3.0)
    only_first = set(nodes[0].features) - set(nodes[1].features)
    own[sorted(only_first), P.LABELS.index("phone")] = 3.0
    linked = field.beliefs(nodes, P.skip_links(nodes))
    apart = field.beliefs(nodes, [])
    assert linked[1].argmax() == P.LABELS.index("phone") and linked[1].max() > apart[1].max() + 0.3


def test_evidence_reaches_every_repeat():
    """A base span of one occurrence labels the hundredth one."""
    import numpy as np

    nodes = P.tokens("5550100200 " + "and 5550100200 " * 99)
    field = P.Field(np.zeros((P.FEATURES, len(P.LABELS)), dtype=np.float32), np.zeros((5, 5)), 4.0)
    fixed = np.zeros(len(nodes), dtype=np.int64)
    fixed[0] = P.LABELS.index("phone")
    held = field.beliefs(nodes, P.hub_links(len(nodes), P.repeats(nodes)), fixed)
    assert held[:, P.LABELS.index("phone")].min() > 0.85


def test_beliefs_are_the_marginals_of_a_tree():
    """Without loops, belief propagation equals the sum over all labellings."""
    import itertools

    import numpy as np

    rnd = np.random.default_rng(4)
    nodes = P.tokens("a1 b2 x y c3 and a1 then a1")
    k = len(P.LABELS)
    field = P.Field(rnd.normal(size=(P.FEATURES, k)).astype(np.float32) / 4, rnd.normal(size=(k, k)) / 2, 1.3)
    links = P.hub_links(len(nodes), P.repeats(nodes))
    assert links == [(0, 5), (3, 5), (4, 5)] and sum(n.follows for n in nodes) == 1
    own = field.own[np.array([n.features for n in nodes])].sum(axis=1)
    weight = np.zeros((len(nodes), k))
    for labels in itertools.product(range(k), repeat=len(nodes) + 1):
        z = sum(own[i, labels[i]] for i in range(len(nodes))) + sum(field.skip * (labels[a] == labels[b]) for a, b in links)
        z += sum(field.chain[labels[i - 1], labels[i]] for i in range(1, len(nodes)) if nodes[i].follows)
        for i in range(len(nodes)):
            weight[i, labels[i]] += np.exp(z)
    assert np.allclose(field.beliefs(nodes, links), weight / weight.sum(axis=1, keepdims=True), atol=5e-3)


def test_a_hundred_thousand_numbers(spark):
    rows = [(1, "".join(f"{i % 977} " for i in range(100_000)) + "me@x.org"), (2, "call +49 30 1234567 or me@x.org")]
    got = compare(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert len(got) == 2
