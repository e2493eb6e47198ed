"""Plain Python statements of the metrics, for small cases."""

from __future__ import annotations

import itertools
from collections import Counter

from ledgerlens.operators import rows as R


def long_rows(cases):
    """cases: id -> (prediction rows, [expected rows, …])."""
    out = []
    for query, (pred, golds) in cases.items():
        out += [(query, "p", 0, i, *row) for i, row in enumerate(pred)]
        for v, gold in enumerate(golds):
            out += [(query, "g", v, i, *row) for i, row in enumerate(gold)]
    return out


def results(spark, cases, types):
    """Result rows and the list of pairs for cases of one width."""
    names = [f"c{i}" for i in range(len(types))]
    schema = "query_id string, side string, variant int, row_idx bigint, " + ", ".join(f"{n} {t}" for n, t in zip(names, types))
    rows = R.norm_cells(spark.createDataFrame(long_rows(cases), schema), names)
    tables = [(q, "p", 0) for q in cases] + [(q, "g", v) for q, (_, golds) in cases.items() for v in range(len(golds))]
    runs = spark.createDataFrame(tables, "query_id string, side string, variant int")
    return rows, R.pair_list(rows, runs)


def overlap(p, g):
    return sum((Counter(p) & Counter(g)).values())


def best_free(p, g):
    if len(p) > len(g):
        p, g = g, p
    return max((sum(overlap(a, b) for a, b in zip(p, order)) for order in itertools.permutations(g, len(p))), default=0)


def best_ordered(p, g):
    line = [0] * (len(g) + 1)
    for a in p:
        new = [0]
        for j, b in enumerate(g):
            new.append(max(line[j + 1], new[j], line[j] + overlap(a, b)))
        line = new
    return line[-1]


def soft(p, g, beta):
    if not p and not g:
        return 1.0
    hit = p_only = g_only = 0.0
    for i in range(max(len(p), len(g))):
        if i >= len(p):
            g_only += 1
        elif i >= len(g):
            p_only += 1
        else:
            a, b = p[i], g[i]
            hit += sum(x in b for x in a) / len(b)
            p_only += sum(x not in b for x in a) / len(b)
            g_only += sum(x not in a for x in b) / len(b)
    precision = hit / (hit + p_only) if hit + p_only else 0
    recall = hit / (hit + g_only) if hit + g_only else 0
    square = beta * beta
    return (1 + square) * precision * recall / (square * precision + recall) if precision + recall else 0


def sorted_row(row):
    return tuple(sorted(row, key=lambda x: (str(type(x)), str(x))))


def expected(p, g):
    """exo, exu, sfo, bfo, bfu for tables of one width."""
    size, width = max(len(p), len(g)), len((p + g)[0]) if p + g else 1
    same = Counter(map(sorted_row, p)) == Counter(map(sorted_row, g))
    if size == 0:
        return (1.0,) * 5
    return (
        float(p == g),
        float(same),
        soft(p, g, 1.0),
        best_ordered(p, g) / width / size,
        best_free(p, g) / width / size,
    )
