"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to repeated tokens.

The base spans come from four patterns. The field adds spans: its nodes are the tokens with a digit or an
at sign, its labels the four kinds or none. A node's own potential is a softmax over features of the token and its
neighbours; neighbouring tokens share a transition potential; and tokens that recur anywhere in the
document (equal, or with equal digits) share a potential for equal labels. All occurrences of a token hang on one hub, so that a
token repeated n times has n links and evidence reaches every repeat in two steps. Tokens of base spans are evidence: their labels are
fixed. Loopy belief propagation passes messages over both kinds of links until they settle (``PASSES`` rounds at most, as a loopy graph may never do so);
a token that no base span covers becomes a span where the belief in a kind is high.

The field is trained on the base spans of a bounded sample: ``TRAIN_DOCS`` documents with such tokens and at most ``TRAIN_CHARS`` characters, those with the smallest
hashes; its weights are of fixed size and go to the tasks. Each document, of any length, is labelled where it lies; nothing is shuffled.

Cases: a null text counts as empty and has no spans; equal texts get equal spans; with no tokens to train on nothing
is added; an empty table gives an empty result; further columns are not read. All patterns take time in
proportion to the text, also on long runs of digits or blanks.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import Span, map_rows, sha256, span_text
from ledgerlens.llm.training_sample import share_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

#: Documents that the field is trained on, and characters of the longest of them.
TRAIN_DOCS = 4_000
TRAIN_CHARS = 20_000
FEATURES = 1 << 13
ROUNDS = 120
RATE = 0.5
PENALTY = 0.02
PASSES = 200
CLAMP = 30.0
DAMPING = 0.3
BELIEF = 0.9

# The base patterns. Runs are possessive, which finds the same spans without going back over them.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping spans of each kind."""
    found: list[Span] = []
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            floor = m.end()
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.groups())):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


# -- the field ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    features: tuple[int, ...]
    follows: bool  # only white space lies between it and the node before


def _shape(word: str) -> str:
    """Digits as 9, letters as a, runs with their length up to 6."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word[:64], re.S):
        part = m[0]
        kind = "9" if part[0].isdigit() else "a" if part[0].isalpha() else part
        out.append(f"{kind}{min(len(part), 6)}" if kind == "9" else kind)
    return "".join(out[:12])


def _feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


_EDGE = "\"',;:!?*#$%&|<>[]{}."
_GAP = re.compile(r"[\x20\x09-\x0D]*")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\Z")
_AFTER = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")


def tokens(text: str) -> list[Token]:
    """Tokens with a digit or an at sign, without marks around them."""
    out: list[Token] = []
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    for start, end in found:
        raw = text[start:end]
        left = len(raw) - len(raw.lstrip(_EDGE))
        core = raw.strip(_EDGE)
        if not core:
            continue
        before = _BEFORE.search(text[max(0, start - 24) : start])
        after = _AFTER.match(text, end, min(len(text), end + 40))
        shape = _shape(core)
        prior = _shape(before[0].strip().strip(_EDGE)) if before else "^"
        then = _shape(after[1].strip(_EDGE)) if after else "$"
        digits = sum(c.isdigit() for c in core)
        names = (
            "bias", f"s={shape}", f"p={prior}", f"n={then}", f"s={shape} p={prior}", f"s={shape} n={then}", f"d={min(digits, 20)}",
            f"@={core.count('@')}", f".={min(core.count('.'), 5)}", f"+={core[:1] == '+'}", f"(={core[:1] == '('}", f"l={min(len(core), 24)}",
        )
        at = start + left
        follows = bool(out) and _GAP.fullmatch(text, out[-1].end, at) is not None
        out.append(Token(at, at + len(core), core, tuple(_feature(n) for n in names), follows))
    return out


def skip_links(nodes: list[Token]) -> list[tuple[int, int]]:
    """Each node with the next one that is equal in lower case, and with the next one of the same seven or more digits."""
    links = set()
    last: dict[str, int] = {}
    for i, node in enumerate(nodes):
        digits = "".join(c for c in node.text if "0" <= c <= "9")
        for key in {f"t{node.text.lower()}", f"d{digits}" if len(digits) >= 7 else f"t{node.text.lower()}"}:
            if key in last:
                links.add((last[key], i))
            last[key] = i
    return sorted(links)


def repeats(nodes: list[Token]) -> list[list[int]]:
    """The nodes that are equal in lower case, and those of the same seven or more digits; two or more each."""
    groups: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        digits = "".join(c for c in node.text if "0" <= c <= "9")
        groups.setdefault(f"d{digits}" if len(digits) >= 7 else f"t{node.text.lower()}", []).append(i)
        if len(digits) >= 7:
            groups.setdefault(f"t{node.text.lower()}", []).append(i)
    found = {tuple(g) for g in groups.values() if len(g) > 1}
    return [list(g) for g in sorted(found)]


def hub_links(n: int, groups: list[list[int]]) -> list[tuple[int, int]]:
    """Links of each node with the hub of its group; hubs are numbered from n on. Two nodes need no hub."""
    links = []
    for group in groups:
        if len(group) == 2:
            links.append((group[0], group[1]))
        else:
            links += [(i, n) for i in group]
            n += 1
    return links


def token_labels(nodes: list[Token], spans: list[Span]) -> np.ndarray:
    """The kind of the base span that a token lies in, or 0; the first kind listed wins."""
    out = np.zeros(len(nodes), dtype=np.int64)
    starts = np.array([n.start for n in nodes])
    ends = np.array([n.end for n in nodes])
    for kind, start, end in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(starts, end, side="left")
        out[low:high] = LABELS.index(kind)
    return out


@dataclass(frozen=True)
class Field:
    """``own``: features x labels; ``chain``: labels x labels, log potentials; ``skip``: bonus of equal labels."""

    own: np.ndarray
    chain: np.ndarray
    skip: float

    def beliefs(self, nodes: list[Token], links: list[tuple[int, int]], fixed: np.ndarray | None = None) -> np.ndarray:
        """Marginals of the labels by loopy belief propagation. Links may name hubs, numbered after the nodes; ``fixed`` holds known labels, 0 for none."""
        own = self.own[np.array([n.features for n in nodes])].sum(axis=1)
        if fixed is not None:
            known = np.flatnonzero(fixed)
            own[known] = -CLAMP
            own[known, fixed[known]] = CLAMP
        hubs = max([len(nodes) - 1, *(b for _, b in links)]) + 1 - len(nodes)
        own = np.concatenate([own, np.zeros((hubs, len(LABELS)))]).astype(np.float64)
        follow = [(i - 1, i) for i, n in enumerate(nodes) if n.follows]
        if not follow and not links:
            return _softmax(own[: len(nodes)])
        edges = np.array(follow + links, dtype=np.int64)
        same = np.eye(len(LABELS)) * self.skip
        potential = np.concatenate([np.repeat(self.chain[None], len(follow), 0), np.repeat(same[None], len(links), 0)])
        a, b = edges[:, 0], edges[:, 1]
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        turned = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(PASSES):
            total = own.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[turned])[:, :, None] + potential
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0, :]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if moved < 1e-3:
                break
        total = own.copy()
        np.add.at(total, target, message)
        return _softmax(total[: len(nodes)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_field(samples: list[tuple[list[list[int]], list[int], list[bool], list[tuple[int, int]]]]) -> Field | None:
    """Piecewise training: token features, labels, which tokens follow the one before, skip links, for each document."""
    features = np.array([f for s in samples for f in s[0]], dtype=np.int64)
    if not len(features):
        return None
    y = np.array([label for s in samples for label in s[1]])
    n, k = len(y), len(LABELS)
    target = np.eye(k)[y]
    w, seen = np.zeros((FEATURES, k)), np.full((FEATURES, k), 1e-8)
    flat = features.reshape(-1)
    for _ in range(ROUNDS):
        error = _softmax(w[features].sum(axis=1)) - target
        spread = np.repeat(error, features.shape[1], axis=0)
        g = np.stack([np.bincount(flat, spread[:, c], FEATURES) for c in range(k)], axis=1)
        g = (g + PENALTY * w) / n
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    pairs, equal, other = np.ones((k, k)), 1.0, 1.0
    for _, labels, follows, links in samples:
        for i in range(1, len(labels)):
            if follows[i]:
                pairs[labels[i - 1], labels[i]] += 1
        for a, b in links:
            if labels[a] or labels[b]:
                equal, other = equal + (labels[a] == labels[b]), other + (labels[a] != labels[b])
    share = pairs / pairs.sum()
    chain = np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))
    return Field(w.astype(np.float32), np.clip(chain, -3, 3), float(np.clip(np.log(equal / other), 0.5, 4)))


def _example(row: tuple) -> tuple:
    text = row[0] or ""
    nodes = tokens(text)
    labels = token_labels(nodes, base_spans(text))
    return [list(n.features) for n in nodes], labels.tolist(), [n.follows for n in nodes], [list(x) for x in skip_links(nodes)]


def train_field(docs: DataFrame, sample: int = TRAIN_DOCS) -> Field | None:
    fit = docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS))
    # texts that cannot be among the smallest hashes are left out before any are sorted
    size = fit.count()
    share = share_of(F.col("text"))
    chosen = fit.where(share < min(1.0, (1.2 * sample + 200) / max(1, size))).orderBy(share, "text").limit(sample)
    schema = "features array<array<int>>, labels array<int>, follows array<boolean>, links array<array<int>>"
    rows = map_rows(chosen, ["text"], schema, _example).collect()
    return fit_field([(r["features"], r["labels"], r["follows"], [tuple(x) for x in r["links"]]) for r in rows])


def added_spans(text: str, known: list[Span], field: Field | None) -> list[Span]:
    """Runs of tokens outside all base spans that the field gives one kind."""
    if field is None:
        return []
    nodes = tokens(text)
    if not nodes:
        return []
    labels = token_labels(nodes, known)
    beliefs = field.beliefs(nodes, hub_links(len(nodes), repeats(nodes)), labels)
    best = beliefs.argmax(axis=1)
    sure = (beliefs.max(axis=1) >= BELIEF) & (best > 0) & (labels == 0)
    out: list[Span] = []
    previous = -2
    for i in np.flatnonzero(sure).tolist():
        kind = LABELS[best[i]]
        if previous == i - 1 and nodes[i].follows and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], nodes[i].end)
        else:
            out.append((kind, nodes[i].start, nodes[i].end))
        previous = i
    return out


def find(text: str | None, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans."""
    known = base_spans(text or "")
    return known, added_spans(text or "", known, field)


OUTPUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def pii_digest(docs: DataFrame) -> DataFrame:
    field = train_field(docs)

    def digest(row: tuple) -> tuple:
        known, added = find(row[1], field)
        counts = [sum(s[0] == k for s in known) for k in KINDS]
        return (row[0], *counts, sha256(span_text(known, KINDS)), span_text(known + added, KINDS), len(added))

    return map_rows(docs, ["doc_id", "text"], OUTPUT, digest)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at, reach = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if start >= reach:
            out += [text[at:start], f"[{kind.upper()}]"]
            reach = end
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The same documents with personal data replaced; n_chars follows the text where it is given. A null text stays null."""
    field = train_field(docs)
    schema = docs.schema
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(row: tuple) -> tuple:
        text = row[place]
        if text is None:
            return row
        known, added = find(text, field)
        if not known and not added:
            return row
        out = list(row)
        out[place] = redact(text, known + added)
        if length is not None:
            out[length] = len(out[place])
        return tuple(out)

    return map_rows(docs, docs.columns, schema, clean)
