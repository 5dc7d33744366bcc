"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Method
    Fixed patterns find e-mail addresses, IP addresses, card and phone numbers; these base spans always stay.
    Wider patterns find candidates: long mixed strings, numbers that fail a base check, phone numbers without a plus,
    addresses that spell out their signs. Labelers of three sorts vote for or against each candidate or abstain:
    patterns (its exact form), gazetteers (names of secrets, of mail domains, of card issuers in the text or beside it)
    and context (cue words and assignment signs before it). Expectation-maximisation over the counts of vote
    patterns estimates, per kind, how often the labelers vote for true and for false spans, and the share of true
    ones. Their posteriors are the targets of a logistic span classifier over votes and shape; spans with at least
    ``ACCEPT`` are added beside the base spans. Only what lies wholly inside a base span is no candidate: a candidate that
    reaches beyond one (a key that holds a run of digits like a card's) is counted and voted on like any other.

Results
    Base spans and all spans, ``kind:start:end`` in code points, ends exclusive, by start and then kind.

Scale
    One pass over the texts leaves base spans and candidates with their vote patterns. The patterns' counts over
    all documents are what both models are fitted on: a sum per pattern, of which there are at most a few hundred.

Defined cases
    A null text is an empty one and has no span. Repeated rows are counted and answered each. Other columns are not
    looked at. Without candidates nothing is added. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import texts
from tidemark.workspace import materialize

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "contact"]
ORDER = {k: i for i, k in enumerate(KINDS)}
ACCEPT, EM_ROUNDS, CONTEXT = 0.5, 60, 32

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first digit of a run, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the part before each @ is its longest run of allowed characters since the last match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
        free = max(free, 0)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, z) for a, z in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# -- candidates and labelers --------------------------------------------------------------------------------------

CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+"),
    "card": re.compile(r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "contact": re.compile(r"(?<![\w.])[A-Za-z0-9_.-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]{1,63}(?:\s?[(\[]\s?dot\s?[)\]]\s?|\.)[A-Za-z]{2,63}"),
}
# Names looked up in the text before a candidate, or in it.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key", "bearer", "auth", "credential"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "contact": ("mail", "e-mail", "contact", "write to", "reach"),
}
GAZETTEER = {
    "secret": ("akia", "ghp_", "sk_live", "sk-", "xox", "eyj"),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65"),
    "phone": ("800", "888", "877", "866"),
    "contact": ("gmail", "yahoo", "outlook", "hotmail", "example", "mail"),
}
ASSIGNED = re.compile(r"[=:]\s*[\"'(]?\s*$")
HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")


def votes(kind: str, text: str, start: int, end: int) -> str:
    """One sign per labeler: + for, - against, 0 abstains; then two signs for the shape."""
    own, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    if kind == "secret":
        form = "+" if HEX.match(own) and len(own) in (32, 40, 64) else "-" if own.isdigit() or own.count("-") > 3 or "/" in own else "0"
        kinds = sum(any(map(test, own)) for test in (str.isdigit, str.islower, str.isupper))
        shape = ("m" if kinds == 3 else "h" if HEX.match(own) else "w") + ("l" if len(own) >= 32 else "s")
    elif kind == "card":
        d = digits_of(own)
        form = "+" if len(set(d)) > 2 and luhn(d) else "-"
        shape = ("g" if len(own) > len(d) else "p") + ("n" if len(d) == 16 else "o")
    elif kind == "phone":
        form, shape = ("+" if own[0] == "(" else "0"), ("b" if own[0] == "(" else "p") + "x"
    else:
        form, shape = "+", ("b" if "dot" in own.lower() else "p") + "x"
    named = "+" if own.lower().startswith(GAZETTEER[kind]) or kind == "contact" and any(g in own.lower() for g in GAZETTEER[kind]) else "0"
    cue = "+" if any(c in before for c in CUES[kind]) else "-" if kind == "card" else "0"
    placed = "+" if ASSIGNED.search(before) else "0"
    return form + named + cue + placed + shape


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    found = []
    for kind, pattern in CANDIDATES.items():
        if kind == "contact" and not ("(" in text or "[" in text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if not any(a <= start and end <= z for _, a, z in base):
                found.append((kind, start, end, votes(kind, text, start, end)))
    return found


# -- the two models -----------------------------------------------------------------------------------------------


def reliabilities(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Posterior that a span of a vote pattern is personal, by expectation-maximisation per kind."""
    out = {}
    for kind in {k for k, _ in counts}:
        patterns = sorted(p for k, p in counts if k == kind)
        number = np.array([counts[kind, p] for p in patterns], dtype=float)
        signs = np.array([["+0-".index(c) for c in p[:4]] for p in patterns])
        share = 0.5
        # Starts from labelers that are right more often than not; a cue-less pattern starts as false.
        says = np.array([[[0.5, 0.4, 0.1], [0.1, 0.5, 0.4]]] * 4)
        strength = number.sum() + 1
        for _ in range(EM_ROUNDS):
            like = np.array([[math.log(c) for c in (share, 1 - share)]] * len(patterns))
            for j in range(4):
                like += np.log(says[j][:, signs[:, j]]).T
            post = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))
            share = (float((number * post).sum()) + 1) / (strength + 1)
            for j in range(4):
                for c, weight in enumerate((number * post, number * (1 - post))):
                    seen = np.bincount(signs[:, j], weight, 3) + 4 * np.array([[0.5, 0.4, 0.1], [0.1, 0.5, 0.4]][c])
                    says[j][c] = seen / seen.sum()
        out |= {(kind, p): float(x) for p, x in zip(patterns, post)}
    return out


def span_features(kind: str, pattern: str) -> list[float]:
    signs = [{"+": 1.0, "0": 0.0, "-": -1.0}[c] for c in pattern[:4]]
    shape = [float(pattern[4] == c) for c in "mhwgpbn"] + [float(pattern[5] == c) for c in "lsno"]
    kinds = [float(kind == k) for k in CANDIDATES]
    return [1.0, *signs, *(max(0.0, a) * max(0.0, b) for a, b in ((signs[0], signs[2]), (signs[2], signs[3]), (signs[0], signs[3]))), *shape, *kinds]


def span_classifier(counts: dict[tuple[str, str], int], ridge: float = 0.5) -> dict[tuple[str, str], float]:
    """Scores of all vote patterns by logistic regression on the posteriors as soft targets."""
    if not counts:
        return {}
    target = reliabilities(counts)
    keys = sorted(counts)
    x = np.array([span_features(*k) for k in keys])
    n, y = np.array([counts[k] for k in keys], dtype=float), np.array([target[k] for k in keys])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * beta), -2, 2)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, more array<struct<kind:string,start:int,end:int,pattern:string>>"


def _find(batches):
    for batch in batches:
        numbers, base, more = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            numbers.append([sum(s[0] == k for s in spans) for k in BASE_KINDS])
            base.append(",".join(f"{k}:{a}:{z}" for k, a, z in spans))
            more.append([{"kind": k, "start": a, "end": z, "pattern": p} for k, a, z, p in candidates(text, spans)])
        counts = np.array(numbers, dtype=np.int64).reshape(len(numbers), 4)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))
        columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(base, pa.string()), pa.array(more, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "more"])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _decide(accepted: frozenset):
    def run(batches):
        for batch in batches:
            digests, spans = [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist()):
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                added = [(m["kind"], m["start"], m["end"]) for m in more if (m["kind"], m["pattern"]) in accepted]
                if added:
                    known = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in base.split(",") if s)]
                    base = ",".join(f"{k}:{a}:{z}" for k, a, z in sorted({*known, *added}, key=lambda s: (s[1], ORDER[s[0]], s[2])))
                spans.append(base)
            columns = [*(batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), pa.array(digests), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` and ``spans`` per row of ``docs``."""
    found = materialize(texts(docs).mapInArrow(_find, FOUND), "pii-spans")
    counted = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.pattern").agg(F.count("*").alias("n")).collect()
    scored = span_classifier({(r.kind, r.pattern): r.n for r in counted})
    return found.mapInArrow(_decide(frozenset(k for k, p in scored.items() if p >= ACCEPT)), OUT)
