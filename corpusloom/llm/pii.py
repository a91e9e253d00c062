"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers.

Regex, gazetteer and context labelers vote for, against, or not at all on every candidate span of the whole corpus.
A span's votes and features are one small pattern, so the corpus is summarised by how often each pattern occurs, a
table of bounded size; expectation-maximisation estimates each labeler's reliability from it (no labels needed), and
its posteriors train a logistic classifier of spans, which decides the candidates. Beside the votes the classifier has
features that no labeler looks at (length, make-up, place in the line), so it can tell spans apart that got like votes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider nets of the candidates; every repetition is bounded or linear: a secret has no greatest length, but has to follow = or :.
DIGITS = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}(?![A-Za-z])")
ASSIGNED = re.compile(r"[=:]\x20?[\"']?([A-Za-z0-9_+/-]{16,})")
SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:.])")
#: What every address of SIX has after its first group, quick to look for.
COLONS = re.compile(r":[0-9A-Fa-f:]")
# Gazetteers. Country domains are all names of two letters.
GENERIC_DOMAINS = frozenset("com org net edu gov int mil info biz name pro app dev cloud online site mail email".split())
#: Issuers of cards: lowest and highest start, and lengths.
ISSUERS = (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14,)), ("36", "36", (14, 19)), ("38", "39", (14, 16)))
#: Calling codes of one and two digits, and the first two digits of those of three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 80 85 87 88 96 97 99".split())
#: First numbers of addresses that name no host of a person: this network, loopback, multicast and reserved.
NO_HOST = frozenset([0, 127, *range(224, 256)])
SECRET_STARTS = ("ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "eyJ")
SECRET_NAMES = re.compile(r"(?i)(token|secret|passw(?:or)?d|pwd|api[_ -]?key|key|credential|auth|bearer|jeton|mot de passe|passwort|schlüssel|contraseña|clave)\W{0,3}$")
# Context words, before a span, in English, French, German and Spanish.
FOR = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write to|reach|reply|courriel|écrire|écrivez|contacter|schreiben|antwort|kontakt|correo|escriba|escribir|contacto)\b"),
    "ip": re.compile(r"(?i)\b(ip|ipv[46]|host|server|address|from|login|connect|client|serveur|hôte|adresse|connexion|rechner|verbindung|servidor|dirección|conexión)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay|paid|payment|carte|crédit|paiement|payer|karte|kreditkarte|zahlung|bezahlt|tarjeta|crédito|pago|pagar)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell|sms|dial|ring|téléphone|appeler|appelez|portable|telefon|handy|anruf|anrufen|rufnummer|teléfono|móvil|llamar|llame)\b"),
    "secret": re.compile(r"(?i)(token|secret|passw|pwd|api|credential|auth|login|jeton|mot de passe|clé|geheim|schlüssel|contraseña|clave|secreto)"),
}
AGAINST = re.compile(
    r"(?i)\b(version|release|isbn|issn|doi|order|invoice|item|part|serial|section|figure|table|sha|md5|commit|uuid|page|path|file|url|href|src"
    r"|commande|facture|article|série|fichier|bestellung|rechnung|artikel|seriennummer|abbildung|tabelle|seite|datei|versión|pedido|factura|artículo|serie|figura|tabla|página|archivo)\b"
)
LABELERS, EXTRA = 5, 10


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        name = text[end:at]
        start = end + len(name.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def addresses(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Leftmost non-overlapping dotted quads of digits, with their parts."""
    for run in DOTTED.finditer(text):
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 4 <= len(parts):
            quad = parts[i : i + 4]
            if all(quad):
                size = sum(map(len, quad)) + 3
                yield at, at + size, quad
                at, i = at + size + 1, i + 4
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the plain rules: matches that fail a kind's test are dropped, without another try."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    spans += [(1, a, b) for a, b, quad in addresses(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """Base spans and what the wider nets catch apart from them, as (kind, start, end, whether base)."""
    spans = [(*x, True) for x in base]
    wide = [(2, *m.span()) for m in DIGITS.finditer(text)] + [(3, *m.span()) for m in NATIONAL.finditer(text)]
    if "at" in text and "dot" in text:
        wide += [(0, *m.span()) for m in SPELLED.finditer(text)]
    wide += [(4, *m.span(1)) for m in ASSIGNED.finditer(text)]
    if COLONS.search(text):
        wide += [(1, *m.span()) for m in SIX.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    ends = [b for _, b in taken]
    for kind, a, b in sorted(wide, key=lambda x: (x[1], x[0])):
        at = int(np.searchsorted(ends, a, side="right"))
        if at == len(taken) or taken[at][0] >= b:
            spans.append((kind, a, b, False))
    return spans


def _shape(kind: int, span: str, digits: str) -> int:
    """The shape labeler: whether a span is made as its kind is."""
    if kind == 0:
        name = re.split(r"@|\(at\)|\[at\]|\x20at\x20", span)[0]
        return -1 if ".." in name or name[:1] in (".", "-") else 1
    if kind == 1:
        return 1 if ":" in span else -1 if max(map(len, span.split("."))) < 2 else 1
    if kind == 2:
        return 1 if len(set(digits)) > 3 else -1
    if kind == 3:
        return 1 if len(set(digits)) > 2 and digits.lstrip("1")[:1] not in ("", "0") else -1
    return 1 if any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else -1


def _listed(kind: int, span: str, digits: str, before: str) -> int:
    """The gazetteer labeler: top-level domains, special networks, card issuers, calling codes, and what secrets are called."""
    if kind == 0:
        last = re.split(r"[^A-Za-z]", span.rstrip(" )]"))[-1].lower()
        return 1 if len(last) == 2 or last in GENERIC_DOMAINS else -1
    if kind == 1:
        return 0 if ":" in span else -1 if int(span.split(".")[0][-3:]) in NO_HOST else 1
    if kind == 2:
        return 1 if any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in ISSUERS) else -1
    if kind == 3:
        if not span.startswith("+"):  # area and exchange codes begin with 2 to 9
            return 1 if digits[:1] > "1" and digits[3:4] > "1" else -1
        return 1 if digits[:1] in CALLING or digits[:2] in CALLING or digits[:2] in CALLING_3 else -1
    return 1 if span.startswith(SECRET_STARTS) or SECRET_NAMES.search(before) else -1


def votes_of(text: str, kind: int, a: int, b: int, base: bool) -> tuple[list[int], list[int]]:
    """Each labeler's vote (1 for, -1 against, 0 none) and the span's further features (0 or 1)."""
    span, before = text[a:b], text[max(0, a - 40) : a]
    digits = "".join(c for c in span if c in "0123456789")
    regex_vote = 1 if base else 0 if kind in (0, 3, 4) else 1 if kind == 1 or luhn(digits) else -1
    context = -1 if AGAINST.search(before) else 1 if FOR[KINDS[kind]].search(before) else 0
    edge = -1 if before[-1:].isalnum() or text[b : b + 1].isalnum() else 1
    kinds = Counter(span)
    extra = [
        len(span) > 20,
        any(c in " -.()" for c in span),
        text[max(0, a - 12) : a].count(" ") > 4,
        bool(re.search("[0-9]", text[b : b + 12])),
        -sum(n / len(span) * math.log2(n / len(span)) for n in kinds.values()) > 3.5,
        2 * len(digits) > len(span),
        any(c.isupper() for c in span) and any(c.islower() for c in span),
        "/" in span,
        before[-1:] in ("", "\n"),
        before[-1:] in ("'", '"', "=", ":"),
    ]
    return [regex_vote, _shape(kind, span, digits), _listed(kind, span, digits, before), context, edge], [int(x) for x in extra]


def pattern_of(kind: int, votes: list[int], extra: list[int]) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    for x in extra:
        code = code * 2 + x
    return code


def unpattern(code: int) -> tuple[int, np.ndarray, np.ndarray]:
    extra, votes = np.zeros(EXTRA), np.zeros(LABELERS, int)
    for i in range(EXTRA - 1, -1, -1):
        code, extra[i] = divmod(code, 2)
    for i in range(LABELERS - 1, -1, -1):
        code, v = divmod(code, 3)
        votes[i] = v - 1
    return code, votes, extra


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors, labelers' vote tables (labeler, truth, vote) and the prior, by expectation-maximisation.

    Starts from the mean vote; tables are smoothed by one pseudo-count that leans to labelers being right.
    """
    post = np.clip(0.5 + votes.sum(axis=1) / (2 * LABELERS), 0.05, 0.95)
    lean = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # truth no, yes; votes against, none, for
    for _ in range(rounds):
        weight = np.stack((counts * (1 - post), counts * post))
        tables = np.stack([[[weight[t][votes[:, j] == v].sum() + lean[t, v + 1] for v in (-1, 0, 1)] for t in (0, 1)] for j in range(LABELERS)])
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        log = np.stack([sum(np.log(tables[j, t, votes[:, j] + 1]) for j in range(LABELERS)) for t in (0, 1)])
        fresh = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -500, 500)))
        if np.abs(fresh - post).max() < 1e-9:
            break
        post = fresh
    return post, tables, prior


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps over patterns weighted by their counts."""
    x, w = np.column_stack((np.ones(len(features)), features)), np.zeros(features.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (target - p)) - ridge * w
        step = np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features_of(votes: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.concatenate((votes == 1, votes == -1, extra.astype(bool)), axis=1).astype(float)


def accepted_patterns(patterns: DataFrame, threshold: float = 0.5) -> dict[int, float]:
    """Probability by the final classifier of each pattern that reaches ``threshold``.

    ``patterns``: (pattern, n) of all candidates of the corpus; at most 5 x 3^5 x 2^10 rows, so it goes to the driver.
    """
    rows = patterns.collect()
    accepted = {}
    for kind in range(len(KINDS)):
        mine = sorted((r["pattern"], r["n"]) for r in rows if unpattern(r["pattern"])[0] == kind)
        if not mine:
            continue
        votes = np.array([unpattern(p)[1] for p, _ in mine])
        extra = np.array([unpattern(p)[2] for p, _ in mine])
        counts = np.array([n for _, n in mine], float)
        post, _, _ = estimate(votes, counts)
        x = features_of(votes, extra)
        w = fit_classifier(x, post, counts)
        prob = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
        accepted |= {p: float(q) for (p, _), q in zip(mine, prob, strict=True) if q >= threshold}
    return accepted


def apart(spans: list[tuple[int, int, int]], wanted: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """``spans`` and what of ``wanted`` (probability, kind, start, end) overlaps nothing better: the likelier first, then the longer, then the earlier."""
    taken = sorted((a, b) for _, a, b in spans)
    kept = list(spans)
    for _, kind, a, b in sorted(wanted, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
        at = bisect_left(taken, (a, a))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            insort(taken, (a, b))
            kept.append((kind, a, b))
    return kept


def find_private(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans of personal data in whole texts: doc_id, base and spans, arrays of (kind, start, end) in code points.

    ``base`` has the plain rules' spans (leftmost, not overlapping within a kind); ``spans`` these and the candidates
    that the classifier accepts, which overlap neither a base span nor each other: the likelier one stays. Both are
    ordered by KINDS, then start.

    Null or empty texts have empty arrays; null ids and repeated rows are treated each; other columns are ignored; an
    empty table gives an empty result.
    """
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("base", pa.bool_())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = candidate_spans(text, base_spans(text))
                found.append([{"kind": k, "start": a, "end": b, "pattern": pattern_of(k, *votes_of(text, k, a, b, base)), "base": base} for k, a, b, base in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "found"])

    schema = "doc_id long, found array<struct<kind: int, start: int, end: int, pattern: int, base: boolean>>"
    found = common.materialise(docs.select("doc_id", "text").mapInArrow(find, schema))
    patterns = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    accepted = docs.sparkSession.sparkContext.broadcast(accepted_patterns(patterns, threshold))
    plain = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for spans in batch.column("found").to_pylist():
                plain_ones = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"]]
                more = [(accepted.value[x["pattern"]], x["kind"], x["start"], x["end"]) for x in spans if not x["base"] and x["pattern"] in accepted.value]
                for rows, found_ in ((base, plain_ones), (every, sorted(apart(plain_ones, more)))):
                    rows.append([{"kind": k, "start": a, "end": b} for k, a, b in found_])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, plain), pa.array(every, plain)], names=["doc_id", "base", "spans"])

    out = "array<struct<kind: int, start: int, end: int>>"
    return found.mapInArrow(decide, f"doc_id long, base {out}, spans {out}")


def span_text(column: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))
