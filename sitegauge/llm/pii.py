"""Personal data by weak supervision.

Candidates are spans that patterns propose: the exact base patterns (e-mail, IP address, card, phone), and
looser ones (spelled-out addresses, other phone and card forms, IPv6, identity numbers, bank accounts, names).
Five labelers vote yes, no or abstain on each: the pattern's validity, its grouping, a gazetteer, cue
words before it, and what it is embedded in. Per kind, expectation-maximisation estimates from all
candidates how reliable each labeler is and how likely each vote pattern is a true span. A logistic span classifier
is trained on these likelihoods, with votes and shape as features, and decides which of the looser spans are
added. Base spans always stay.

Both models are fitted to counts of (kind, votes, shape) over all documents. There are at most
``len(KINDS) * 3**5 * 2**6`` such triples, so what is collected is bounded whatever the corpus.

Defined results. Null or empty text: no spans. Repeated rows count each time. Without candidates nothing is
fitted and no span added. Added spans never overlap a base span or each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import pieces, small_batches, stored, texts

KINDS = ("email", "ip", "card", "phone", "account", "identity", "name")
EMAIL, IP, CARD, PHONE, ACCOUNT, IDENTITY, NAME = range(7)
BASE = 4  # the first kinds have base patterns
LABELERS, SHAPES = 5, 6
SURE = 0.9
ABSTAIN, YES, NO = 0, 1, 2
BYTES_PER_STEP = 1 << 20

#: Gazetteers: frequent top-level domains, country calling codes, first digits of cards, given names.
TOP_LEVELS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at co us ca".split())
CALLING_CODES = ("+1", "+20", "+27", "+3", "+4", "+52", "+54", "+55", "+56", "+57", "+6", "+7", "+81", "+82", "+86", "+90", "+91", "+92", "+98")
GIVEN_NAMES = "James John Robert Michael William David Richard Thomas Charles Daniel Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Maria Peter Paul Hans Klaus Jean Pierre Marie Carlos Jose Juan Luis Carmen".split()
#: Words before a span that speak for it, by kind, and words that speak against any.
CUES = (
    ("mail", "contact", "write", "correo", "kontakt"), ("ip", "host", "server", "address", "addr"), ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    ("phone", "tel", "call", "mobile", "fax", "telefon"), ("iban", "account", "konto", "cuenta", "compte"), ("ssn", "social", "identity", "passport", "ausweis"), ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "señor", "monsieur"),
)
AGAINST = ("version", "isbn", "order", "invoice", "sha", "token", "id", "no", "page", "chapter", "vol")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63})+")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ -])?(?:\([0-9]{2,4}\) ?|[0-9]{3}-)[0-9]{3}[ -][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"\b(?:" + "|".join(GIVEN_NAMES) + r") (?:[A-Z]\. )?[A-Z][a-z]+\b")
_WORD_BEFORE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, by looking to both sides of each @ in turn."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            least = found.end()
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, in code points."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((IP, m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def _looser(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans that the looser patterns propose."""
    if "(" in text or "[" in text:
        yield from ((EMAIL, m.start(), m.end()) for m in _SPELLED.finditer(text))
    if ":" in text:
        yield from ((IP, m.start(), m.end()) for m in _IPV6.finditer(text))
    yield from ((IP, m.start(), m.end()) for m in _IP.finditer(text))
    yield from ((CARD, m.start(), m.end()) for m in _DIGITS.finditer(text) if 13 <= m.end() - m.start() <= 40 and 13 <= sum(map(str.isdigit, m[0])) <= 19)
    yield from ((PHONE, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text))
    yield from ((ACCOUNT, m.start(), m.end()) for m in _IBAN.finditer(text))
    yield from ((IDENTITY, m.start(), m.end()) for m in _IDENTITY.finditer(text))
    yield from ((NAME, m.start(), m.end()) for m in _NAME.finditer(text))


def _iban(text: str) -> bool:
    moved = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def votes_and_shape(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """Votes of the five labelers (base 3) and shape of a span (a bit each)."""
    span, digits = text[start:end], "".join(c for c in text[start:end] if c in "0123456789")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    grouped = len(re.findall(r"[ .()-]+", span))
    valid = {
        EMAIL: lambda: YES if "@" in span and ".." not in span else ABSTAIN,
        IP: lambda: YES if ":" in span or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split(".")) else NO,
        CARD: lambda: YES if len(digits) >= 15 and luhn(digits) else NO,
        PHONE: lambda: YES if span[0] == "+" and 8 <= len(digits) <= 15 else ABSTAIN,
        ACCOUNT: lambda: YES if _iban(span) else NO,
        IDENTITY: lambda: NO if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else ABSTAIN,
        NAME: lambda: ABSTAIN,
    }[kind]()
    grouping = {
        EMAIL: lambda: YES if span.rpartition("@")[0].strip(".") else NO,
        IP: lambda: NO if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else YES,
        CARD: lambda: YES if len(digits) == 16 and grouped in (0, 3) else NO if grouped > 4 else ABSTAIN,
        PHONE: lambda: YES if grouped >= 2 else NO if grouped == 0 else ABSTAIN,
        ACCOUNT: lambda: YES if 15 <= len(span.replace(" ", "")) <= 34 else NO,
        IDENTITY: lambda: YES,
        NAME: lambda: YES if len(span.split()) <= 3 else ABSTAIN,
    }[kind]()
    known = {
        EMAIL: lambda: YES if re.split(r"[.\])( ]+", span)[-1].lower() in TOP_LEVELS else NO,
        IP: lambda: NO if span.startswith(("0.", "127.", "255.")) else ABSTAIN,
        CARD: lambda: YES if digits[:1] in ("3", "4", "5", "6") else ABSTAIN,
        PHONE: lambda: YES if span.startswith(CALLING_CODES) else ABSTAIN,
        ACCOUNT: lambda: YES if span[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "CH", "BE") else ABSTAIN,
        IDENTITY: lambda: ABSTAIN,
        NAME: lambda: YES,
    }[kind]()
    words = [w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40) : start])[-4:]]
    cue = YES if any(w in CUES[kind] for w in words) else NO if any(w in AGAINST for w in words[-2:]) else ABSTAIN
    embedded = NO if (before.isalnum() or before in ("_", "=", "/", "#")) and before or after.isalnum() else YES
    code = 0
    for v in (valid, grouping, known, cue, embedded):
        code = code * 3 + v
    shape = (end - start > 16) | (grouped > 0) << 1 | (before in ("", " ", "\n", "(", '"', "'", "<", ":")) << 2 | (after in ("", " ", "\n", ")", '"', "'", ">", ",", ";", ".")) << 3
    return code, shape | (len(set(digits)) <= 2 and len(digits) > 4) << 4 | ("@" in span or "+" in span[:1]) << 5


_FOUND = "doc_id bigint, spans array<struct<kind: int, start: bigint, stop: bigint, base: boolean, votes: int, shape: int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and all candidate spans with votes and shape; base spans are marked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            rows = []
            for text in texts(b.column("text")):
                base = base_spans(text)
                all_ = [(*s, True) for s in base] + [(*s, False) for s in sorted(set(_looser(text)) - set(base))]
                spans = []
                for kind, start, end, is_base in all_:
                    votes, shape = votes_and_shape(text, kind, start, end)
                    spans.append({"kind": kind, "start": start, "stop": end, "base": is_base, "votes": votes, "shape": shape})
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(rows, schema.field("spans").type)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def _vote_table(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], axis=1)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: likelihood of each pattern, and P(vote | true or not) of each labeler."""
    yes, no = (votes == YES).sum(axis=1), (votes == NO).sum(axis=1)
    p = (yes + 1.0) / (yes + no + 2.0)
    for _ in range(rounds):
        table = np.empty((2, LABELERS, 3))
        for y, weight in ((1, n * p), (0, n * (1 - p))):
            for k in range(LABELERS):
                counts = np.bincount(votes[:, k], weight, minlength=3)
                # A labeler is taken to be better than chance, by two pseudo-votes on its side.
                counts = counts + np.array([1.0, 3.0, 1.0] if y else [1.0, 1.0, 3.0])
                table[y, k] = counts / counts.sum()
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        log = [np.log(q) + sum(np.log(table[y, k][votes[:, k]]) for k in range(LABELERS)) for y, q in ((0, 1 - prior), (1, prior))]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return p, table


@dataclass
class SpanModel:
    weights: dict[int, np.ndarray]  # per kind
    tables: dict[int, np.ndarray]  # what EM found of the labelers, per kind

    @staticmethod
    def features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        table = _vote_table(votes)
        bits = (shape[:, None] >> np.arange(SHAPES)) & 1
        return np.concatenate([np.ones((len(votes), 1)), table == YES, table == NO, bits], axis=1).astype(float)

    def probability(self, kind: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x, out = self.features(votes, shape), np.zeros(len(kind))
        for k, w in self.weights.items():
            rows = kind == k
            out[rows] = 1 / (1 + np.exp(-np.clip(x[rows] @ w, -500, 500)))
        return out


def fit(found: DataFrame) -> SpanModel:
    """Estimate the labelers and train the span classifier on the counts of all candidates."""
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shape")
    rows = spans.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).toPandas().sort_values(["kind", "votes", "shape"])
    model = SpanModel({}, {})
    for kind, group in rows.groupby("kind"):
        votes, shape, n = (group[c].to_numpy() for c in ("votes", "shape", "n"))
        p, model.tables[int(kind)] = reliabilities(_vote_table(votes), n.astype(float))
        x = SpanModel.features(votes, shape)
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps with a ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (p - q)) - w
            curve = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(x.shape[1])
            step = np.linalg.solve(curve, slope)
            w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        model.weights[int(kind)] = w
    return model


_SPANS = "doc_id bigint, spans array<struct<kind: string, start: bigint, stop: bigint, base: boolean, probability: double>>"


def decided(found: DataFrame, model: SpanModel, sure: float = SURE) -> DataFrame:
    """Per document: base spans, and the looser ones that the classifier is sure of; by kind, then start."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for spans in b.column("spans").to_pylist():
                p = model.probability(*(np.array([s[c] for s in spans], np.int64) for c in ("kind", "votes", "shape"))) if spans else []
                kept = [(s["kind"], s["start"], s["stop"], True, float(q)) for s, q in zip(spans, p, strict=True) if s["base"]]
                taken = sorted((k[1], k[2]) for k in kept)
                more = sorted(((s["kind"], s["start"], s["stop"], False, float(q)) for s, q in zip(spans, p, strict=True) if not s["base"] and q >= sure), key=lambda s: (-s[4], s[:3]))
                for s in more:
                    if all(y <= s[1] or x >= s[2] for x, y in taken):
                        kept.append(s)
                        taken.append((s[1], s[2]))
                rows.append([dict(zip(("kind", "start", "stop", "base", "probability"), (KINDS[k], *rest), strict=True)) for k, *rest in sorted(kept)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, schema.field("spans").type)], schema=schema)

    return found.mapInArrow(run, _SPANS)


def detect(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """Per document: doc_id, spans (kind, start, stop, base, probability) in code points."""
    found = stored(candidates(docs), "spans")
    return decided(found, fit(found), sure)


