"""Personal data (operator 3): weak-supervision aggregation over candidate spans.

Candidates come from patterns: the base kinds, whose matches always stay, and looser forms of them. Labelers vote on
each: the pattern's strictness, gazetteers (top-level domains, words that name the kind) and the context (digits or
letters that touch it, words that speak against it, a check of the number). Votes are one of a bounded number of
patterns, so the corpus is counted by kind and pattern; expectation-maximisation estimates how reliable each labeler is,
and its posteriors train the final classifier, a logistic regression over the votes. Looser spans that the classifier
accepts are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import saved

# Fixed order of the kinds in results.
KINDS = ("email", "ip", "card", "phone")
NO, YES, NONE = 0, 1, 2
LABELERS = ("strict pattern", "own word before", "foreign word before", "gazetteer", "touching text", "number check")
# Characters of context that labelers see on either side.
CONTEXT = 40

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]*")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number's first digit has none before it, so no digit is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Looser forms, found only where the base kinds found nothing.
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

OWN_WORDS = {
    "email": re.compile(r"e-?mail|contact|mailto|write to|correo|courriel|kontakt", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|client|addr|serveur|servidor", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|credit|payment|carte|tarjeta|karte", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|cell|whatsapp|llame|anruf", re.IGNORECASE),
}
FOREIGN_WORDS = re.compile(r"version|release|section|chapter|isbn|invoice|order|serial|figure|table|\bv\b|\bno\b|\bid\b", re.IGNORECASE)
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai co app dev me tv eu uk de fr es it nl be ch at us ca au nz jp cn in br mx ru pl se no fi dk pt ie gr cz".split())


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs, so that a long run of letters is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the four base kinds, by kind, then start; a failing match is dropped, not tried again."""
    found = [Span(0, s, e, True) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [Span(1, m.start(), m.end(), True) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(Span(2, m.start(), m.end(), True))
        if "+" in text:
            found += [Span(3, m.start(), m.end(), True) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return found


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates in looser forms that touch no base span."""
    found = []
    patterns = [(0, _LOOSE_EMAIL)] if "[at" in text or "(at" in text else []
    if _DIGITS.search(text):
        patterns += [(1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)]
    taken = sorted((s.start, s.end) for s in base)
    starts = [s for s, _ in taken]
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            i = int(np.searchsorted(starts, m.end()))
            # base spans of different kinds may lie in each other, so all that begin before are looked at nearby
            if not any(e > m.start() for _, e in taken[max(0, i - 4) : i]):
                found.append(Span(kind, m.start(), m.end(), False))
    return found


def votes(text: str, span: Span) -> int:
    """The labelers' votes on a span, as one number."""
    kind, body = KINDS[span.kind], text[span.start : span.end]
    before = text[max(0, span.start - CONTEXT) : span.start]
    digits = "".join(_DIGITS.findall(body))
    cast = [YES if span.base else NONE]
    cast.append(YES if OWN_WORDS[kind].search(before) else NONE)
    cast.append(NO if FOREIGN_WORDS.search(before) else NONE)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", body.rstrip("])"))[-1].lower()
        cast.append(YES if last in TOP_DOMAINS else NO)
    elif kind == "ip":
        cast.append(NO if body.startswith(("0.", "255.", "::")) else NONE)
    elif kind == "card":
        cast.append(YES if digits[:1] in "3456" else NO)
    else:
        cast.append(NO if re.search(r"[01]$", re.sub(r"[^0-9(].*", "", body.lstrip("+1 "))[:1] or "2") else NONE)
    left, right = text[span.start - 1 : span.start] if span.start else "", text[span.end : span.end + 1]
    cast.append(NO if (left.isalnum() or right.isalnum()) else YES)
    if kind == "card":
        cast.append(YES if luhn(digits) else NO)
    elif kind == "phone":
        cast.append(YES if len(set(digits)) > 2 else NO)
    else:
        cast.append(NONE)
    return sum(v * 3**i for i, v in enumerate(cast))


class Reliability(NamedTuple):
    share: float
    table: np.ndarray


def fit_labelers(v: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 5.0) -> tuple[Reliability, np.ndarray]:
    """Expectation-maximisation: reliabilities, and each pattern's chance of being personal data.

    ``prior``: candidates that the belief "labelers are right more often than wrong" weighs as much as.
    """
    believed = np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])
    yes, no = (v == YES).sum(1), (v == NO).sum(1)
    chance = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - chance), counts * chance])
        table = np.empty((2, v.shape[1], 3))
        for c in (0, 1):
            for r in range(v.shape[1]):
                n = np.bincount(v[:, r], weights=mass[c], minlength=3) + prior * believed[c]
                table[c, r] = n / n.sum()
        share = (mass[1].sum() + prior * 0.5) / (counts.sum() + prior)
        logs = np.log(table)
        gap = np.log(share) - np.log1p(-share) + sum(logs[1, r, v[:, r]] - logs[0, r, v[:, r]] for r in range(v.shape[1]))
        again = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        settled = np.abs(again - chance).max(initial=0) < 1e-9
        chance = again
        if settled:
            break
    return Reliability(float(share), table), chance


def fit_classifier(v: np.ndarray, counts: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the votes, by Newton steps on the soft labels."""
    x = span_features(v)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (counts * (soft - p)) - ridge * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def span_features(v: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(v), 1)), v == YES, v == NO], axis=1).astype(float)


def votes_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.kind, s.start, s.end)))


_FOUND = "base array<struct<kind:int,start:int,end:int,votes:int>>, loose array<struct<kind:int,start:int,end:int,votes:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, base, loose = batch.column("text"), [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            own = base_spans(text)
            more = loose_spans(text, own)
            for out, spans in ((base, own), (loose, more)):
                out.append([{"kind": s.kind, "start": s.start, "end": s.end, "votes": votes(text, s)} for s in spans])
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(base, _SPAN_TYPE), pa.array(loose, _SPAN_TYPE)], [*names, "base", "loose"])


def accepted_patterns(found: DataFrame, at_least: float = 0.5) -> list[tuple[int, int]]:
    """(kind, votes) that the classifier accepts, learned per kind from the counts of all candidates."""
    every = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    rows = every.collect()  # at most kinds * 3 ** labelers rows
    out = []
    for kind in sorted({r.kind for r in rows}):
        codes = np.array([r.votes for r in rows if r.kind == kind])
        counts = np.array([r.n for r in rows if r.kind == kind], float)
        v = votes_of(codes)
        _, soft = fit_labelers(v, counts)
        w = fit_classifier(v, counts, soft)
        out += [(kind, int(c)) for c, x in zip(codes, span_features(v) @ w) if x >= np.log(at_least / (1 - at_least))]
    return out


def found_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep.., base, added): the base spans of every text, and those that the method adds."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text") + _FOUND
    found = saved(rows.mapInArrow(K.thrifty(_find), schema), "spans")
    good = [k * 3 ** len(LABELERS) + v for k, v in accepted_patterns(found)]
    code = lambda s: s["kind"] * 3 ** len(LABELERS) + s["votes"]
    added = F.filter("loose", lambda s: code(s).isin(good)) if good else F.filter("loose", lambda s: F.lit(False))
    return found.select(*keep, "base", added.alias("added"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[list, ...] = tuple([] for _ in KINDS)
        sha, every = [], []
        for base, added in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist()):
            own = [Span(s["kind"], s["start"], s["end"], True) for s in base]
            for k, col in enumerate(counts):
                col.append(sum(s.kind == k for s in own))
            sha.append(hashlib.sha256(joined(own).encode()).hexdigest())
            every.append(joined(own + [Span(s["kind"], s["start"], s["end"], False) for s in added]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(every)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs``.

    Null and empty texts have no spans. Counts and base_sha256 are of the base kinds; spans also has what the method
    adds, as kind:start:end in code points, end exclusive. Repeated rows each give a row; a null doc_id is kept; an
    empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found_spans(docs, "doc_id").mapInArrow(K.thrifty(_texts), f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def mask(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap, the first one names it."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= done:
            continue
        if s["start"] >= done:
            out += [text[done : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
        done = s["end"]
    return "".join([*out, text[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with personal data masked in text; n_chars, where there is one, follows the text.

    Every row stays, repeated ones and those without a doc_id too; null and empty texts stay as they are. An empty table gives
    no rows.
    """
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(K.thrifty(_find), _FOUND)
    good = set(accepted_patterns(found))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(at), []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if text:
                    base = base_spans(text)
                    spans = base + [s for s in loose_spans(text, base) if (s.kind, votes(text, s)) in good]
                    text = mask(text, [s._asdict() for s in spans])
                out.append(text)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(out, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(K.thrifty(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
