"""Personal data by weak supervision.

Patterns propose spans of four kinds.  The base spans are certain; looser patterns propose more.
Labelers (pattern, structure, gazetteer, context, border, variety) vote for or against each proposal
or abstain.  Expectation-maximisation finds how reliable each labeler is and how likely each
combination of votes is to be personal data; a logistic regression on votes and shape, trained on
those probabilities, then decides about the proposals that are not certain.

Proposals are summed up by (kind, votes, shape) over all documents.  There are only so many
combinations, whatever the number of documents, so the driver learns from that table alone.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stage, with_id

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "structure", "gazetteer", "context", "border", "variety")
SURE = 0.95  # how likely a proposal must be to count
CONTEXT = 32  # characters before a span in which cue words count

# Gazetteers.
TLDS = frozenset("com org net edu gov mil int info biz io ai app dev me tv eu de fr es it nl be at ch uk ie se no dk fi pl pt "
                 "cz ru ua tr gr hu ro us ca mx br ar cl co jp cn kr in au nz za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 "
                          "86 90 91 92 93 94 95 98 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421".split())
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "60", "62", "64", "65", "35")
CUES = {
    "email": frozenset("mail email e-mail contact write reach correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login client addr dirección adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit pay tarjeta carte karte".split()),
    "phone": frozenset("tel phone call fax mobile cell telefon teléfono téléphone whatsapp".split()),
}
COUNTER_CUES = frozenset("id no nr order invoice isbn issn version page figure article item serial ref doi commit sku".split())

# The base patterns.  Possessive repeats match the same as plain ones here, as what follows them
# can't start with what they repeat; they keep the search linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ZONE = re.compile(r"[0-9+][\x20().0-9+-]*")  # holds any match of the three
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# The loose patterns.  An address whose `at` or dots are spelled out, or stand apart; a plain `at` only before
# a spelled-out dot.  Numbers in other groups, after other separators, or with their dots in brackets.
SPELLED_AT = re.compile(r"\x20?[\[({](?:at|AT|At|@)[\])}]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]++\x20(?:dot|DOT)\x20)|(?<=[A-Za-z0-9])\x20@\x20?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\x20(?=[A-Za-z0-9])")
SPELLED_DOT = re.compile(r"\x20?[\[({](?:dot|DOT|Dot|\.)[\])}]\x20?|\x20(?:dot|DOT)\x20")
SPELLED_REST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|" + SPELLED_DOT.pattern + r")[A-Za-z0-9-]++)+")
BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?|\x20(?:dot|DOT)\x20)[0-9]{1,3}){3}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOOSE = re.compile(r"[(]?[0-9](?:[\x20().\-/ ‐-– ]{0,3}[0-9])++")
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9]|[0-3]?[0-9][./\x20-][0-3]?[0-9][./\x20-](?:19|20)[0-9]{2})(?![0-9])")
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the certain spans, by kind, then start."""
    found: list[list[tuple[int, int, int]]] = [[], [], [], []]
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found[0].append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found[1].append((1, *m.span()))
        for m in CARD.finditer(text, a, b):
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found[2].append((2, *m.span()))
        for m in PHONE.finditer(text, a, b):
            if 8 <= len(digits_of(m[0])) <= 15:
                found[3].append((3, *m.span()))
    return [s for kind in found for s in kind]


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Proposals beside the certain spans; none overlaps one of those."""
    out, last = [], 0
    for m in SPELLED_AT.finditer(text):
        start = m.start()
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        after = SPELLED_REST.match(text, m.end()) if start < m.start() else None
        if after:
            out.append((0, start, after.end()))
        last = after.end() if after else m.end()
    out += [(1, *m.span()) for m in BROKEN_IP.finditer(text)]
    out += [(1, *m.span()) for m in IP6.finditer(text) if m[0].count(":") == 7 or m[0].count("::") == 1]
    for m in LOOSE.finditer(text):
        if m.end() - m.start() < 7:
            continue
        d = len(digits_of(m[0]))
        if m[0].count(".") >= 3 and d <= 12:
            out.append((1, *m.span()))
        elif 13 <= d <= 19:
            out.append((3 if m[0].startswith("00") and d <= 17 else 2, *m.span()))
        elif 8 <= d <= 12 and d < len(m[0]):
            out.append((3, *m.span()))
    taken, at = sorted((s, e) for _, s, e in base), 0
    kept = []
    for kind, s, e in sorted(set(out), key=lambda x: x[1]):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            kept.append((kind, s, e))
    return kept


def plain_form(span: str) -> str:
    """An address or number as it is usually written: `at` and dots that are spelled out become signs."""
    return SPELLED_DOT.sub(".", SPELLED_AT.sub("@", span))


def _dated(text: str, start: int, end: int) -> bool:
    """Whether a number is, or begins or ends with, a date."""
    return any(m.start() <= 1 or m.end() >= end - start - 1 for m in DATE.finditer(text[start:end]))


def _is_ip6(span: str) -> bool:
    try:
        return ipaddress.IPv6Address(span) is not None
    except ValueError:
        return False


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[str, str]:
    """One sign per labeler (+ for, - against, 0 abstains), and the span's shape."""
    span = text[start:end]
    d = digits_of(span)
    if kind == 0:
        tld = plain_form(span).rpartition("@")[2].rpartition(".")[2].lower()
        structure, listed = tld.isalpha() and len(tld) >= 2, tld in TLDS
    elif kind == 1 and ":" in span:
        structure, listed = _is_ip6(span), span[:2].lower() in ("20", "24", "26", "28", "2a", "2c", "fd", "fe")
    elif kind == 1:
        parts = plain_form(span).split(".")
        structure = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        listed = parts[0] not in ("", "0", "00", "000")
    elif kind == 2:
        structure, listed = luhn(d), d.startswith(CARD_HEADS)
    else:
        structure = 9 <= len(d.removeprefix("00")) <= 13 and not (not base and _dated(text, start, end))
        abroad = base or d.startswith("00")
        listed = any(d.removeprefix("00").startswith(c) for c in CALLING_CODES) if abroad else None
    words = WORDS.findall(text[max(0, start - CONTEXT) : start].lower())[-4:]
    cue = 1 if any(w in CUES[KINDS[kind]] for w in words) else -1 if any(w in COUNTER_CUES for w in words) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    free = not (left.isalnum() or left in ("_", "-", "#", "$", "€") and left) and not (right.isalnum() or right in ("_", "%") and right)
    varied = len(set(d)) > 2 if kind else len(span) >= 6
    pattern = 1 if base else -1 if kind == 3 and not span.startswith(("0", "(")) else 0
    signs = (pattern, 1 if structure else -1, 0 if listed is None else 1 if listed else -1, cue, 1 if free else -1, 1 if varied else -1)
    shape = f"{min(len(d), 20)}.{min(len(span) - len(d), 12) if kind else 0}"
    return "".join("-0+"[s + 1] for s in signs), shape


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:string>>"


def propose(text: str | None) -> list[tuple[int, int, int, bool, str, str]]:
    text = text or ""
    base = base_spans(text)
    return [(*s, True, *votes(text, *s, True)) for s in base] + [(*s, False, *votes(text, *s, False)) for s in loose_spans(text, base)]


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id and spans, all proposals of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "votes", "shape"), s, strict=True)) for s in propose(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": spans})

    return with_id(docs, "doc_id", "text").mapInPandas(run, f"doc_id string, spans {SPAN}")


def reliabilities(signs: np.ndarray, n: np.ndarray, turns: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over combinations of votes (rows of -1, 0, 1) that occur n times.

    Returns how likely each combination is to be personal data, and for each labeler the chance of
    each vote (against, abstain, for) given that it is not, or is.
    """
    likely = np.clip(0.5 + signs.mean(axis=1) / 2, 0.05, 0.95)
    chance = np.zeros((signs.shape[1], 2, 3))
    for _ in range(turns):
        for y, w in ((0, n * (1 - likely)), (1, n * likely)):
            for v in (-1, 0, 1):
                chance[:, y, v + 1] = (w[:, None] * (signs == v)).sum(axis=0) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        prior = np.clip((n * likely).sum() / n.sum(), 0.01, 0.99)
        logit = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(signs.shape[1]):
            logit += np.log(chance[j, 1, signs[:, j] + 1] / chance[j, 0, signs[:, j] + 1])
        likely = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return likely, chance


class Classifier:
    """Per kind a logistic regression on votes and shape."""

    def __init__(self, weights: dict[int, dict[str, float]], labelers: dict[int, np.ndarray]):
        self.weights, self.labelers = weights, labelers

    def probability(self, kind: int, signs: str, shape: str) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        return 1 / (1 + float(np.exp(-np.clip(sum(w.get(x, 0.0) for x in _features(signs, shape)), -30, 30))))

    def chosen(self, spans) -> list[tuple[int, int, int, bool]]:
        """The certain spans and the proposals that are sure; of two that overlap the likelier, then the first."""
        base = [(s["kind"], s["start"], s["end"], True) for s in spans if s["base"]]
        rest = [(-self.probability(s["kind"], s["votes"], s["shape"]), s["start"], s["end"], s["kind"]) for s in spans if not s["base"]]
        for p, start, end, kind in sorted(rest):
            if -p >= SURE and all(end <= s or e <= start for _, s, e, _ in base):
                base.append((kind, start, end, False))
        return sorted(base)


def _features(signs: str, shape: str) -> list[str]:
    digits, others = shape.split(".")
    return ["1", f"d{digits}", f"o{others}", *(f"{j}{s}" for j, s in enumerate(signs) if s != "0")]


def learn(found: DataFrame) -> Classifier:
    """Learn from the proposals of all documents."""
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count()
    rows = sorted(tuple(r) for r in each.collect())
    weights, labelers = {}, {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r[0] == kind]
        if not own:
            continue
        signs = np.array([["-0+".index(c) - 1 for c in r[1]] for r in own])
        n = np.array([r[3] for r in own], float)
        likely, labelers[kind] = reliabilities(signs, n)
        names = sorted({x for r in own for x in _features(r[1], r[2])})
        x = np.array([[name in f for name in names] for f in (set(_features(r[1], r[2])) for r in own)], float)
        share = n / n.sum()
        w = np.zeros(len(names))
        for _ in range(30):  # Newton steps of the ridge-penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (likely - p)) - 1e-3 * w
            bend = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w + np.linalg.solve(bend, slope)
        weights[kind] = dict(zip(names, w.tolist(), strict=True))
    return Classifier(weights, labelers)


def _line(spans) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are those of the certain spans (`kind:start:end` by kind, then start,
    comma-joined; code points, end exclusive); `spans` lists all, likewise; n_added counts the others.
    Null and empty texts have none: counts 0, an empty list and the hash of the empty text.  Null
    ids are kept, repeated rows answered each, other columns ignored.
    """
    found = stage(proposals(docs))
    model = learn(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for spans in b["spans"]:
                every = model.chosen(spans)
                base = [s for s in every if s[3]]
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(_line(base).encode()).hexdigest(),
                             _line(every), len(every) - len(base)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    fields = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return found.mapInPandas(run, fields).withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span found replaced by its kind in angle brackets (`<email>`).

    Documents without personal data come back unchanged, null texts too; n_chars, where there is
    such a column, follows the text.  Spans of two kinds that overlap are replaced as one, by the
    name of the first.
    """
    model = learn(stage(proposals(docs)))
    def clean(text: str) -> str:
        names = ("kind", "start", "end", "base", "votes", "shape")
        out, at = [], 0
        for kind, start, end, _ in sorted(model.chosen([dict(zip(names, s, strict=True)) for s in propose(text)]), key=lambda s: (s[1], s[0])):
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind]}>"]
            at = max(at, end)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([t if t is None else clean(t) for t in b.tolist()], dtype=object)

    new = "_clean"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, cleaned("text"))
    if "n_chars" in docs.columns:
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])
