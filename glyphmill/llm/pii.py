"""Personal data: fixed patterns, plus a linear-chain conditional random field over word shapes.

The field is trained on the small labelled table below by gradient ascent on the regularised log-likelihood, and decoded by
Viterbi over numpy batches of sequences of equal length. A sequence is a maximal run of words that lie within REACH words of a
word with a digit or an at sign, "(at)" and "[at]" included; what holds neither holds none of the kinds. What the patterns find stays; the field adds spans
that overlap none of these and whose digits or parts make sense for the kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import byte_slices, one

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 6
#: The labelled table: [kind text] marks a span.
LABELLED = (
    "Please write to [email anna.berg@example.org] before Friday noon .",
    "write to [email j_smith99@mail.example.com] or call [phone (602) 555-0142] today",
    "My number is [phone 602-555-0187] and the office closes at 18 .",
    "Call [phone (816) 555-9493] now",
    "call us at [phone +1 (828) 555-9635] any day",
    "reach me on [phone +49 30 5550 1234] or by mail",
    "Telefon [phone 030 5550 1234] oder E-Mail [email info@beispiel.example.de] bitte .",
    "appelez le [phone 01 55 50 12 34] avant 17 heures",
    "llame al [phone 555-0199] por favor",
    "phone: [phone 555.867.5309] ext 12",
    "fax [phone (312) 555-0101] , suite 400",
    "contact [email bob(at)example.com] for the 3 keys",
    "send it to [email carol[at]example.net] please , 2 copies",
    "mail [email d.lee@sub.example.co.uk] , thanks",
    "the server [ip 10.12.0.7] answers on port 8080",
    "from [ip 68.203.33.207] and [ip 192.168.1.20] we saw 14 requests",
    "host [ip 59.110.73.70] is down since 9 am",
    "card [card 4111 1111 1111 1111] expires 12/27",
    "pay with [card 5500-0000-0000-0004] or cash , 20 euros",
    "Karte [card 4012888888881881] gültig bis 2026",
    "amex [card 378282246310005] was charged 35.10 dollars",
    "carte [card 3782 822463 10005] valable",
    "numéro [phone +33 1 55 50 12 34] merci",
    "in 2024 we sold 1,200 units for 99.95 each",
    "version 1.2.3 follows 1.2.2 and 1.10",
    "on 2024-01-31 at 10:45 the 3rd batch of 250 ended",
    "order no. 20005 holds 16 items of 2 kg",
    "chapter 7 , page 118 , lines 3-9",
    "password=dd93acb406f036cedd was leaked 2 times",
    'token = "337362c5e9d09584625daaf3132186228c959e75" expires in 30 days',
    "commit 9f86d081884c7d65 fixes 12 bugs",
    "follow @someone and @other for news",
    "the 1990s and the 2000s , 20 years on",
    "score 3-2 after 90 minutes , 45 000 seats",
    "pi is 3.14159 and e is 2.71828",
    "isbn 978-3-16-148410-0 , second edition",
    "a1 b2 c3 are cells , x86 is not",
    "room 12-34 , floor 5 , building 7",
    "zip 90210 , box 1138",
    "about 7 of 10 people , 70 % of all",
    "the year 1848 , then 1871 and 1918",
    "http://example.com/a?id=42 shows 3 results",
    "section 4.2.1.9 and table 5.1",
    "pages 100 200 300 400 are blank",
    "from 1000000 to 2000000 rows in 8 s",
    "reference 4111-22 of 12.03.2021",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9@]")
_SEED = re.compile(r"[0-9@]|[(\[]at[)\]]")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The leftmost matches of the pattern, found from each at sign to the left and right: linear in any text."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) by the fixed patterns, in order."""
    found = list(_emails(text))
    # a match can't begin inside a run of digits unless it could begin at the run's start
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def _coarse(word: str | None) -> int:
    if word is None:
        return 0
    if "@" in word:
        return 5
    digits = sum("0" <= c <= "9" for c in word)
    if not digits:
        return 1
    return 3 if word[0] == "+" else 2 if all(c in "0123456789-().," for c in word) else 4


def collapsed(word: str) -> str:
    """The word's shape with runs collapsed: x for letters, d for up to four digits, D for more, others as they are."""
    shape = re.sub("[0-9]+", lambda m: "d" if len(m[0]) <= 4 else "D", re.sub(r"[^\W\d_]+", "x", word))
    return shape.rstrip(",;:!?")


#: How many values each of the features below can have; the last is the learnt index of the collapsed shape.
SIZES = (8, 9, 4, 3, 5, 4, 6, 5, 2, 6, 6)


def features(words: list[str], shapes: dict[str, int], before: str | None = None, after: str | None = None) -> list[tuple[int, ...]]:
    """Values of each word's features; before, after: the words around these, if any."""
    near = [_coarse(before), *map(_coarse, words), _coarse(after)]
    out = []
    for i, w in enumerate(words):
        digits = sum("0" <= c <= "9" for c in w)
        letters = sum(c.isalpha() for c in w)
        a, z = w[0], w[-1]
        first = 2 if "0" <= a <= "9" else 3 if a == "+" else 4 if a == "(" else 1 if a.isupper() else 0 if a.isalpha() else 5
        last = 1 if "0" <= z <= "9" else 2 if z == ")" else 3 if z in ".,;:!?" else 0 if z.isalpha() else 4
        out.append((_bucket(len(w), (2, 3, 4, 5, 8, 13, 20)), _bucket(digits, (1, 2, 3, 4, 5, 8, 13, 17)), min(letters, 3), min(w.count("@"), 2), min(w.count("."), 4), min(w.count("-"), 3), first, last, int(any(c in '="_/\\#%$:' for c in w)), near[i], near[i + 2], shapes.get(collapsed(w), 0)))
    return out


@dataclass
class Field:
    """Weights of (feature value, label), of label pairs, and of first labels; shapes: the collapsed shapes seen in training."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    offsets: np.ndarray
    shapes: dict[str, int]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def parse(line: str) -> tuple[list[str], list[int]]:
    """Words and label numbers of a line of the labelled table."""
    words, labels = [], []
    for part in re.split(r"(\[(?:email|ip|card|phone) .*?\](?= |$))", line):
        marked = re.fullmatch(r"\[(email|ip|card|phone) (.*)\]", part)
        for i, w in enumerate((marked[2] if marked else part).split()):
            words.append(w)
            labels.append(LABELS.index(("I-" if i else "B-") + marked[1]) if marked else 0)
    return words, labels


def train(table: tuple[str, ...] = LABELLED, rounds: int = 200, rate: float = 0.1, decay: float = 0.02) -> Field:
    """Fit by Adam on the penalised log-likelihood of all sequences at once; the same weights each time."""
    rows = [parse(line) for line in table]
    shapes = {s: i + 1 for i, s in enumerate(sorted({collapsed(w) for words, _ in rows for w in words}))}
    sizes = (*SIZES, len(shapes) + 1)
    offsets = np.cumsum((0, *sizes[:-1]))
    n, length, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    value = np.zeros((n, length, len(sizes)), np.int64)
    gold, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (words, labels) in enumerate(rows):
        value[i, : len(words)] = np.array(features(words, shapes)) + offsets
        gold[i, : len(words)], mask[i, : len(words)] = labels, True
    theta = [np.zeros((sum(sizes), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    at = np.arange(n)
    for r in range(1, rounds + 1):
        emit, step, start = theta
        score = emit[value].sum(axis=2)
        alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = start + score[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.where(mask[:, t, None], score[:, t] + _logsum(alpha[:, t - 1, :, None] + step, 1), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsum(step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        z = _logsum(alpha[:, -1], 1)
        grads = [np.zeros_like(t) for t in theta]
        one_hot = np.eye(k)[gold]
        miss = (one_hot - np.exp(alpha + beta - z[:, None, None])) * mask[:, :, None]
        for f in range(len(sizes)):
            np.add.at(grads[0], value[:, :, f], miss)
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + step + (score[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            grads[1] -= pair.sum(axis=0)
            np.add.at(grads[1], (gold[:, t - 1][mask[:, t]], gold[:, t][mask[:, t]]), 1)
        grads[2] += (one_hot[:, 0] - np.exp(alpha[at, 0] + beta[at, 0] - z[:, None])).sum(axis=0)
        for i, (t, g) in enumerate(zip(theta, grads, strict=True)):
            g = g - decay * t
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            t += rate * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.999**r)) + 1e-8)
    return Field(*theta, offsets, shapes)


def _scores(field: Field, words: list[str], step: int = 20_000) -> np.ndarray:
    """Each word's score for each label: a few words' features at a time, and of these one feature after another."""
    out = np.zeros((len(words), len(LABELS)))
    for i in range(0, len(words), step):
        value = np.array(features(words[i : i + step], field.shapes, words[i - 1] if i else None, words[i + step] if i + step < len(words) else None)) + field.offsets
        for f in range(value.shape[1]):
            out[i : i + step] += field.emit[value[:, f]]
    return out


def viterbi(field: Field, sequences: list[list[str]]) -> list[np.ndarray]:
    """The best labels of each sequence of words; sequences of one length are decoded together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s), []).append(i)
    for length, members in by_length.items():
        if not length:
            continue
        for c in range(0, len(members), max(1, 200_000 // length)):
            which = members[c : c + max(1, 200_000 // length)]
            score = np.stack([_scores(field, sequences[i]) for i in which])
            back = np.zeros(score.shape, np.int8)
            best = field.start + score[:, 0]
            for t in range(1, length):
                paths = best[:, :, None] + field.step
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + score[:, t]
            labels = np.zeros((len(which), length), np.int64)
            labels[:, -1] = best.argmax(axis=1)
            rows = np.arange(len(which))
            for t in range(length - 1, 0, -1):
                labels[:, t - 1] = back[rows, t, labels[:, t]]
            for row, i in enumerate(which):
                out[i] = labels[row]
    return out


def _sequences(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the words of each sequence."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    seeds = np.unique(np.searchsorted(starts, np.array([m.start() for m in _SEED.finditer(text)]), side="right") - 1)
    groups = np.split(seeds, np.flatnonzero(np.diff(seeds) > 2 * REACH + 1) + 1)
    return [words[max(0, int(g[0]) - REACH) : int(g[-1]) + REACH + 1] for g in groups]


def _sensible(kind: int, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?\. ?[\w-]+)+", value))
    if kind == 1:
        parts = re.split(r" ?\. ?", value)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9 -]+", value)) and 13 <= len(digits) <= 19 and luhn(digits)
    grouped = re.fullmatch(r"\+?[0-9().\x20/-]+", value) and re.search(r"[0-9][).\x20-]+[0-9]", value)
    return bool(grouped and 9 <= len(digits) <= 15 or re.fullmatch(r"[0-9]{3}[.\x20-][0-9]{4}", value))  # dates have eight digits


def _worth(text: str) -> bool:
    return bool(_DIGIT.search(text)) or "(at)" in text or "[at]" in text


def _union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, ascending and disjoint."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind, then start; in code points."""
    base = [base_spans(t) if _DIGIT.search(t) else [] for t in texts]
    where, sequences = [], []
    for i, t in enumerate(texts):
        if _worth(t):
            for s in _sequences(t):
                where.append((i, s))
                sequences.append([t[a:b] for a, b in s])
    every = [list(b) for b in base]
    taken = {}
    for (i, words), labels in zip(where, viterbi(field, sequences), strict=True):
        at = 0
        while at < len(words):
            label = int(labels[at])
            if not label:
                at += 1
                continue
            kind, end = (label - 1) // 2, at + 1
            while end < len(words) and labels[end] == 2 * kind + 2:
                end += 1
            a, b = words[at][0], words[end - 1][1]
            while a < b and texts[i][a] in "\"'<[{,;:":
                a += 1
            while a < b and texts[i][b - 1] in "\"'>]},;:.!?":
                b -= 1
            value = re.sub(r"[\x20\x09-\x0D]+", " ", texts[i][a:b])
            if value and _sensible(kind, value):
                if i not in taken:
                    taken[i] = _union(base[i])  # added spans hold different words, so only these can be met
                starts, ends = taken[i]
                last = bisect.bisect_left(starts, b) - 1
                if last < 0 or ends[last] <= a:
                    every[i].append((kind, a, b))
            at = end
    return [(b, sorted(e)) for b, e in zip(base, every, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: Field | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of `docs`; rows are independent of each other.

    Null is empty text: no spans and the hash of the empty string. Texts are searched whole, however long. The counts and the
    hash are those of the fixed patterns; spans holds these and what the field adds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                found = find_spans(sent.value, [t or "" for t in part.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]), pa.array([written(e) for _, e in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = one(docs, id, text).toDF("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
