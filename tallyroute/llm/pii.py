"""Personal data found by patterns and by a linear-chain conditional random field.

The patterns give the base spans. The field adds spans in other surface forms (spelled-out
mail addresses, dotted or defanged numbers): it reads windows of words around every word with a
digit or a mail sign, describes each word by its shape and that of its neighbours, and labels
the words of a window together (outside, begin or inside of one of four kinds). An added span
must pass the checks of its kind (Luhn, part range, number of digits) and touch no base span.

The labelled table is small and drawn from the corpus: windows of a sample of documents (at most
about `SAMPLE` documents, chosen by a hash of the id), labelled by the patterns, each span kept
as it is and rewritten by rule into other forms, with look-alikes that are nobody's data. The
field is fitted on the driver on at most `WINDOWS` windows; its weights are broadcast and their
size is fixed (`BUCKETS` features). Windows are decoded by Viterbi in numpy, many at a time.

Null texts count as empty; an empty table gives an empty result, repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import fraction_for, in_sample

SAMPLE = 6_000
WINDOWS = 900
BUCKETS = 1 << 12
REACH = 3
EPOCHS = 40
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)
# Forms of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
RESULT = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "spans string, n_added bigint"
)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def emails(text: str) -> list[Span]:
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((0, begin, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start. Every pattern is read in linear time."""
    found = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, begin = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(map(_small, four)):
                found.append((1, begin, end))
            begin = end + 1
    for m in DIGITS.finditer(text):
        digits = _only_digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += _phones(text)
    return found


DIGIT = re.compile("[0-9]")


def _phones(text: str) -> list[Span]:
    found = []
    for m in PHONE.finditer(text):
        body = m.group()
        while body[-1] not in "0123456789":
            body = body[:-1]
        if len(body) >= 4 and 8 <= len(_only_digits(body)) <= 15:
            found.append((3, m.start(), m.start() + len(body)))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Word ranges of every window: words within `REACH` words of one with a trigger."""
    spots = [m.start() for m in TRIGGER.finditer(text)]
    if not spots:
        return []
    out: list[list[tuple[int, int]]] = []
    reached = 0  # text before this is already in a window
    for spot in spots:
        if spot < reached and out and spot < out[-1][-1][1]:
            core = next((i for i in range(len(out[-1]) - 1, -1, -1) if out[-1][i][0] <= spot), 0)
            have = len(out[-1]) - 1 - core
            if have >= REACH:
                continue
            more = _after(text, out[-1][-1][1], REACH - have)
            out[-1] += more
        else:
            begin, end = _word_at(text, spot)
            before = _before(text, begin, REACH, reached)
            after = _after(text, end, REACH)
            if out and before and before[0][0] <= reached:
                before = [w for w in before if w[0] >= reached]
            new = before + [(begin, end)] + after
            if out and not text[out[-1][-1][1] : new[0][0]].strip():
                out[-1] += new
            else:
                out.append(new)
        reached = out[-1][-1][1]
    return out


def _word_at(text: str, spot: int) -> tuple[int, int]:
    begin = spot
    while begin and text[begin - 1] not in " \t\n\x0b\f\r":
        begin -= 1
    return begin, WORD.match(text, spot).end()


def _before(text: str, begin: int, n: int, stop: int) -> list[tuple[int, int]]:
    words: list[tuple[int, int]] = []
    while n and begin > stop:
        end = begin
        while end > stop and text[end - 1] in " \t\n\x0b\f\r":
            end -= 1
        if end <= stop:
            break
        begin = end
        while begin > stop and text[begin - 1] not in " \t\n\x0b\f\r":
            begin -= 1
        words.insert(0, (begin, end))
        n -= 1
    return words


def _after(text: str, end: int, n: int) -> list[tuple[int, int]]:
    words = []
    while n and (m := WORD.search(text, end)):
        words.append(m.span())
        end = m.end()
        n -= 1
    return words


_SHAPE = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|([^\x00-\x7f]+)|([!#$%&*|<>\"',;:?]+)")
_SHAPES = ("", "A", "a", "9", "u", "p")


def shape(word: str) -> str:
    """Runs of letters, digits and marks as one sign each; digits keep their number up to 9."""

    def sign(m: re.Match) -> str:
        if m.lastindex == 3:
            return "9" + str(min(len(m.group()), 9))
        return _SHAPES[m.lastindex]

    return _SHAPE.sub(sign, word[:60])


@lru_cache(maxsize=100_000)
def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


_CUES = re.compile(r"(?i)\A\W*(at|dot|phone|tel|fax|call|mail|e-?mail|card|ip|isbn|version|v)\W*\Z")


def _features(words: list[str]) -> list[list[int]]:
    """Feature numbers of each word: its shape, parts of it, its neighbours' shapes and cues."""
    shapes = [shape(w) for w in words]
    cues = [m.group(1).lower() if (m := _CUES.match(w)) else "" for w in words]
    out = []
    for i, s in enumerate(shapes):
        before = shapes[i - 1] if i else "^"
        after = shapes[i + 1] if i + 1 < len(words) else "$"
        plain = s.strip("p.")
        n = min(sum(c.isdigit() for c in words[i]), 20)
        names = [
            "s" + s, "c" + plain, "b" + before, "a" + after, "bs" + before + "_" + plain,
            "sa" + plain + "_" + after, f"n{n}", "q" + cues[i], "@" + str("@" in words[i]),
            "qb" + (cues[i - 1] if i else ""), "qa" + (cues[i + 1] if i + 1 < len(words) else ""),
        ]
        out.append([_bucket(x) for x in names])
    return out


N_FEATURES = 11


@dataclass
class Field:
    """Weights of a linear-chain field: features to labels, label to next label."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(windows, length, labels) of features numbered (windows, length, features)."""
        return self.emit[features].sum(axis=2)

    def decode(self, features: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels by Viterbi for windows padded to one length."""
        score = self.scores(features)
        n, most, _ = score.shape
        best = score[:, 0] + self.start
        back = np.zeros((n, most, LABELS), np.int8)
        for t in range(1, most):
            ways = best[:, :, None] + self.move[None]
            back[:, t] = ways.argmax(axis=1)
            step = ways.max(axis=1) + score[:, t]
            live = (t < length)[:, None]
            best = np.where(live, step, best)
            back[:, t] = np.where(live, back[:, t], np.arange(LABELS))
        labels = np.zeros((n, most), np.int64)
        labels[:, -1] = best.argmax(axis=1)
        for t in range(most - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
        return labels


def forbidden() -> np.ndarray:
    """Moves that are no sequence: an inside that does not follow its own begin or inside."""
    bad = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = -1e4
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return bad


def fit(rows: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """Maximum likelihood with a small penalty, by Adam on the exact gradient.

    `rows`: words and labels of each window. Without rows everything is outside.
    """
    bad = forbidden()
    start_bad = np.zeros(LABELS)
    start_bad[2::2] = -1e4
    field = Field(np.zeros((BUCKETS, LABELS)), bad.copy(), start_bad.copy())
    field.emit[:, 0] += 0.01
    rows = [r for r in rows if r[0]]
    if not rows:
        return field
    most = max(len(w) for w, _ in rows)
    n = len(rows)
    features = np.zeros((n, most, N_FEATURES), np.int64)
    labels = np.zeros((n, most), np.int64)
    length = np.array([len(w) for w, _ in rows])
    for i, (words, tags) in enumerate(rows):
        features[i, : len(words)] = _features(words)
        labels[i, : len(words)] = tags
    live = np.arange(most)[None, :] < length[:, None]
    params = [field.emit, np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    hot = np.eye(LABELS)
    for epoch in range(1, epochs + 1):
        move, start = params[1] + bad, params[2] + start_bad
        score = params[0][features].sum(axis=2)
        alpha, beta = _forward(score, move, start, live)
        total = _log_sum(np.where(live[:, -1:], alpha[:, -1], alpha[np.arange(n), length - 1]), 1)
        marginal = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        delta = (marginal - hot[labels] * live[..., None]) / n
        grad_emit = np.zeros_like(params[0])
        for f in range(N_FEATURES):
            np.add.at(grad_emit, features[..., f][live], delta[live])
        pair = (
            alpha[:, :-1, :, None] + move[None, None]
            + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        both = live[:, 1:]
        grad_move = np.exp(np.minimum(pair, 0))[both].sum(axis=0) / n
        np.subtract.at(grad_move, (labels[:, :-1][both], labels[:, 1:][both]), 1 / n)
        grads = [grad_emit, grad_move, delta[:, 0].sum(axis=0)]
        for i, g in enumerate(grads):
            g = g + 1e-5 * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            rate = 0.2 / (1 + epoch / 60)
            params[i] -= rate * (first[i] / (1 - 0.9**epoch)) / (
                np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8
            )
    return Field(params[0], params[1] + bad, params[2] + start_bad)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _forward(score, move, start, live):
    n, most, _ = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0] + start
    for t in range(1, most):
        step = _log_sum(alpha[:, t - 1, :, None] + move[None], 1) + score[:, t]
        alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        step = _log_sum(move[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], step, 0)
    return alpha, beta


_EDGE = "\"'`,;:!?#$%&*|<>{}~^"


def _checked(kind: int, text: str, begin: int, end: int) -> Span | None:
    """The span without marks at its ends, if it passes the checks of its kind."""
    while begin < end and text[begin] in _EDGE + ".":
        begin += 1
    while begin < end and text[end - 1] in _EDGE + ".":
        end -= 1
    body = text[begin:end]
    digits = _only_digits(body)
    if kind == 0:
        plain = re.sub(r"\x20*[(\[]?\b(at)\b[)\]]?\x20*", "@", body, count=1)
        plain = re.sub(r"\x20*[(\[](dot|\.)[)\]]\x20*|\x20+dot\x20+", ".", plain)
        plain = re.sub(r"\x20*([@.])\x20*", r"\1", plain)
        right = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain)
    elif kind == 1:
        parts = re.split(r"\x20*[(\[]?\.[)\]]?\x20*|[(\[]dot[)\]]", body)
        right = len(parts) == 4 and all(re.fullmatch("[0-9]+", p) and _small(p) for p in parts)
    elif kind == 2:
        right = 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9\x20./_-]*", body)
    else:
        right = 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9\x20()./-]*", body)
        right = right and re.search(r"[\x20().-]", body)
    return (kind, begin, end) if right else None


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans the field finds in each text beside the base spans."""
    work = []
    for i, text in enumerate(texts):
        for ranges_ in windows(text):
            work.append((i, ranges_, _features([text[a:b] for a, b in ranges_])))
    work.sort(key=lambda w: len(w[1]))
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(work):
        # Portions of about equal window length, so that padding and memory stay small.
        size = max(1, min(2_000, 60_000 // len(work[min(at + 2_000, len(work)) - 1][1])))
        part = work[at : at + size]
        at += size
        length = np.array([len(w[1]) for w in part])
        features = np.zeros((len(part), length.max(), N_FEATURES), np.int64)
        for j, (_, _, f) in enumerate(part):
            features[j, : len(f)] = f
        for (i, ranges_, _), tags in zip(part, field.decode(features, length).tolist()):
            for kind, first, last in _runs(tags[: len(ranges_)]):
                span = _checked(kind, texts[i], ranges_[first][0], ranges_[last][1])
                if span and not any(span[1] < e and b < span[2] for _, b, e in bases[i]):
                    out[i].append(span)
    return out


def _runs(tags: list[int]) -> Iterator[tuple[int, int, int]]:
    """(kind, first word, last word) of every labelled run."""
    i = 0
    while i < len(tags):
        if tags[i]:
            kind, first = (tags[i] - 1) // 2, i
            while i + 1 < len(tags) and tags[i + 1] == 2 + 2 * kind:
                i += 1
            yield kind, first, i
        i += 1


def _forms(kind: int, body: str, rng: random.Random) -> str:
    """Another surface form of a span."""
    digits = _only_digits(body)
    if kind == 0:
        name, _, host = body.partition("@")
        at = rng.choice(["(at)", "[at]", " (at) ", " [at] ", " @ "])
        dot = rng.choice([".", ".", "(dot)", "[dot]", " [dot] "])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return body.replace(".", rng.choice(["[.]", "(.)", " . "]))
    if kind == 2:
        mark = rng.choice([".", "/", "  ", "_"])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, rest = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "00 1 {} {} {}"]).format(
        area, mid, rest
    )


def _decoys(rng: random.Random) -> str:
    """Text with digits that is nobody's data."""
    n = rng.randint
    return rng.choice(
        [
            f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(0, 23)}:{n(0, 59):02d}", f"{n(1, 9)}.{n(0, 9)}",
            f"version {n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 999)}", f"{n(1, 99)}%", f"{n(1, 999)},{n(0, 999):03d}",
            f"{n(1, 400)}-{n(401, 900)}", "".join(str(n(0, 9)) for _ in range(n(5, 24))), f"ISBN 978-{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}",
            f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2030)}", f"v{n(1, 9)}.{n(0, 9)}.{n(0, 9)}", f"@name{n(1, 99)}", f"${n(1, 99)}.{n(0, 99):02d}",
            f'"{n(0, 1 << 60):x}{n(0, 1 << 60):x}"',
        ]
    )


def labelled_windows(text: str, seed: int) -> list[tuple[list[str], list[int]]]:
    """Windows of a text with labels from the patterns: as they are, rewritten, and decoys."""
    rng = random.Random(seed)
    base = sorted(base_spans(text), key=lambda s: (s[1], -s[2]))
    disjoint: list[Span] = []
    for span in base:
        if not disjoint or span[1] >= disjoint[-1][2]:
            disjoint.append(span)
    out = []
    for kind, begin, end in disjoint:
        for form in ("", "other", "other", "other"):
            body = text[begin:end] if not form else _forms(kind, text[begin:end], rng)
            left = [text[a:b] for a, b in _before(text, begin, REACH, max(0, begin - 400))]
            right = [text[a:b] for a, b in _after(text, end, REACH)]
            words = body.split()
            tags = [1 + 2 * kind] + [2 + 2 * kind] * (len(words) - 1)
            out.append((left + words + right, [0] * len(left) + tags + [0] * len(right)))
    plain = [text[a:b] for a, b in _after(text[:2_000], 0, 2 * REACH)]
    for _ in range(2):
        words = plain[:REACH] + _decoys(rng).split() + plain[REACH:]
        out.append((words, [0] * len(words)))
    return out


def labelled_table(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(words, tags) of windows from about `sample` documents, chosen by a hash of the id."""
    chosen = docs.filter(in_sample("doc_id", fraction_for(docs, sample), 71)).select("doc_id", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                if isinstance(text, str):
                    rows += labelled_windows(text, 0 if pd.isna(key) else int(key))
            yield pd.DataFrame(rows, columns=["words", "tags"])

    return chosen.mapInPandas(cut, "words array<string>, tags array<int>")


def trained(docs: DataFrame, sample: int = SAMPLE, limit: int = WINDOWS) -> Field:
    """The field fitted to the labelled table; at most `limit` windows reach the driver."""
    order = F.xxhash64(F.lit(3), F.concat_ws(" ", "words"))
    table = labelled_table(docs, sample).withColumn("long", F.size("words") > 40).filter(~F.col("long"))
    spans = F.exists("tags", lambda t: t > 0)
    rows = table.filter(spans).orderBy(order, F.col("words").cast("string")).limit(limit).collect()
    blank = table.filter(~spans).orderBy(order).limit(max(1, limit // 3)).collect()
    return fit([(list(r["words"]), list(r["tags"])) for r in [*rows, *blank]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, and all spans, of every document."""
    field = docs.sparkSession.sparkContext.broadcast(trained(docs))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            bases = [base_spans(t) for t in texts]
            rows = []
            for base, more in zip(bases, added_spans(texts, bases, field.value)):
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(sorted(base + more)), len(more)))
            yield pd.DataFrame(rows, columns=names)

    found: Column = F.pandas_udf(scan, RESULT)(F.col("text"))
    return docs.select("doc_id", found.alias("p")).select("doc_id", "p.*")
