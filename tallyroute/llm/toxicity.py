"""Toxicity of texts after undoing disguises of words as a noisy channel.

A disguised word is a lattice of characters: a figure or sign may stand for one of several letters
(leetspeak) or for nothing, a letter said three times or more may stand for itself or its double
(repetition), and a run of single letters is one word (spacing). Viterbi decoding under a
character trigram model picks the word that was most likely meant; many lattices are decoded at
once in numpy. The restored text is scored by a logistic model over the words it contains.

The character model mixes trigrams of all documents (counted by every task over its own rows and
summed in Spark; at most 28**3 sums) with trigrams of the words that training documents show to be
toxic. Those words are found by comparing document frequencies between the classes on at most
about `SAMPLE` labelled training rows, chosen by a hash of the id; at most `MAX_WORDS` enter the
model, which is broadcast.

Every piece of text that could hide a word is decoded: with a figure or sign of `LEET` anywhere in
it, with letters around other signs, with letters said three times, and runs of single letters.
Restored text has no accents, so it is looked up among the learnt words without theirs.
Signs at the end of a piece may belong to the word or to the sentence, so each ending is decoded of
its own. Other pieces are their own only reading.

Null texts count as empty; an empty text has no word and scores by the bias alone. A null id is
never held out and never a training row. Contradicting labels of one id drop out. Without labels
of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.bpe import portions
from tallyroute.llm.common import crc_class, fraction_for, in_sample, labels_of, stored

SAMPLE = 12_000
MAX_WORDS = 2_000
MODULUS, HELD_OUT = 5, 0
MIN_DOCS, CHANCE = 3, 0.05
LETTERS = string.ascii_lowercase
EDGE, OTHER, SIZE = 26, 27, 28
#: What figures and signs may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Signs that may stand between the letters of a word for nothing.
FILLERS = ".-_*~^'`:,/"
LOG_PLAIN, LOG_LEET, LOG_DROP, LOG_ONCE = 0.0, -0.5, -3.0, -0.1
MARKS = string.punctuation + "¡¿…«»“”„–—"
#: Marks that spell nothing at either end of a piece.
STOPS = "".join(sorted(set(MARKS) - LEET.keys())) + " "
ENDS = STOPS + "".join(LEET)
#: So many signs at the end of a piece are read one by one; of longer runs, all together as well.
ENDINGS = 6
#: Learnt words have at least so many letters.
MIN_LETTERS = 3

_DISGUISE = re.compile(r"[0-9@$!|+(€]|[^\W\d_][.\-_*~^'`:,/]+[^\W\d_]|([^\W\d_])\1\1")
_PLAIN = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(
    r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+(€])[\x20.\-_*,]{1,2}){2,}(?:[^\W_]|[@$!|+(€])(?![^\W_])"
)


def _symbols() -> np.ndarray:
    """Symbol of each character code below 0x250: letters without their accents, the rest OTHER."""
    import unicodedata

    table = np.full(0x250, OTHER, np.int64)
    for code in range(0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())[0]
        if base in LETTERS:
            table[code] = LETTERS.index(base)
        elif base.isspace():
            table[code] = EDGE
    return table


SYMBOLS = _symbols()


def folded(word: str) -> str:
    """The word as `decode` would write it: letters without their accents, others as they are."""
    at = [int(SYMBOLS[min(ord(c), 0x24F)]) for c in word]
    return "".join(LETTERS[s] if s < 26 else c for s, c in zip(at, word))


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return SYMBOLS[np.minimum(codes, 0x24F)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str) and text:
                    s = symbols_of(" " + text + " ")
                    total += np.bincount(s[:-2] * SIZE**2 + s[1:-1] * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "at bigint, n bigint")
    counts = np.zeros(SIZE**3)
    for row in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    return counts.reshape(SIZE, SIZE, SIZE)


def language_model(corpus: np.ndarray, words: dict[str, float], share: float = 0.5) -> np.ndarray:
    """log P(c | a, b): trigrams of the corpus and of the toxic words in equal parts."""
    own = np.zeros((SIZE, SIZE, SIZE))
    for word in words:
        s = np.append(np.append([EDGE, EDGE], symbols_of(word)), EDGE)
        np.add.at(own, (s[:-2], s[1:-1], s[2:]), 1.0)

    def smoothed(counts: np.ndarray) -> np.ndarray:
        pair = counts.sum(axis=0) + 0.1
        pair /= pair.sum(axis=1, keepdims=True)
        return (counts + 2.0 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 2.0)

    return np.log((1 - share) * smoothed(corpus) + share * smoothed(own))


#: Readings of one place: (symbol or -1 for nothing, log weight); from SIZE on, SIZE and the code of a
#: letter that is none of a-z, which the model takes as OTHER.
Slot = tuple[tuple[int, float], ...]


def lattice(piece: str) -> list[Slot]:
    """Places of a lower-case piece with what each may stand for."""
    slots: list[Slot] = []
    i = 0
    while i < len(piece):
        c = piece[i]
        run = 1
        while i + run < len(piece) and piece[i + run] == c:
            run += 1
        i += run
        symbol = int(SYMBOLS[min(ord(c), 0x24F)])
        if symbol < 26 or c.isalpha():
            symbol = symbol if symbol < 26 else SIZE + ord(c)
            slots.append(((symbol, LOG_PLAIN),))
            if run == 2:
                slots.append(((symbol, LOG_PLAIN),))
            elif run > 2:  # said three times or more: once or twice
                slots.append(((symbol, LOG_PLAIN), (-1, LOG_ONCE)))
        elif c in LEET:
            ways = [(LETTERS.index(x), LOG_LEET) for x in LEET[c]]
            slots += [tuple([*ways, (-1, LOG_DROP)])] * min(run, 2)
        elif c in FILLERS or c == " ":
            slots.append(((-1, LOG_PLAIN),))
        else:
            slots.append(((OTHER, LOG_PLAIN), (-1, LOG_DROP)))
    return slots


def endings(piece: str) -> list[list[Slot]]:
    """Lattices of a piece with none, one, ... of the signs at its end spelling letters."""
    piece = piece.strip(STOPS)
    body = piece.rstrip(ENDS)
    slots = lattice(body)
    out = [slots]
    for sign, run in groupby(piece[len(body) :]):
        if sign in LEET:
            way = tuple((LETTERS.index(x), LOG_LEET) for x in LEET[sign])
            for _ in range(min(len(list(run)), 2)):
                slots = [*slots, way]
                out.append(slots)
    out = out[: ENDINGS + 1] + out[max(ENDINGS + 1, len(out) - 1) :]
    return [slots for slots in out if len(slots) >= MIN_LETTERS]


WAYS = 4
STATES = SIZE * SIZE
#: Places decoded at once, by the size of their back pointers.
PLACES = 1 << 15


def decode(lattices: list[list[Slot]], model: np.ndarray) -> list[str]:
    """Most likely reading of each lattice; the state is the pair of the last two symbols."""
    # Up to the first choice there is one path: decoding starts behind it.
    out, rests, pairs = [], [], []
    for slots in lattices:
        lead = 0
        while lead < len(slots) and len(slots[lead]) == 1 and slots[lead][0][0] >= 0:
            lead += 1
        said = [slots[t][0][0] for t in range(lead)]
        out.append("".join(map(_letter, said)))
        rests.append(slots[lead:])
        pairs.append([min(s, OTHER) for s in [EDGE, EDGE, *said][-2:]])
    order = sorted((i for i, rest in enumerate(rests) if rest), key=lambda i: len(rests[i]))
    end = len(order)
    while end:
        at = max(0, end - min(128, max(1, PLACES // len(rests[order[end - 1]]))))
        part = order[at:end]
        texts = _decode_part([rests[i] for i in part], [pairs[i] for i in part], model)
        for i, text in zip(part, texts):
            out[i] += text
        end = at
    return out


def _letter(symbol: int) -> str:
    return LETTERS[symbol] if symbol < 26 else chr(symbol - SIZE) if symbol >= SIZE else "?"


def _decode_part(lattices: list[list[Slot]], pairs: list[list[int]], model: np.ndarray) -> list[str]:
    n, most = len(lattices), max(map(len, lattices), default=0)
    symbol = np.full((n, most, WAYS), -2)
    weight = np.full((n, most, WAYS), -np.inf)
    for i, slots in enumerate(lattices):
        for t, slot in enumerate(slots):
            for w, (s, p) in enumerate(slot):
                symbol[i, t, w], weight[i, t, w] = min(s, OTHER), p
    best = np.full((n, SIZE, SIZE), -np.inf)
    best[np.arange(n), *np.transpose(pairs)] = 0
    back = np.full((n, most, SIZE, SIZE), -1, np.int16)  # way * SIZE + symbol before the pair
    rows = np.arange(n)
    for t in range(most):
        new = np.full_like(best, -np.inf)
        done = symbol[:, t, 0] == -2
        new[done] = best[done]
        for w in range(WAYS):
            for s in np.unique(symbol[:, t, w]):
                here = rows[symbol[:, t, w] == s]
                if s == -2:
                    continue
                p = weight[here, t, w][:, None, None]
                if s == -1:
                    gain, source = best[here] + p, np.full((len(here), SIZE, SIZE), w * SIZE)
                    target = (here[:, None, None], np.arange(SIZE)[:, None], np.arange(SIZE)[None, :])
                else:
                    ways = best[here] + model[None, :, :, s]
                    first = ways.argmax(axis=1)
                    gain = ways.max(axis=1)[:, :, None] + p
                    source = (w * SIZE + first)[:, :, None]
                    target = (here[:, None, None], np.arange(SIZE)[None, :, None], np.array([s]))
                better = gain > new[target]
                new[target] = np.where(better, gain, new[target])
                back[target[0], t, target[1], target[2]] = np.where(
                    better, source, back[target[0], t, target[1], target[2]]
                )
        best = new
    # The word ends here.
    flat = (best + model[None, :, :, EDGE]).reshape(n, -1).argmax(axis=1)
    texts = []
    for i, slots in enumerate(lattices):
        a, b = divmod(int(flat[i]), SIZE)
        letters = []
        for t in range(len(slots) - 1, -1, -1):
            way, before = divmod(int(back[i, t, a, b]), SIZE)
            if way >= 0 and slots[t][way][0] >= 0:
                letters.append(_letter(slots[t][way][0]))
                a, b = before, a
        texts.append("".join(reversed(letters)))
    return texts


def readings(text: str) -> tuple[set[str], list[str]]:
    """Plain words of a lower-case text, and the pieces that may hide a word.

    A piece is plain if it has only letters between marks that spell nothing and none three times
    in a row. Three and more single letters in a row are read together, with the first one and
    without it, for it may be a word.
    """
    plain = set(text.split())
    marked = [piece for piece in plain if not piece.isalpha()]
    hidden = []
    letters = LETTERS if text.isascii() else {c for c in set(text) if c.isalpha()}
    triple = [c * 3 for c in letters if c * 3 in text]
    if triple:
        hidden = [p for p in plain if p.isalpha() and any(t in p for t in triple)]
    for piece in marked:
        word = piece.strip(MARKS)
        plain.add(word)
        whole = piece.strip(STOPS)
        if _DISGUISE.search(whole):
            hidden.append(whole)
    for run in _SPACED.findall(text):
        hidden += [run, run[1:].lstrip(STOPS)]
    return plain, hidden


class Restorer:
    """Decodes hidden pieces and remembers them, up to a bound."""

    def __init__(self, model: np.ndarray, limit: int = 50_000):
        self.model, self.limit, self.known = model, limit, {}

    def restored(self, pieces: list[list[str]]) -> list[set[str]]:
        """Readings of each text's pieces; pieces are decoded together."""
        if len(self.known) > self.limit:
            self.known = {}
        new = sorted({p for ps in pieces for p in ps} - self.known.keys())
        asked = [(piece, slots) for piece in new for slots in endings(piece)]
        self.known.update((piece, set()) for piece in new)
        for (piece, _), word in zip(asked, decode([slots for _, slots in asked], self.model)):
            self.known[piece].add(word)
        return [{word for p in ps for word in self.known[p]} for ps in pieces]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    characters: np.ndarray

    def __post_init__(self) -> None:
        # Restored text has no accents: the word it may be, of those alike the weightiest.
        order = sorted(self.weights, key=lambda w: (self.weights[w], w))
        self.folded = {folded(w): w for w in order}
        self.lengths = sorted({len(w) for w in self.folded if len(w) > 3})

    def hits(self, words: set[str], read: set[str]) -> set[str]:
        found = words & self.weights.keys()
        for text in read:
            if text in self.folded:
                found.add(self.folded[text])
            elif len(text) > 4:  # words run together
                parts = {text[i : i + n] for n in self.lengths for i in range(len(text) - n + 1)}
                found.update(self.folded[part] for part in parts & self.folded.keys())
        return found

    def score(self, hits: set[str]) -> float:
        total = self.bias + sum(self.weights[w] for w in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of about `sample` labelled rows that are not held out."""
    known = labels_of(labels, "toxic").filter(crc_class("doc_id", MODULUS) != HELD_OUT)
    chosen = stored(known.filter(in_sample("doc_id", fraction_for(known, sample), 61)), "toxic-labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def toxic_words(rows: DataFrame, keep: int = MAX_WORDS) -> dict[str, float]:
    """Log-odds of words that stand clearly more often in toxic documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, label = [], []
            for text, y in zip(batch["text"], batch["label"]):
                found = readings(text.lower())[0] if isinstance(text, str) else set()
                found = [w for w in found if _PLAIN.fullmatch(w) and MIN_LETTERS <= len(w) < 40]
                words += found
                label += [y] * len(found)
            yield pd.DataFrame({"word": words, "label": label})

    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return {}
    toxic, clean = n[1], n[0]
    counts = rows.mapInPandas(cut, "word string, label int").groupBy("word").agg(
        F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")
    )
    counts = stored(counts.filter(F.col("a") >= MIN_DOCS), "toxic-word-counts")
    # Chance that a word with n documents is toxic in a share a / n of them (Chernoff's bound),
    # against one in `1 / CHANCE` for all words together.
    base = toxic / (toxic + clean)
    share = F.col("a") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.col("n") * (share * F.log(share / base) + rest)
    gain = F.log((F.col("a") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("n") - F.col("a") + 0.5))
    found = (
        counts.filter((share > base) & (evidence >= math.log(max(counts.count(), 1) / CHANCE)))
        .orderBy(F.desc("a"), "word")
        .limit(keep)
        .select("word", gain.alias("gain"))
    )
    return {r.word: r.gain for r in found.collect()}


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows = stored(training_rows(docs, labels, sample), "toxic-rows")
    words = toxic_words(rows)
    if not words:
        return None
    model = Model(words, 0.0, language_model(trigram_counts(docs), words))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = _hits_of(batch["text"], shared.value)
            yield pd.DataFrame({"hits": [sorted(h) for h in hits], "label": batch["label"]})

    kinds = rows.mapInPandas(reduce, "hits array<string>, label int").groupBy("hits", "label").count()
    table = sorted((tuple(r["hits"]), r["label"], r["count"]) for r in kinds.collect())
    return _fitted(model, table)


def _fitted(model: Model, table: list[tuple[tuple[str, ...], int, int]]) -> Model:
    """Logistic weights of the words and the bias, by penalised Newton steps."""
    names = sorted(model.weights)
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(table), len(names) + 1))
    x[:, -1] = 1
    for i, (hits, _, _) in enumerate(table):
        x[i, [at[w] for w in hits]] = 1
    y = np.array([label for _, label, _ in table], float)
    n = np.array([count for _, _, count in table], float)
    w = np.zeros(len(names) + 1)
    prior = np.append([model.weights[name] for name in names], 0.0)
    penalty = np.append(np.full(len(names), 0.05), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + penalty * (w - prior)
        curve = (x.T * (n * p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 3.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]), model.characters)


@lru_cache(maxsize=1)
def _restorer(key: bytes) -> Restorer:
    return Restorer(np.frombuffer(key).reshape(SIZE, SIZE, SIZE))


def _hits_of(texts: pd.Series, model: Model) -> list[set[str]]:
    restorer = _restorer(model.characters.tobytes())
    hits: list[set[str]] = []
    for part in portions([t if isinstance(t, str) else "" for t in texts]):
        both = [readings(t.lower()) for t in part]
        read = restorer.restored([hidden for _, hidden in both])
        hits += [model.hits(plain, r) for (plain, _), r in zip(both, read)]
    return hits


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(crc_class("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out")
    model = trained(docs, labels)
    if model is None:
        none = docs.select("doc_id", held_out, F.lit(0.0).alias("score"))
        return none.withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(h) for h in _hits_of(texts, shared.value)])

    scored = docs.select("doc_id", held_out, F.pandas_udf(score, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
