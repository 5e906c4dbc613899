"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks all neighbouring pairs up at
once, by binary search over the sorted pair keys, and every word merges its lowest-ranked pair
wherever it stands; words without a known pair are finished and leave. A pair made by a merge
always ranks behind that merge, so a round gives what merging one by one from the left gives.

Pieces of text and their words are encoded once per task and then looked up: that memory is
emptied when it reaches `MAX_WORDS` pieces, and texts are handled in portions of `CHUNK` characters, so a task's
memory does not depend on the input. The vocabulary file is read on the driver, from a path
that is a parameter, and broadcast (about 2 MB, whatever the input).

Null and empty texts have no tokens; repeated rows and repeated ids are encoded row by row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1_000_000
MAX_WORDS = 400_000
_SPACE = r"\t-\r \x85\xa0  -     　"
# The pattern that cuts words and the mark of a word's end in this vocabulary.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+| ")
WORD_END = "</w>"
CONTROLS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile(f"[{_SPACE}]+")
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others are numbered from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, … of every range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


class Vocabulary:
    """Tables of a word BPE file: symbols of bytes, sorted pair keys, bytes of tokens."""

    def __init__(self, content: str):
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {**ids, **self.special}
        self.size = max(named.values()) + 1
        characters = byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int64)
        self.final = np.array([ids[c + WORD_END] for c in characters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.ranks = order
        self.made = made[order]
        names = [b""] * self.size
        for name, number in named.items():
            names[number] = name.encode() + b" "
        self.name_length = np.array([len(n) for n in names], np.int64)
        self.name_start = np.cumsum(self.name_length) - self.name_length
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.special_pattern = (
            regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        )

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        unknown = len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), unknown - 1)
            known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.ranks[at], unknown), unknown)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            best_here = np.repeat(best, size)
            open_ = best_here < unknown
            if not open_.all():
                done.append((symbols[~open_], owner[~open_]))
            chosen = np.flatnonzero(open_ & (rank == best_here))
            # Equal neighbours ("aaa"): of a run of touching pairs every other one is merged.
            if len(chosen):
                begins = np.append(True, np.diff(chosen) > 1)
                run = np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
                symbols[chosen] = self.made[at[chosen]]
            keep = open_
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        tokens = np.concatenate([d[0] for d in done])
        of = np.concatenate([d[1] for d in done])
        order = np.argsort(of, kind="stable")
        return tokens[order], np.bincount(of, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's token names joined by blanks, as UTF-8."""
        length = self.name_length[ids]
        whole = self.names[ranges(self.name_start[ids], length)]
        upto = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
        return [
            whole[a : max(a, b - 1)].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())
        ]


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Pool:
    """Runs of token ids, numbered one after the other."""

    def __init__(self):
        self.ids, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, count: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.count = np.concatenate([self.count, count])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered runs in one array, and the length of each."""
        length = self.count[numbers]
        start = np.cumsum(self.count) - self.count
        return self.ids[ranges(start[numbers], length)], length


def grouped_sum(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums over consecutive groups of `counts` values; an empty group sums to 0."""
    upto = np.append(0, np.cumsum(values))
    return np.diff(upto[np.append(0, np.cumsum(np.array(counts, np.int64)))])


class Encoder:
    """Encodes texts; pieces between blanks and the words in them are each encoded once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        special = self.vocabulary.special
        self.pieces = _Numbers({name: i for i, name in enumerate(special)})
        self.piece_ids = Pool()
        self.piece_ids.add(np.array(list(special.values()), np.int64), np.ones(len(special), np.int64))
        # The blank between two pieces is word 0 and has no ids.
        self.words, self.word_ids = _Numbers({" ": 0}), Pool()
        self.word_ids.add(np.empty(0, np.int64), np.zeros(1, np.int64))

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text that no word reaches across; names of special tokens by themselves."""
        special = self.vocabulary.special_pattern
        if special is None or "<|" not in text:
            return _pieces(text)
        out, at = [], 0
        for found in special.finditer(text):
            out += _pieces(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + _pieces(text[at:])

    def _learn(self, pieces: list[str]) -> None:
        known = len(self.words)
        # Characters are lower-cased one by one, so a final sigma is like any other.
        joined = unicodedata.normalize("NFC", " ".join(pieces)).replace("Σ", "σ").lower()
        found = list(map(self.words.__getitem__, SPLIT.findall(joined)))
        if len(self.words) > known:
            self.word_ids.add(*self.vocabulary.merge([w.encode() for w in list(self.words)[known:]]))
        flat = np.array(found, np.int64)
        ids, length = self.word_ids.take(flat)
        ends = np.append(np.flatnonzero(flat == 0), len(flat))
        self.piece_ids.add(ids, np.diff(np.append(0, np.cumsum(length))[ends], prepend=0))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and the number of tokens of each text."""
        if len(self.pieces) > MAX_WORDS:
            self._forget()
        known = len(self.pieces)
        numbered = [list(map(self.pieces.__getitem__, self._cut(t))) for t in texts]
        if len(self.pieces) > known:
            self._learn(list(self.pieces)[known:])
        flat = np.fromiter(chain.from_iterable(numbered), np.int64)
        ids, length = self.piece_ids.take(flat)
        return ids, grouped_sum(length, [len(n) for n in numbered])


def _pieces(text: str) -> list[str]:
    # str.split() would also cut at 1C to 1F, which are no white space here.
    if CONTROLS.search(text):
        return [piece for piece in BLANKS.split(text) if piece]
    return text.split()


@lru_cache(maxsize=2)
def encoder_of(content: str) -> Encoder:
    return Encoder(Vocabulary(content))


def portions(texts: list[str], limit: int = CHUNK) -> Iterator[list[str]]:
    """The texts in order, in portions of about `limit` characters."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Struct of n_tokens and the digests of the ids and of the decoded text."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            rows = []
            for part in portions([t if isinstance(t, str) else "" for t in batch]):
                ids, counts = encoder.encode(part)
                decoded = encoder.vocabulary.decode(ids, counts)
                flat, upto = ids.astype("<u4"), np.append(0, np.cumsum(counts)).tolist()
                for n, a, b, back in zip(counts.tolist(), upto[:-1], upto[1:], decoded):
                    digest = hashlib.sha256(flat[a:b].tobytes()).hexdigest()
                    rows.append((n, digest, hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(digests, RESULT)(text)


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Token ids of a text as an array of int."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            out = []
            for part in portions([t if isinstance(t, str) else "" for t in batch]):
                ids, counts = encoder.encode(part)
                out += np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(ids_of, "array<int>")(text)


def decoded_text(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """Text of an array of token ids; null and empty arrays give an empty text."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def texts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = encoder_of(shared.value).vocabulary
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], np.int64) for x in batch]
            flat = np.concatenate([np.empty(0, np.int64), *lists])
            texts = vocabulary.decode(flat, np.array([len(x) for x in lists], np.int64))
            yield pd.Series([t.decode() for t in texts], dtype=object)

    return F.pandas_udf(texts_of, "string")(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = docs.select("doc_id", encoded(docs.sparkSession, F.col("text"), path).alias("bpe"))
    return out.select("doc_id", "bpe.*")
