"""Language-model scores of whole documents from a gated recurrent network trained here.

Tokens: words `[^\\x20\\x09-\\x0D]+` of the text with only A-Z lower-cased, then one end token.
Training rows are those whose crc32(doc_id as text) mod 10 is not 0; a null doc_id counts as held
out.

Base score (exact, over all training tokens): sum over tokens of
log10((c + 0.1) / (N + 0.1 (V + 1))), c the token's training count, N all training tokens, V the
distinct ones (the end token is one of them, counted once a training document).

Model: a GRU over word ids, trained by truncated backpropagation through time in numpy, with a
class-factored softmax: the `VOCAB` most frequent training words are ranked, cut into classes of
`CLASS_SIZE` by rank, and P(word) = P(class | state) P(word | class, state). Every other word is
one unknown id, whose share is split by the exact training counts of the unknown words:
P(w | unknown) = (c + 0.1) / (N_unk + 0.1 (V_unk + 1)). A document starts from a zero state fed the
end token; the state is carried from window to window to its end, so the score is the log10
probability of the whole document, end token included.

Training reads every training token. The rows are dealt to rounds by a hash (`ROUNDS`, disjoint,
together all of them). In a round every task starts from the model of the round before and trains
on all its rows of the round; the models of the tasks are averaged, weighted by their tokens, in
groups of parameters spread over the cluster. Every row is passed over `EPOCHS` times in its round,
however large the corpus: a task passes over one group of its rows (see below) after the other. Task
boundaries are those of the input files.

Scale: texts are split, counted and looked up in Arrow, group by group of about `GROUP_TOKENS`
tokens (or `GROUP_BYTES` bytes), with no Python object per word. Words are counted in each group
first, then by one Spark aggregate over all training documents; counts, N and V stay a table. The
driver sees at most `KNOWN` of the frequent words and one model (some 300 KB), which are broadcast.
Documents are scored in Arrow batches, many documents side by side as lanes of one matrix. Words of
a document beyond the known ones are joined with the count table by word; the frequent words never
enter that join, so no word is a hot key.

Edge cases: a null or empty text is the end token alone; repeated rows are scored each; without
training rows every count is 0 and the model is untrained (uniform); empty tables give no rows;
extra columns of any name are ignored; a document of any length is read to its end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import crc_class, stored, with_row

SMOOTH = 0.1
FOLDS = 10

#: Model size: words with an id of their own, words a class, hidden and input widths.
VOCAB = 2048
CLASS_SIZE = 64
HIDDEN = 16
EMBED = 16
#: Training: sixteenths of the rows in each round, window of backpropagation, most lanes and
#: tokens a lane aims at, passes over every row, step size.
ROUNDS = (1, 5, 10)
WINDOW = 16
LANES = 512
LANE_TOKENS = 2048
EPOCHS = 3
RATE = 0.01
SEED = 7
#: Words whose counts are broadcast at most; pieces a model is cut into for averaging.
KNOWN = 131_072
PIECES = 64
#: Rows whose logits are worked on at once; documents scored side by side in one matrix, and rows of a
#: stretch of steps where few are left; rows an Arrow batch brings; tokens gathered before they are
#: counted, scored or trained on at once, and bytes of text, which bind where words are long.
BLOCK_ROWS = 512
SCORE_LANES = 512
SCORE_ROWS = 1 << 13
BATCH_ROWS = 500
GROUP_TOKENS = 1_000_000
GROUP_BYTES = 1 << 25

END, UNK = 0, 1
LOG10 = math.log(10.0)


# ---------------------------------------------------------------- the network, in numpy


def init_model(n_ids: int, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n_classes = -(-n_ids // CLASS_SIZE)
    s = 0.1
    return {
        "E": rng.normal(0, s, (n_ids, EMBED)),
        "Wx": rng.normal(0, s, (EMBED, 3 * HIDDEN)),
        "Uzr": rng.normal(0, s, (HIDDEN, 2 * HIDDEN)),
        "Uc": rng.normal(0, s, (HIDDEN, HIDDEN)),
        "b": np.zeros(3 * HIDDEN),
        "Wc": rng.normal(0, s, (HIDDEN, n_classes)),
        "bc": np.zeros(n_classes),
        "Wo": rng.normal(0, s, (n_classes, HIDDEN, CLASS_SIZE)),
        "bo": np.zeros((n_classes, CLASS_SIZE)),
    }


def _moderate(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether exp needs no shift for any state (all in [-1, 1]): per output class, or for one matrix."""
    reach = np.abs(weights).sum(axis=-2)
    return ((bias + reach).max(axis=-1) < 60) & ((bias - reach).max(axis=-1) > -60)


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights of z and r apart, their signs turned, for 1 / (1 + exp)."""
    return np.ascontiguousarray(-weights.reshape(HIDDEN, -1, HIDDEN).transpose(1, 0, 2))


def _gate_tables(p) -> np.ndarray:
    """What each id adds to the gates z, r (signs turned) and c, (3, ids, H)."""
    H = HIDDEN
    tables = np.empty((3, len(p["E"]), H), dtype=p["E"].dtype)
    for gate, table in enumerate(tables):
        part, sign = slice(gate * H, (gate + 1) * H), 1 if gate == 2 else -1
        np.matmul(p["E"], sign * p["Wx"][:, part], out=table)
        table += sign * p["b"][part]
    return tables


def _recur(p, tables, h, inputs, keeps):
    """States of a window of lanes, the states before them and r times these, (T, B, H) each, and
    the gates, (3, T, B, H). A gate of one step is one block of memory. keeps: (T, B, 1)."""
    H = HIDDEN
    T, B = inputs.shape
    gates = np.empty((3, T, B, H), dtype=h.dtype)
    for table, gate in zip(tables, gates):
        np.take(table, inputs, axis=0, out=gate, mode="clip")
    states, before, gated = (np.empty((T, B, H), dtype=h.dtype) for _ in range(3))
    Uzr, Uc = _by_gate(p["Uzr"]), p["Uc"]
    for t in range(T):
        zr, c = gates[:2, t], gates[2, t]
        last = np.multiply(h, keeps[t], out=before[t])
        zr += np.matmul(last, Uzr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c += np.multiply(zr[1], last, out=gated[t]) @ Uc
        np.tanh(c, out=c)
        h = np.subtract(c, last, out=states[t])
        h *= zr[0]
        h += last
    return states, before, gated, gates


def _by_class(targets: np.ndarray, n_classes: int):
    """Order of the targets by class, and its blocks of at most `BLOCK_ROWS` rows: where one starts and
    ends, the classes in it with their rows there, and the places of the targets among the logits of
    their class and of their classes among all classes, laid flat."""
    order = np.argsort((targets // CLASS_SIZE).astype(np.int16), kind="stable")
    cls, at = np.divmod(targets[order], CLASS_SIZE)
    ends = np.cumsum(np.bincount(cls, minlength=n_classes)).tolist()
    row = np.arange(len(order)) % BLOCK_ROWS
    own = row * CLASS_SIZE + at, row * n_classes + cls
    blocks = []
    for start in range(0, len(order), BLOCK_ROWS):
        end = min(start + BLOCK_ROWS, len(order))
        parts = [
            (c, slice(max(ends[c - 1] if c else 0, start) - start, min(ends[c], end) - start))
            for c in range(int(cls[start]), int(cls[end - 1]) + 1)
        ]
        parts = [(c, part) for c, part in parts if part.start < part.stop]
        blocks.append((start, end, parts, own[0][start:end], own[1][start:end]))
    return order, blocks


def _class_bias(p, n_valid_ids: int) -> np.ndarray:
    """Output biases; slots past the last id hold no word."""
    bo = p["bo"].copy()
    bo.reshape(-1)[n_valid_ids:] = -1e30
    return bo


def _output_weights(p, n_valid_ids: int):
    """Weights of the words of each class and of the classes, for states followed by a one; and whether
    exp needs no shift, for each class and for the classes."""
    bo = _class_bias(p, n_valid_ids)
    words = np.concatenate([p["Wo"], bo[:, None, :]], axis=1)
    classes = np.concatenate([p["Wc"], p["bc"][None, :]])
    return words, classes, _moderate(p["Wo"], bo).tolist(), bool(_moderate(p["Wc"], p["bc"]))


def _logits(S, weights, parts):
    """Logits of the words of its class and of the classes for each row of a block; rows are shifted
    where exp needs it."""
    words, classes, words_moderate, classes_moderate = weights
    of_words = np.empty((len(S), CLASS_SIZE), dtype=S.dtype)
    for c, part in parts:
        e = np.matmul(S[part], words[c], out=of_words[part])
        if not words_moderate[c]:
            e -= e.max(axis=1, keepdims=True)
    of_classes = S @ classes
    if not classes_moderate:
        of_classes -= of_classes.max(axis=1, keepdims=True)
    return of_words, of_classes


def _exp(logits: np.ndarray) -> np.ndarray:
    """exp of the logits, in place; the sum of each row."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], dtype=logits.dtype)


def _with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of the states in the order, each followed by a one."""
    S = np.ones((len(order), HIDDEN + 1), dtype=states.dtype)
    S[:, :HIDDEN] = np.take(states, order, axis=0)
    return S


class Places:
    """Where the rows of a window go: its targets by class and its inputs by id.

    Equal ids are summed up in turns: the first rows of all ids, the second ones and so on, ids with
    more rows first, so that a turn is one block; ids with more than `TURNS` rows are summed up alone.
    """

    TURNS = 24

    def __init__(self, inputs: np.ndarray, targets: np.ndarray, n_classes: int):
        targets = targets.reshape(-1)
        self.order, self.blocks = _by_class(targets, n_classes)
        self.back = np.argsort(self.order)

        inputs = inputs.reshape(-1)
        counts = np.bincount(inputs)
        self.ids = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        rank = np.empty(len(counts), dtype=np.int16)
        rank[self.ids] = np.arange(len(self.ids))
        rows = np.argsort(rank[inputs], kind="stable")
        counts = counts[self.ids]
        n_alone = int((counts > self.TURNS).sum())
        ends = np.cumsum(counts)
        self.alone = list(zip((ends - counts)[:n_alone].tolist(), ends[:n_alone].tolist()))
        first = int(ends[n_alone - 1]) if n_alone else 0
        turn = np.arange(first, len(rows)) - np.repeat((ends - counts)[n_alone:], counts[n_alone:])
        rows[first:] = rows[first:][np.argsort(turn.astype(np.int16), kind="stable")]
        self.rows = rows
        self.turns = np.bincount(turn).tolist() if len(turn) else []

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of each of the ids."""
        values = np.take(values, self.rows, axis=0)
        out = np.empty((len(self.ids), values.shape[1]), dtype=values.dtype)
        end = 0
        for i, (start, end) in enumerate(self.alone):
            np.matmul(np.ones(end - start, dtype=values.dtype), values[start:end], out=out[i])
        rest = out[len(self.alone) :]
        for i, size in enumerate(self.turns):
            if i:
                rest[:size] += values[end : end + size]
            else:
                rest[...] = values[end : end + size]
            end += size
        return out


def loss_and_grads(p, inputs, targets, resets, weights, h0, n_valid_ids, places=None, with_loss=True):
    """Mean negative log-likelihood of a window of lanes, its gradients and the last state.

    inputs, targets, resets, weights: (T, B); resets zero the state before a step. places: those of
    the window, if they are known. with_loss: the gradients do not need the likelihood itself.
    """
    T, B = inputs.shape
    H = HIDDEN
    dtype = p["E"].dtype
    n_classes = len(p["bc"])
    places = places or Places(inputs, targets, n_classes)
    keeps = (1 - resets).astype(dtype)[..., None]
    states, before, gated, gates = _recur(p, _gate_tables(p), h0.astype(dtype, copy=False), inputs, keeps)
    count = max(float(weights.sum()), 1.0)

    # Output softmaxes, rows in the order of their classes, by blocks that stay in the cache.
    rows = _with_one(states.reshape(T * B, H), places.order)
    w = (np.take(weights.reshape(-1), places.order) / count).astype(dtype)
    out = _output_weights(p, n_valid_ids)
    words, classes = (np.zeros(np.swapaxes(x, -1, -2).shape, dtype=dtype) for x in out[:2])
    dS = np.empty((T * B, H), dtype=dtype)
    loss = 0.0
    for start, end, parts, *own in places.blocks:
        S, wb, db = rows[start:end], w[start:end], dS[start:end]
        errors = _logits(S, out, parts)
        for e, at in zip(errors, own):
            total = _exp(e)
            flat = e.reshape(-1)
            if with_loss:
                loss -= float((wb * np.log(np.take(flat, at) / total)).sum())
            e *= (wb / total)[:, None]
            flat[at] -= wb
        e, of_classes = errors
        np.matmul(of_classes, out[1][:H].T, out=db)
        classes += of_classes.T @ S
        for c, part in parts:
            words[c] += e[part].T @ S[part]
            db[part] += e[part] @ out[0][c, :H].T
    g = {"Wo": words[:, :, :H].transpose(0, 2, 1), "bo": words[:, :, H]}
    g["Wc"], g["bc"] = classes[:, :H].T, classes[:, H]
    d_states = np.take(dS, places.back, axis=0).reshape(T, B, H)

    # The recurrence backwards; gradients of its weights come from the whole window at once.
    d_gates = np.empty((T, B, 3 * H), dtype=dtype)
    dh = np.zeros((B, H), dtype=dtype)
    Uzr, Uc = np.ascontiguousarray(p["Uzr"].T), np.ascontiguousarray(p["Uc"].T)
    for t in range(T - 1, -1, -1):
        (z, r, c), d = gates[:, t], d_gates[t]
        dh += d_states[t]
        part = dh * z
        dh -= part
        x = c * c
        np.subtract(1, x, out=x)
        back = np.multiply(x, part, out=d[:, 2 * H :]) @ Uc
        part *= np.subtract(c, before[t], out=x)
        np.multiply(np.subtract(1, z, out=x), part, out=d[:, :H])
        np.subtract(1, r, out=x)
        x *= gated[t]
        np.multiply(x, back, out=d[:, H : 2 * H])
        back *= r
        dh += back
        dh += d[:, : 2 * H] @ Uzr
        dh *= keeps[t]
    d_gates = d_gates.reshape(T * B, 3 * H)
    g["Uzr"] = before.reshape(T * B, H).T @ d_gates[:, : 2 * H]
    g["Uc"] = gated.reshape(T * B, H).T @ d_gates[:, 2 * H :]
    d = places.summed(d_gates)
    g["b"] = d.sum(axis=0)
    g["Wx"] = p["E"][places.ids].T @ d
    g["E"] = np.zeros_like(p["E"])
    g["E"][places.ids] = d @ p["Wx"].T
    return loss, g, states[-1]


def unigram_biases(p, id_counts: np.ndarray) -> None:
    """Output biases set to the smoothed frequencies of the ids: training starts at the unigram model."""
    n_ids = len(id_counts)
    mass = id_counts + SMOOTH
    n_classes = p["bc"].shape[0]
    padded = np.zeros(n_classes * CLASS_SIZE)
    padded[:n_ids] = mass
    by_class = padded.reshape(n_classes, CLASS_SIZE)
    p["bc"] = np.log(by_class.sum(axis=1) / mass.sum())
    p["bo"] = np.log(np.maximum(by_class, 1e-30) / by_class.sum(axis=1, keepdims=True))


def _stream(docs: list[np.ndarray]):
    """The documents one after another: inputs, targets and where each document starts."""
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.cumsum(sizes) - sizes
    tgt = np.full(int(sizes.sum()), END, dtype=np.int32)
    is_word = np.ones(len(tgt), dtype=bool)
    is_word[starts + sizes - 1] = False
    tgt[is_word] = np.concatenate(docs)
    inp = np.concatenate(([END], tgt[:-1])).astype(np.int32)
    reset = np.zeros(len(tgt), dtype=np.float32)
    reset[starts] = 1
    return inp, tgt, reset


class Trainer:
    """Adam over groups of documents, each group laid out as lanes of equal length.

    A lane is a stretch of the documents one after another; where it cuts a document, the rest is
    trained from a zero state fed the token before it.
    """

    def __init__(self, p, n_ids: int):
        self.flat = np.concatenate([v.reshape(-1) for v in p.values()]).astype(np.float32)
        self.p = _unflat(self.flat, p)
        self.n_ids = n_ids
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.steps = 0
        self.tokens = 0

    def fit(self, docs: list[np.ndarray], passes: int = 1) -> None:
        if not docs:
            return
        inp, tgt, reset = _stream(docs)
        n = len(inp)
        lanes = max(8, min(LANES, n // LANE_TOKENS))
        length = -(-n // lanes)
        weight = np.ones(n, dtype=np.float32)

        def laid(x):
            return np.ascontiguousarray(np.pad(x, (0, lanes * length - n)).reshape(lanes, length).T)

        inp, tgt, reset, weight = laid(inp), laid(tgt), laid(reset), laid(weight)
        windows = [slice(start, start + WINDOW) for start in range(0, length, WINDOW)]
        # Kept from pass to pass, but not for a text far longer than a group.
        places: list[Places | None] = [None] * len(windows)
        if n <= 2 * GROUP_TOKENS:
            places = [Places(inp[sl], tgt[sl], len(self.p["bc"])) for sl in windows]
        for _ in range(passes):
            h = np.zeros((lanes, HIDDEN), dtype=np.float32)
            for sl, at in zip(windows, places):
                _, g, h = loss_and_grads(
                    self.p, inp[sl], tgt[sl], reset[sl], weight[sl], h, self.n_ids, at, with_loss=False
                )
                self._update(g)
            self.tokens += n

    def _update(self, g) -> None:
        b1, b2 = 0.9, 0.999
        g = np.concatenate([g[name].reshape(-1) for name in self.p])
        g *= min(1.0, 5.0 / (math.sqrt(float(g @ g)) + 1e-12))
        self.steps += 1
        rate = RATE * math.sqrt(1 - b2**self.steps) / (1 - b1**self.steps)
        self.m *= b1
        self.m += (1 - b1) * g
        np.multiply(g, g, out=g)
        g *= 1 - b2
        self.v *= b2
        self.v += g
        np.sqrt(self.v, out=g)
        g += 1e-8
        np.divide(self.m, g, out=g)
        g *= rate
        self.flat -= g


def output_log_probs(states: np.ndarray, at: np.ndarray, targets: np.ndarray, weights) -> np.ndarray:
    """Natural log of P(target | state) for many rows at once, those at `at`: a matmul per class and block."""
    order, blocks = _by_class(targets, len(weights[0]))
    found = np.empty(len(order), dtype=states.dtype)
    rows = _with_one(states, at[order])
    for start, end, parts, *own in blocks:
        logits = _logits(rows[start:end], weights, parts)
        block = found[start:end]
        block[...] = sum(np.take(e, place) for e, place in zip(logits, own))
        for e in logits:
            block -= np.log(_exp(e))
    out = np.empty_like(found)
    out[order] = found
    return out


def score_ids(p, docs: list[np.ndarray], n_ids: int, n_lanes: int = SCORE_LANES, steps: int = 32) -> np.ndarray:
    """Natural log probability of each id sequence followed by the end token.

    Documents are dealt to lanes, longest first, to the least loaded; the lanes run side by side
    `steps` or more at a time and a lane leaves the matrix when it ends, so memory follows the tokens,
    not the longest document times the lanes. Only the recurrence runs step by step (inputs
    projected once per id); the output softmax of a whole stretch of steps is computed after it.
    """
    out = np.zeros(len(docs))
    if not docs:
        return out
    q = {k: v.astype(np.float32) for k, v in p.items()}
    H = HIDDEN
    tables = _gate_tables(q)
    weights = _output_weights(q, n_ids)
    sizes = np.array([len(d) + 1 for d in docs])
    n_lanes = min(n_lanes, len(docs))
    members: list[list[int]] = [[] for _ in range(n_lanes)]
    least = [(0, j) for j in range(n_lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, j = least[0]
        members[j].append(i)
        heapq.heapreplace(least, (load + int(sizes[i]), j))
    loads = np.array([load for load, _ in sorted(least, key=lambda x: x[1])])
    order = np.argsort(-loads, kind="stable")
    loads = loads[order]
    # The lanes one after another, longest first; a lane is read at its own start plus the step.
    dealt = [i for j in order.tolist() for i in members[j]]
    inp, tgt, reset = _stream([docs[i] for i in dealt])
    owner = np.repeat(np.array(dealt), sizes[dealt])
    starts = np.cumsum(loads) - loads
    h = np.zeros((n_lanes, H), dtype=np.float32)
    t0 = 0
    while t0 < loads[0]:
        k = int(np.searchsorted(-loads, -t0))
        h = h[:k]
        # The fewer lanes are left, the longer the stretch.
        width = min(max(steps, SCORE_ROWS // k), int(loads[0]) - t0)
        step = t0 + np.arange(width)[:, None]
        live = step < loads[None, :k]
        at = np.where(live, starts[None, :k] + step, 0)
        states = _recur(q, tables, h, inp[at], (1 - reset[at])[..., None])[0]
        h = states[-1]
        live = np.flatnonzero(live)
        at = at.reshape(-1)[live]
        lp = output_log_probs(states.reshape(-1, H), live, tgt[at], weights)
        out += np.bincount(owner[at], weights=lp, minlength=len(docs))
        t0 += width
    return out


# ---------------------------------------------------------------- the Spark job


class Vocabulary:
    """Ids of the known words, by rank: 2 and up; the first `n_ids` are those of the model."""

    def __init__(self, ranked: list[tuple[bytes, int]], n_docs: int, n_words: int, v_words: int):
        self.words = pa.array([bytes(w) for w, _ in ranked], type=pa.large_binary())
        self.n_ids = min(len(ranked), VOCAB) + 2
        self.counts = np.zeros(len(ranked) + 2)
        self.counts[END] = n_docs
        self.counts[2:] = [c for _, c in ranked]
        own = self.counts[2 : self.n_ids].sum()
        self.n_unk, self.v_unk = n_words - int(own), v_words - (self.n_ids - 2)
        # N, V, the denominator of the base score, and the one of an unknown word.
        self.big_n = n_words + n_docs
        self.denominator = self.big_n + SMOOTH * (v_words + (1 if n_docs else 0) + 1)
        self.unk_share = self.n_unk + SMOOTH * (self.v_unk + 1)

    def model_counts(self) -> np.ndarray:
        counts = self.counts[: self.n_ids].copy()
        counts[UNK] = self.n_unk
        return counts

    def encode(self, words: pa.ChunkedArray) -> np.ndarray:
        """Id of each word; UNK beyond the known words."""
        rank = pc.index_in(words, value_set=self.words)
        return pc.fill_null(rank, UNK - 2).to_numpy() + np.int32(2)

    def model_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_ids, ids, UNK).astype(np.int16)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    row = "_lm_row"
    held = F.coalesce(crc_class("doc_id", FOLDS) == 0, F.lit(True))
    base = with_row(docs.select("doc_id", "text"), row).select(
        row,
        F.col("doc_id").cast("long").alias("doc_id"),
        held.alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    training = base.filter(~F.col("held_out"))
    batch_conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_conf)
    spark.conf.set(batch_conf, str(BATCH_ROWS))
    try:
        counts = stored(
            training.select("text").mapInArrow(_count_words, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")),
            "lm-counts",
        )
        n_docs = training.count()
        totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        vocabulary = Vocabulary(_frequent(counts), n_docs, int(totals["n"]), int(totals["v"]))
        known = spark.sparkContext.broadcast(vocabulary)
        model = _fit(training, row, known)
        scored = stored(
            base.mapInArrow(
                _scorer(spark.sparkContext.broadcast(model), known, row),
                f"{row} {base.schema[row].dataType.simpleString()}, doc_id long, held_out boolean, "
                "n_tokens long, known_known long, known_base double, known_model double, "
                "words array<binary>, times array<bigint>",
            ),
            "lm-scored",
        )
    finally:
        spark.conf.set(batch_conf, before)
    rare = (
        scored.select(row, F.inline(F.arrays_zip("words", "times")))
        .select(row, F.col("words").alias("word"), F.col("times").alias("k"))
        .join(counts, "word", "left")
        .select(row, "k", F.coalesce("c", F.lit(0)).alias("c"))
        .groupBy(row)
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("k") * F.log((F.col("c") + SMOOTH) / F.lit(vocabulary.denominator))).alias("rare_base"),
            F.sum(F.col("k") * F.log((F.col("c") + SMOOTH) / F.lit(vocabulary.unk_share))).alias("rare_model"),
        )
    )
    return scored.join(rare, row, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.big_n).cast("long").alias("train_tokens"),
        ((F.col("known_base") + F.coalesce("rare_base", F.lit(0.0))) / LOG10).alias("base_score"),
        ((F.col("known_model") + F.coalesce("rare_model", F.lit(0.0))) / LOG10).alias("score"),
    )


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts in UTF-8, text after text, and how many each text has.

    The ASCII kernels change A-Z alone and split on the blank and 09 to 0D alone, byte by byte.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    parts = pc.ascii_split_whitespace(texts.view(pa.large_string()))
    # Lower-cased after the split: `ascii_lower` misreads an array cut out of another (pyarrow 23).
    words = pc.ascii_lower(parts.flatten()).view(pa.large_binary())
    # White space at either end of a text leaves an empty part there.
    filled = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return words.filter(filled), np.diff(before[parts.offsets.to_numpy()])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.ChunkedArray, np.ndarray]]:
    """Rows of a task (all but the text), the words of their texts and how many each has, gathered
    to about GROUP_TOKENS tokens or GROUP_BYTES bytes; a longer text ends its group."""
    rows, words, sizes, tokens, volume = [], [], [], 0, 0
    for batch in batches:
        others = batch.select([name for name in batch.schema.names if name != "text"])
        text = batch.column("text")
        found, counts = _split(text)
        n_words = np.concatenate(([0], np.cumsum(counts)))
        n_tokens = n_words + np.arange(len(n_words))
        n_bytes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)))
        start = 0
        while start < len(counts):
            stop = min(
                int(np.searchsorted(n_tokens, n_tokens[start] + GROUP_TOKENS - tokens)),
                int(np.searchsorted(n_bytes, n_bytes[start] + GROUP_BYTES - volume)),
                len(counts),
            )
            rows.append(others.slice(start, stop - start))
            words.append(found.slice(n_words[start], n_words[stop] - n_words[start]))
            sizes.append(counts[start:stop])
            tokens += int(n_tokens[stop] - n_tokens[start])
            volume += int(n_bytes[stop] - n_bytes[start])
            if tokens >= GROUP_TOKENS or volume >= GROUP_BYTES:
                yield pa.Table.from_batches(rows), pa.chunked_array(words), np.concatenate(sizes)
                rows, words, sizes, tokens, volume = [], [], [], 0, 0
            start = stop
    if sizes:
        yield pa.Table.from_batches(rows), pa.chunked_array(words), np.concatenate(sizes)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts with counts, a word once for each group it is in."""
    for _, words, _ in _groups(batches):
        counted = pc.value_counts(words)
        yield pa.record_batch([counted.field("values").cast(pa.binary()), counted.field("counts")], ["word", "c"])


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The VOCAB most frequent words and more of the next, KNOWN at most, ranked by (c desc, word)."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    per_level = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    lowest, room = None, KNOWN
    for r in sorted(per_level, reverse=True):
        if r["words"] > room:
            break
        lowest, room = r["level"], room - r["words"]
    found = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), F.asc("word")).limit(VOCAB).collect()}
    if lowest is not None:
        found.update((bytes(r["word"]), r["c"]) for r in counts.filter(level >= lowest).toLocalIterator())
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def _fit(training: DataFrame, row: str, known) -> dict[str, np.ndarray]:
    """The model trained on all training rows, each EPOCHS times in one round, in parallel over the tasks.

    Every task sends its model cut into PIECES; the pieces are averaged apart, weighted by the
    tokens of the tasks, and only the averages reach the driver.
    """
    spark = training.sparkSession
    vocabulary = known.value
    model = init_model(vocabulary.n_ids)
    unigram_biases(model, vocabulary.model_counts())
    if vocabulary.big_n == 0:
        return model
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col(row)), F.lit(sum(ROUNDS)))
    low = 0
    for share in ROUNDS:
        shared = spark.sparkContext.broadcast(model)
        rows = training.filter((part >= low) & (part < low + share))
        low += share
        pieces = (
            rows.select("text", F.spark_partition_id().alias("task"))
            .mapInPandas(_trainer(shared, known, EPOCHS), "piece int, task int, tokens long, value binary")
            .groupBy("piece")
            .applyInPandas(_average, "piece int, value binary")
            .collect()
        )
        if pieces:
            flat = np.concatenate([np.frombuffer(r["value"]) for r in sorted(pieces, key=lambda r: r["piece"])])
            model = _unflat(flat, model)
        shared.unpersist()
    return model


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(v.shape) for (k, v), part in zip(like.items(), np.split(flat, ends[:-1]))}


def _trainer(shared, known, epochs: int):
    """A function that trains the shared model on the rows of a task and gives it in pieces."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = known.value
        trainer, task = Trainer(shared.value, vocabulary.n_ids), 0
        for rows, words, sizes in _groups(map(_as_batch, batches)):
            docs = np.split(vocabulary.model_ids(vocabulary.encode(words)), np.cumsum(sizes)[:-1])
            task = rows["task"][0].as_py()
            trainer.fit(docs, epochs)
        if trainer.tokens:
            pieces = np.array_split(trainer.flat, PIECES)
            values = [x.tobytes() for x in pieces]
            yield pd.DataFrame({"piece": range(PIECES), "task": task, "tokens": trainer.tokens, "value": values})

    return train


def _as_batch(pdf: pd.DataFrame) -> pa.RecordBatch:
    return pa.record_batch({"text": pa.array(pdf["text"], type=pa.large_binary()), "task": pa.array(pdf["task"])})


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """One piece of the tasks' models averaged by their tokens, in the order of the tasks."""
    pdf = pdf.sort_values("task")
    total = 0.0
    for tokens, value in zip(pdf["tokens"], pdf["value"]):
        total = total + tokens * np.frombuffer(value, dtype=np.float32).astype(np.float64)
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "value": [(total / pdf["tokens"].sum()).tobytes()]})


def _scorer(model, known, row: str):
    """A function that scores the rows of a task; words beyond the known ones are left to a join."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = known.value, model.value
        base_log = np.log((vocabulary.counts + SMOOTH) / vocabulary.denominator)
        # A known word without an id of the model's own has its share of the unknown id.
        share_log = np.log((vocabulary.counts + SMOOTH) / vocabulary.unk_share)
        share_log[: vocabulary.n_ids] = 0.0
        base_log[UNK] = 0.0
        is_known = np.ones(len(base_log), dtype=np.int64)
        is_known[UNK] = 0
        is_known[END] = int(vocabulary.counts[END] > 0)
        for rows, words, sizes in _groups(batches):
            ids = vocabulary.encode(words)
            ends = np.cumsum(sizes)
            model_log = score_ids(p, np.split(vocabulary.model_ids(ids), ends[:-1]), vocabulary.n_ids)
            # Every document with its end token, so that none is empty.
            tokens = np.insert(ids, ends, END)
            starts = ends - sizes + np.arange(len(sizes))
            unknown = ids == UNK
            owner = np.repeat(np.arange(len(sizes)), sizes)[unknown]
            yield pa.record_batch(
                {
                    row: _nullable(rows[row].combine_chunks()),
                    "doc_id": rows["doc_id"].combine_chunks(),
                    "held_out": rows["held_out"].combine_chunks(),
                    "n_tokens": sizes + 1,
                    "known_known": np.add.reduceat(is_known[tokens], starts),
                    "known_base": np.add.reduceat(base_log[tokens], starts),
                    "known_model": model_log + np.add.reduceat(share_log[tokens], starts),
                    **_unknown(words.filter(pa.array(unknown)), owner, len(sizes)),
                }
            )

    return score


def _nullable(column: pa.Array) -> pa.Array:
    """A column whose fields, if it is a struct, may be null, as in the schema Spark expects."""
    if not pa.types.is_struct(column.type):
        return column
    return column.cast(pa.struct([pa.field(f.name, f.type) for f in column.type]))


def _unknown(words: pa.ChunkedArray, owner: np.ndarray, n_rows: int) -> dict[str, pa.Array]:
    """Lists of the distinct words of each row and of their numbers; owner is the row of each word."""
    coded = words.combine_chunks().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary())
    pairs, times = np.unique(owner * max(len(distinct), 1) + coded.indices.to_numpy(), return_counts=True)
    owner, code = np.divmod(pairs, max(len(distinct), 1))
    offsets = pa.array(np.searchsorted(owner, np.arange(n_rows + 1)), type=pa.int32())
    return {
        "words": pa.ListArray.from_arrays(offsets, distinct.take(pa.array(code))),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times, type=pa.int64())),
    }
