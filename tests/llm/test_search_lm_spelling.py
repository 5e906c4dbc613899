"""Ranked search, language-model scores and spelling variants against brute force and edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyroute.llm import lexical_search, recurrent_lm, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", _lex_row string, term string, vec string, m string, _lm_row string, word string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _frame(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", "s", 0) + ("a", "b", "c", "d", "e", "f", "g") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA + CLASH).repartition(3)


# ---------------------------------------------------------------- op11


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _brute_search(docs, items, top=50):
    toks = [(d, _terms(t)) for d, t in docs]
    big_n = sum(1 for _, t in toks if t)
    big_l = sum(len(t) for _, t in toks)
    item_terms = collections.defaultdict(set)
    for i, t in items:
        item_terms[i] |= set(_terms(t))
    df = collections.Counter()
    for _, t in toks:
        df.update(set(t))
    out = []
    for item, terms in item_terms.items():
        scored = []
        for d, t in toks:
            if not t:
                continue
            m = 50 + (50 * len(t) * big_n) // big_l
            tf = collections.Counter(t)
            s = 0
            for term in terms:
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[term] + 1)))
                    s += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 20 * m))
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=lambda x: (x[0], x[1]))


def test_search_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "Gamma", "délta", "x1", "naïve", "ZETA", "eta", "THETA", "iota"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += [None, "", "   ", "!!! ???", texts[5], texts[5], texts[7], "alpha" * 5000]
    ids = list(range(len(texts)))
    ids[-2] = None  # a null id
    ids[-3] = 4  # a repeated id with another text
    items = [(0, "alpha beta"), (1, "Gamma? gamma!"), (2, None), (3, "naïve ZETA eta"), (3, "iota"), (4, "nothing here")]
    docs = _frame(spark, texts, ids)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(docs, bench, top=7).collect()
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got)
    want = _brute_search(list(zip(ids, texts)), items, top=7)
    # Equal (score, doc_id) rows may come in either order, which changes nothing shown.
    assert got == want


def test_search_empty_and_no_terms(spark):
    docs = _frame(spark, [])
    bench = spark.createDataFrame([(0, "alpha")], "item_id long, text string")
    assert lexical_search.search(docs, bench).count() == 0
    docs = _frame(spark, [None, "", "..."])
    assert lexical_search.search(docs, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(_frame(spark, ["alpha"]), none).count() == 0


def test_search_hot_copies_keep_smallest_ids(spark):
    texts = ["alpha beta"] * 300 + ["alpha"] * 3 + ["beta gamma"] * 10
    docs = _frame(spark, texts, list(range(1000, 1000 + len(texts))))
    bench = spark.createDataFrame([(0, "alpha")], "item_id long, text string")
    rows = sorted(lexical_search.search(docs, bench).collect(), key=lambda r: r["rank"])
    want = _brute_search(list(zip(range(1000, 1000 + len(texts)), texts)), [(0, "alpha")])
    assert [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows] == want
    assert len(rows) == 50


def test_term_counts_sort_without_a_comparator(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    counted = df.select(lexical_search._term_counts(df["t"]).alias("p"))
    assert "array_sort(" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted([tuple(x) for x in r["p"]] for r in counted.collect()) == [[], [("a", 1), ("b", 2)]]


# ---------------------------------------------------------------- op13


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def test_single_edits_matches_brute_force():
    rng = random.Random(5)
    base = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "àbcdef", "xyzxyz", "abcxef", "abdcef"]
    pool = base + ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(150)]
    pool = sorted(set(pool))
    got = spelling.single_edits(pool, pool)
    for i, a in enumerate(pool):
        for j, b in enumerate(pool):
            assert got[i, j] == _near(a, b), (a, b)


def _brute_variants(rows):
    cnt = collections.Counter()
    for d, t in rows:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            if d is not None:
                h = zlib.crc32(f"{d}:{r}".encode())
                if h % 199 == 0:
                    k = h % len(r)
                    r = r[:k] + r[k + 1 :]
            cnt[r] += 1
    words = {w: n for w, n in cnt.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [o for o in words if _near(w, o)]
        best = min(near, key=lambda o: (-words[o], o)) if near else None
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w].append(r)
    return out


def test_variants_match_brute_force(spark):
    texts = (
        ["bananas " * 125, "bananax " * 25, "bananaxy " * 5, "Orange orangé ORANGES " * 6]
        + ["colour color colours colors " * 5, "recieve receive " * 5, "receive " * 30]
        + [None, "", "ab cd", "zzzzzzzzzzzz" * 1000, "bananas bananas"]
    )
    ids = list(range(len(texts)))
    ids[-1] = None
    docs = _frame(spark, texts, ids)
    got = {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in spelling.variants(docs).collect()}
    want = _brute_variants(list(zip(ids, texts)))
    assert got == want
    assert got["bananaxy"][4] == "bananas"


def test_variants_hot_block_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 400)  # tiles of a few words: a block becomes many tile pairs
    words_ = ["abcdef" + chr(ord("a") + i) for i in range(26)] + ["abcdef", "abcdeg", "abcdfg"]
    texts = [" ".join(words_) for _ in range(5)] + ["abcdef " * 40]
    got = {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in spelling.variants(_frame(spark, texts)).collect()}
    assert got == _brute_variants(list(enumerate(texts)))


def test_variants_empty(spark):
    assert spelling.variants(_frame(spark, [])).count() == 0


# ---------------------------------------------------------------- op12


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    n_ids = 150
    p = recurrent_lm.init_model(n_ids, 3)
    T, B = 5, 3
    inp, tgt = rng.integers(0, n_ids, (T, B)), rng.integers(0, n_ids, (T, B))
    reset = np.zeros((T, B))
    reset[2, 1] = 1
    w = np.ones((T, B))
    w[4, 2] = 0
    h0 = rng.normal(0, 0.5, (B, recurrent_lm.HIDDEN))
    _, g, _ = recurrent_lm.loss_and_grads(p, inp, tgt, reset, w, h0, n_ids)
    for k in p:
        for _ in range(4):
            idx = tuple(int(rng.integers(0, s)) for s in p[k].shape)
            if k == "E":
                idx = (int(inp[0, 0]),) + idx[1:]
            old = p[k][idx]
            p[k][idx] = old + 1e-5
            up = recurrent_lm.loss_and_grads(p, inp, tgt, reset, w, h0, n_ids)[0]
            p[k][idx] = old - 1e-5
            down = recurrent_lm.loss_and_grads(p, inp, tgt, reset, w, h0, n_ids)[0]
            p[k][idx] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k][idx], rel=1e-4, abs=1e-8)


def test_scoring_carries_state_across_lanes():
    p = recurrent_lm.init_model(20, 1)
    docs = [np.array([2, 3, 4, 5] * 50), np.array([], dtype=np.int64), np.array([7, 7])]
    together = recurrent_lm.score_ids(p, docs, 20, n_lanes=2)
    alone = [recurrent_lm.score_ids(p, [d], 20, n_lanes=1)[0] for d in docs]
    assert together == pytest.approx(alone)


def test_lm_scores_base_and_edge_cases(spark):
    rng = random.Random(9)
    vocab = ["the", "cat", "The", "dog", "ran", "fast", "slowly", "a", "b"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "\t\n", "unseen words only zq", "word " * 30_000, texts[3]]
    ids = list(range(len(texts)))
    ids[-1] = None
    docs = _frame(spark, texts, ids)
    got = {(r["doc_id"], i): r for i, r in enumerate(recurrent_lm.scores(docs).collect())}
    assert len(got) == len(texts)
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d in ids]
    toks = [(t or "").translate(LOWER).split() for t in texts]
    counts = collections.Counter()
    n_docs = 0
    for tk, h in zip(toks, held):
        if not h:
            counts.update(tk)
            n_docs += 1
    big_n, big_v = sum(counts.values()) + n_docs, len(counts) + 1
    by_id = collections.defaultdict(list)
    for r in got.values():
        by_id[r["doc_id"]].append(r)
    for d, tk, h in zip(ids, toks, held):
        base = sum(math.log10((counts[w] + 0.1) / (big_n + 0.1 * (big_v + 1))) for w in tk)
        base += math.log10((n_docs + 0.1) / (big_n + 0.1 * (big_v + 1)))
        rows = by_id[d]
        assert any(r["base_score"] == pytest.approx(base, rel=1e-9) for r in rows)
        r = rows[0]
        assert r["held_out"] == h and r["train_tokens"] == big_n
        assert any(x["n_tokens"] == len(tk) + 1 for x in rows)
        assert math.isfinite(r["score"]) and r["score"] < 0
    empty = recurrent_lm.scores(_frame(spark, []))
    assert empty.count() == 0


def test_lm_learns_from_every_training_row(spark, monkeypatch):
    # A bound on sampled training tokens, as there once was, must have no say.
    monkeypatch.setattr(recurrent_lm, "TRAIN_TOKENS", 1, raising=False)
    rows = [(i, "left right " * 300) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = recurrent_lm.scores(docs).collect()
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in got]
    assert min(gain) > 0.2  # a pair that takes turns is near certain; counts alone give 0.3 less a word
    counts = collections.Counter({b"left": 5, b"right": 5})
    vocabulary = recurrent_lm.Vocabulary(sorted(counts.items()), 4, 10, 2)
    shared, known = (type("Shared", (), {"value": v}) for v in (recurrent_lm.init_model(4), vocabulary))
    import pandas as pd

    texts = [pd.DataFrame({"text": [b"left right", None, b"x " * 50], "task": 0}) for _ in range(3)]
    pieces = pd.concat(recurrent_lm._trainer(shared, known, 1)(iter(texts)))
    assert set(pieces["tokens"]) == {3 * (3 + 1 + 51)} and len(pieces) == recurrent_lm.PIECES
    averaged = recurrent_lm._average(pieces[pieces["piece"] == 0])
    assert np.frombuffer(averaged["value"][0]) == pytest.approx(np.frombuffer(pieces["value"].iloc[0], dtype=np.float32))


def test_lm_passes_do_not_depend_on_the_size_of_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(i, b"left right " * (i % 7)) for i in range(40)], "at bigint, text binary").repartition(2)
    plain, passes = recurrent_lm._trainer, []

    def noted(shared, known, epochs):
        passes.append(epochs)
        return plain(shared, known, epochs)

    monkeypatch.setattr(recurrent_lm, "_trainer", noted)
    for n_words in (20, 2_000_000_000):
        passes.clear()
        vocabulary = recurrent_lm.Vocabulary([(b"left", n_words // 2), (b"right", n_words // 2)], 40, n_words, 2)
        recurrent_lm._fit(docs, "at", spark.sparkContext.broadcast(vocabulary))
        assert passes == [recurrent_lm.EPOCHS] * len(recurrent_lm.ROUNDS)


def test_lm_blocks_and_kept_places_do_not_change_the_model(monkeypatch):
    rng = np.random.default_rng(2)
    n_ids = 200
    ids = np.minimum(rng.zipf(1.3, (16, 40)), n_ids) - 1
    places = recurrent_lm.Places(ids, ids, 4)
    values = rng.normal(size=(ids.size, 5))
    want = np.zeros((n_ids, 5))
    np.add.at(want, ids.reshape(-1), values)
    assert len(places.alone) > 1 and len(places.turns) > 1
    assert sorted(places.ids) == sorted(set(ids.reshape(-1)))
    assert places.summed(values) == pytest.approx(want[places.ids])

    p = recurrent_lm.init_model(n_ids, 5)
    p["bo"][1, 7] = p["bc"][2] = 500.0  # exp needs a shift here
    args = p, ids, np.roll(ids, -1), np.zeros(ids.shape), np.ones(ids.shape), np.zeros((40, recurrent_lm.HIDDEN)), n_ids
    loss, whole, h = recurrent_lm.loss_and_grads(*args)
    monkeypatch.setattr(recurrent_lm, "BLOCK_ROWS", 9)
    parts = recurrent_lm.loss_and_grads(*args)
    assert math.isfinite(loss) and parts[0] == pytest.approx(loss) and parts[2] == pytest.approx(h)
    assert all(parts[1][k] == pytest.approx(whole[k], abs=1e-12) for k in p)

    docs = [rng.integers(0, n_ids, n) for n in (0, 3, 500, 40)]
    kept, once = (recurrent_lm.Trainer(recurrent_lm.init_model(n_ids), n_ids) for _ in range(2))
    kept.fit(docs, 3)
    monkeypatch.setattr(recurrent_lm, "GROUP_TOKENS", 1)
    for _ in range(3):
        once.fit(docs)
    assert kept.tokens == once.tokens == 3 * 547 and (kept.flat == once.flat).all()


def test_lm_words_split_in_arrow_match_python():
    import pyarrow as pa

    texts = [b" A\tb\nC\x0bd\x0ce\r ", None, b"", b"  ", "É\u00a0À\u2003x \u0085y".encode(), b"x\x1cy\x00z \xff\xfeQ [Z]"]
    texts += [bytes(random.Random(i).choices(b" \t\n\x0b\x0c\r\x1c\x1f@AZ[az\xc3\x85", k=200)) for i in range(20)]
    want = [(t or b"").lower().split() for t in texts]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([b"left out", *texts], type=kind).slice(1)
        words, sizes = recurrent_lm._split(column)
        assert sizes.tolist() == [len(t) for t in want]
        assert words.to_pylist() == [w for t in want for w in t]
    assert recurrent_lm._split(pa.array([], type=pa.binary()))[1].tolist() == []


def test_lm_words_looked_up_by_group_not_by_document(monkeypatch):
    import pandas as pd

    counts = collections.Counter({b"left": 5, b"right": 5})
    vocabulary = recurrent_lm.Vocabulary(sorted(counts.items()), 4, 10, 2)
    shared, known = (type("Shared", (), {"value": v}) for v in (recurrent_lm.init_model(4), vocabulary))
    calls = []
    plain = recurrent_lm.Vocabulary.encode
    monkeypatch.setattr(recurrent_lm.Vocabulary, "encode", lambda self, w: calls.append(len(w)) or plain(self, w))

    def lookups():
        calls.clear()
        frames = [pd.DataFrame({"text": [b"left right", None, b"x left", b""] * 10, "task": 0}) for _ in range(3)]
        pieces = pd.concat(recurrent_lm._trainer(shared, known, 1)(iter(frames)))
        assert set(pieces["tokens"]) == {3 * 10 * (3 + 1 + 3 + 1)}
        return list(calls)

    assert lookups() == [120]
    monkeypatch.setattr(recurrent_lm, "GROUP_TOKENS", 100)  # cut inside a frame, after the text that reaches it
    assert lookups() == [50, 50, 20]
    monkeypatch.setattr(recurrent_lm, "GROUP_BYTES", 16)  # two words of each kind of text
    assert lookups() == [4] * 30 + [0]  # the last text is empty


def test_lm_groups_do_not_change_what_is_known_of_a_document(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    texts = [b" ".join(rng.choices([b"a", b"b", b"x", b"y"], k=rng.randint(0, 12))) for _ in range(60)]
    ranked = [(b"a", 9), (b"b", 4)]
    vocabulary = recurrent_lm.Vocabulary(ranked, 5, 15, 4)
    shared, known = (type("Shared", (), {"value": v}) for v in (recurrent_lm.init_model(4), vocabulary))
    batch = pa.record_batch(
        {
            "at": pa.array([{"file": 1, "at": i} for i in range(60)]),
            "doc_id": pa.array(range(60)),
            "held_out": pa.array([False] * 60),
            "text": pa.array(texts, type=pa.binary()),
        }
    )
    for tokens in (1_000_000, 50, 1):
        monkeypatch.setattr(recurrent_lm, "GROUP_TOKENS", tokens)
        parts = list(recurrent_lm._scorer(shared, known, "at")(iter([batch.slice(0, 25), batch.slice(25)])))
        assert len(parts) == 1 if tokens > 1000 else len(parts) > 5
        rows = pa.Table.from_batches(parts).to_pylist()
        assert [r["at"]["at"] for r in rows] == [r["doc_id"] for r in rows] == list(range(60))
        if tokens > 1000:
            whole = rows
        for r, text, w in zip(rows, texts, whole):
            words = text.split()
            n = collections.Counter(words)
            assert r["n_tokens"] == len(words) + 1 and r["known_known"] == n[b"a"] + n[b"b"] + 1
            assert dict(zip(r["words"], r["times"])) == {x: n[x] for x in (b"x", b"y") if n[x]}
            base = sum(k * math.log((c + 0.1) / vocabulary.denominator) for k, c in ((n[b"a"], 9), (n[b"b"], 4), (1, 5)))
            assert r["known_base"] == pytest.approx(base)
            assert r["known_model"] == pytest.approx(w["known_model"], rel=1e-5)


def test_lm_rare_words_match_brute_force(spark, monkeypatch):
    # Most words lie beyond the broadcast ones.
    monkeypatch.setattr(recurrent_lm, "KNOWN", 40)
    monkeypatch.setattr(recurrent_lm, "VOCAB", 20)
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", " once  once\tnever-seen "]
    ids = [*range(len(texts) - 1), next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)]
    toks = [(t or "").split() for t in texts]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in ids]
    counts = collections.Counter(w for t, kept in zip(toks, train) if kept for w in t)
    n_docs = sum(train)
    under = sum(counts.values()) + n_docs + 0.1 * (len(counts) + 2)
    got = {r["doc_id"]: r for r in recurrent_lm.scores(_frame(spark, texts, ids)).collect()}
    for i, words in zip(ids, toks):
        base = sum(math.log10((c + 0.1) / under) for c in [*(counts[w] for w in words), n_docs])
        assert got[i]["n_tokens"] == len(words) + 1
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0
