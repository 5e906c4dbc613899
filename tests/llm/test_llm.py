"""Every operator on small tables: brute force, edge cases, empty tables, clashing columns."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyroute.llm import (
    balance,
    bktree,
    bpe,
    curves,
    decision_list,
    pii,
    pu_quality,
    secret_scan,
    toxicity,
    url_trees,
)
from tallyroute.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", score double, row string, size string, fp string, rank string, _row string, spans string"
LONG = " ".join(f"w{i % 900}x{i}" for i in range(20_000))
BAD = "buy### now$$$ cheap%%% buy### now$$$ cheap%%% win&&& " * 4
TEXTS = [
    "the cat sat on the mat and looked at the dog near the door",
    "the cat sat on the mat and looked at the dog near the door",
    "THE CAT sat on the mat and looked at the dog near the door",
    None, "", " \t\n ", LONG, BAD, BAD, "a b c d e a b c d e a b c d e f",
    'mail jo.1@mail.example.com from 10.2.3.4 or +1 (555) 555-0199 token = "abcdef0123456789abcdef"',
    "one two", "you are an 1d10t and a l0s3r", "line\nline\n\nother line\nline",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, None, None), (3, "second row of an id", "en", "s0", 1), rows[0]]
    clash = [r + (0.5, "x", "y", "z", "k", "m", "n") for r in rows]
    return spark.createDataFrame(clash, SCHEMA + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i not in (7, 8)), int(i == 12)) for i in range(14)] + [(None, 1, 1), (2, None, None)]
    return spark.createDataFrame(rows + [(5, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_bpe_matches_the_library(docs, none, spark):
    library = Tokenizer.from_file(bpe.default_path())
    odd = ["ΣΑΣ it's I'LL <|endoftext|>x", "aaaaaaa" * 9, "日本 ½ 😀!!", "é́ x\x1cy", "İ ﬁ"]
    more = spark.createDataFrame([(90 + i, t, "", "", 0) for i, t in enumerate(odd)], SCHEMA)
    every = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    expected = collections.Counter()
    for doc_id, text in texts_of(every):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        raw = np.array(ids, "<u4").tobytes()
        digests = hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()
        expected[(doc_id, len(ids), *digests)] += 1
    assert multiset(bpe.encode_documents(every).collect()) == expected
    assert bpe.encode_documents(none).count() == 0


def test_bpe_round_trip(docs, spark):
    ids = docs.select("text", bpe.token_ids(spark, F.col("text")).alias("ids"))
    back = ids.select("ids", bpe.decoded_text(spark, F.col("ids")).alias("back")).collect()
    library = Tokenizer.from_file(bpe.default_path())
    assert all(r.back == library.decode(list(r.ids), skip_special_tokens=False) for r in back)


def test_targets_share_out_and_stop():
    assert balance.targets_of({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    capped = balance.targets_of({"a": 10, "b": 100, "n": 10})
    assert capped["a"] == 30 and capped["b"] == 60 and capped["n"] == 30
    assert balance.targets_of({}) == {} and balance.targets_of({"a": 0}) == {"a": 0.0}


def test_mix_meets_targets(spark, docs, none):
    rows = [(i, "w " * (i % 40), "", f"s{i % 4}" if i % 7 else None, 0) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = balance.mix_report(table).toPandas()
    source = {i: s for i, _, _, s, _ in rows}
    assert len(out) == 600 and (out["taken"] <= 3 * out["size"]).all()
    for _, part in out.groupby(out["doc_id"].map(source).fillna("none")):
        assert part["size"].sum() == part["source_size"].iloc[0]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 2
    again = balance.mix_report(table.repartition(5)).toPandas()
    assert sorted(map(tuple, out[["doc_id", "taken"]].values)) == sorted(
        map(tuple, again[["doc_id", "taken"]].values)
    )
    mixed = balance.mix(table)
    assert mixed.columns == table.columns and mixed.count() == out["copies"].sum()
    assert balance.mix(docs).columns == docs.columns
    assert balance.mix_report(docs).count() == docs.count()
    assert balance.mix_report(none).count() == 0


def slow_print(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    windows = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, radius=2):
    """Smallest id reachable, by comparing all pairs."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates(docs, none):
    rows = texts_of(docs)
    prints = [slow_print(t) for _, t in rows]
    group = reach(prints)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = i if least.get(g) is None else min(x for x in (i, least[g]) if x is not None)
    expected = collections.Counter(
        (i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)
    )
    assert multiset(bktree.near_duplicates(docs).collect()) == expected
    kept = bktree.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert bktree.near_duplicates(none).count() == 0 and bktree.keep_one(none).count() == 0


@pytest.mark.parametrize("limit", [20_000, 15])
def test_split_shards_lose_no_link(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 12)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 62, 3)) for b in base for _ in range(25)})
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = bktree.links(table, 2, limit)
    found = {r.fp: r.component for r in bktree.components(edges).collect()}
    group = reach(prints)
    assert [found.get(p, p) for p in prints] == [prints[g] for g in group]


def test_tree_search_equals_all_pairs():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64))
    shard = np.sort(rng.integers(0, 3, len(prints)))
    found = {(a, b) for x, y in bktree.Forest(shard, prints).near(2) for a, b in zip(x.tolist(), y.tolist())}
    assert found == {
        (i, j) for i in range(len(prints)) for j in range(len(prints))
        if i != j and shard[i] == shard[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 2
    }


def test_hilbert_neighbours_touch():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    order = np.argsort(curves.hilbert(grid, 3))
    assert sorted(curves.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 1.0) for i in range(120)]
    rows += [(200 + i, rows[0][1], 1.0) for i in range(30)]
    rows += [(300, None, 1.0), (301, [0.0] * 8, 1.0), (302, [float("nan")] * 8, 1.0), (303, [1.0] * 3, 0.0), (304, [1.0, None] * 4, 0.0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score double")
    got = collections.defaultdict(list)
    for r in curves.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i < 300]
    for q, v in good:
        if q % 50 == 0:
            near = [(-np.dot(v, u) / np.sqrt(np.dot(v, v) * np.dot(u, u)), i) for i, u in good if i != q]
            near = sorted((round(s, 9), i) for s, i in near)[:5]
            assert got[q] == [(k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert set(got) == {0, 50, 100, 200}
    assert curves.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_window_reaches_recall(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = curves.nearest(table, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in got.index:
        s = unit @ unit[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * len(got)) >= 0.9


def test_quality_learns_from_positives(spark, sf_dir, docs, labels, none):
    out = QUERIES["op5_pu_quality"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = out.merge(known, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert pu_quality.quality_scores(docs, labels).count() == docs.count()
    assert pu_quality.quality_scores(none, labels).count() == 0
    unlearnt = pu_quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in unlearnt] == [0.5]
    assert pu_quality.accepted(docs, labels).columns == docs.columns


def test_prior_estimate():
    rng = np.random.default_rng(4)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 3000)
    unlabelled = np.concatenate([rng.normal(2, 1, 7000), n])
    assert abs(pu_quality.class_prior(p, unlabelled) - 0.7) < 0.05


def test_toxicity(spark, docs, labels, none):
    out = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = out.merge(known, on="doc_id").query("held_out")
    assert (held["predicted"] == held["toxic"]).mean() > 0.93
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count()
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_disguises_are_undone():
    names = ["idiot", "moron", "stupid", "loser", "trash"]
    model = toxicity.language_model(np.zeros((toxicity.SIZE,) * 3), dict.fromkeys(names, 1.0))
    judge = toxicity.Model(dict.fromkeys(names, 5.0), -2.0, model)
    import pandas as pd

    texts = ["you 1d10t", "m0r0n!", "stuuuupid", "a l o s e r here", "tr@sh", "clean words only", None, ""]
    hits = toxicity._hits_of(pd.Series(texts), judge)
    assert hits == [{"idiot"}, {"moron"}, {"stupid"}, {"loser"}, {"trash"}, set(), set(), set()]


def test_disguises_at_the_end_and_short_spaced_words():
    names = ["idiot", "worthless", "boob", "bum", "ass", "moron"]
    model = toxicity.language_model(np.zeros((toxicity.SIZE,) * 3), dict.fromkeys(names, 1.0))
    judge = toxicity.Model(dict.fromkeys(names, 5.0), -2.0, model)
    import pandas as pd

    texts = ["worthle$$", "w0rthle$$!!", "so idio+", "1d10+.", "b o o b", "a b u m", "b.u.m", "a$$", "moron!!", "m0ron(", "1d10t99999999", "over 2024!"]
    hits = toxicity._hits_of(pd.Series(texts), judge)
    assert hits[:6] == [{"worthless"}, {"worthless"}, {"idiot"}, {"idiot"}, {"boob"}, {"bum"}]
    assert hits[6:] == [{"bum"}, {"ass"}, {"moron"}, {"moron"}, {"idiot"}, set()]


def test_disguised_words_with_accents():
    names = ["réêou", "achlichü", "große", "дурак", "reeou"]
    model = toxicity.language_model(np.zeros((toxicity.SIZE,) * 3), dict.fromkeys(names, 1.0))
    judge = toxicity.Model({**dict.fromkeys(names, 5.0), "reeou": 1.0}, -2.0, model)
    import pandas as pd

    texts = ["r3êou", "r é ê o u", "achl1chü!", "gr0ße", "große", "reeou", "ддд.у.р.а.к", "досок.1", "ré.êou", "rrrréêou"]
    hits = toxicity._hits_of(pd.Series(texts), judge)
    assert hits[:6] == [{"réêou"}, {"réêou"}, {"achlichü"}, {"große"}, {"große"}, {"reeou"}]
    assert hits[6:] == [{"дурак"}, set(), {"réêou"}, {"réêou"}]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(6)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))

    def best(slots):
        paths = [((toxicity.EDGE, toxicity.EDGE), "", 0.0)]
        for slot in slots:
            paths = [
                (pair, word, cost + p) if s < 0 else
                ((pair[1], s), word + "abcdefghijklmnopqrstuvwxyz"[s], cost + p + model[pair[0], pair[1], s])
                for pair, word, cost in paths for s, p in slot
            ]
        return max(paths, key=lambda x: x[2] + model[x[0][0], x[0][1], toxicity.EDGE])[1]

    lattices = [toxicity.lattice(w) for w in ["1d10t", "s7up1d", "b@@d", "aaab", "x.y-z", "6o!"]]
    assert toxicity.decode(lattices, model) == [best(s) for s in lattices]


def test_personal_data(spark, docs, none):
    out = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    found = out[10]
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 0, 1)
    text = TEXTS[10]
    base = [
        f"{k}:{text.index(v)}:{text.index(v) + len(v)}"
        for k, v in (("email", "jo.1@mail.example.com"), ("ip", "10.2.3.4"), ("phone", "+1 (555) 555-0199"))
    ]
    assert found.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(found.spans.split(","))
    assert out[0].spans == "" and pii.personal_data(none).count() == 0


def test_pii_base_equals_patterns():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1.@+-( )9 52"), 50))
        slow = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            slow += [(1, *m.span())] * all(int(x) <= 255 for x in m.group().split("."))
        for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                    slow.append((kind, *m.span()))
        assert pii.base_spans(text) == slow


def test_field_finds_other_forms():
    texts = [f"please write to jo{i}.k@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{1000 + i} today" for i in range(150)]
    rows = [w for i, t in enumerate(texts) for w in pii.labelled_windows(t, i)]
    field = pii.fit(rows, epochs=40)
    asked = ["reach ann.7 (at) web.example.org for this", "my number is 482-555-7163 since May"]
    plain = ["on 2021-05-03 version 3.1 came out", "they sold 250 of 400"]
    got = pii.added_spans(asked + plain, [[]] * 4, field)
    assert [[s[0] for s in spans] for spans in got] == [[0], [3], [], []]
    short = np.array([pii._features("call 482-555-7163 now".split())])
    scores, moves = field.scores(short)[0], field.move
    best = max(
        np.ndindex(*[pii.LABELS] * 3),
        key=lambda y: field.start[y[0]] + scores[0][y[0]] + moves[y[0], y[1]] + scores[1][y[1]] + moves[y[1], y[2]] + scores[2][y[2]],
    )
    assert field.decode(short, np.array([3]))[0].tolist() == list(best)


def test_secrets(spark, docs, none):
    key = "a1b2c3d4e5f60718"
    rows = [
        (1, f"token = '{key}ff'", "", "s1", 0), (2, f"token = '{key}ff'", "", "s2", 0),
        (3, "bearer Zx9Qw8Er7Ty6Ui5Op4", "", "s1", 0), (4, "Bearer copied0Example1Value2x", "", "s1", 0),
        (5, "Bearer copied0Example1Value2x", "", "s2", 0), (6, "AKIA" + "B" * 16 + " x", "", None, 0),
    ]
    out = {r.doc_id: r for r in secret_scan.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[1].n_assign, out[1].n_hex, out[1].n_live) == (1, 1, 0) and out[1].n_copied == 2
    assert out[3].spans == "named:0:25" and out[3].n_live == 1
    assert out[4].spans == out[5].spans == "" and out[6].spans == "access:0:20"
    base = "assign:0:27,hex:9:27"
    assert out[1].spans == "assign:0:27,hex:9:27"
    assert out[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in secret_scan.mask_live(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert masked[3] == "bearer [SECRET]" and masked[6] == "[SECRET] x" and key in masked[1]
    assert secret_scan.mask_live(docs).columns == docs.columns
    assert secret_scan.secret_report(docs).count() == docs.count()
    assert secret_scan.secret_report(none).count() == 0


def test_decision_list(spark, docs, labels, none):
    out = decision_list.quality_rules(docs, labels).collect()
    expected = collections.Counter()
    for doc_id, text in texts_of(docs):
        w = words(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        expected[(doc_id, *counts, len(w) < 10 or 100 * len(twice) > 20 * len(w))] += 1
    assert multiset(r[:7] for r in out) == expected
    assert all(not (r.base_failed and r.kept) for r in out)
    assert decision_list.quality_rules(docs, labels.limit(0)).filter("rule is not null").count() == 0
    assert decision_list.quality_rules(none, labels).count() == 0


def test_rules_are_found(spark):
    rows = [(i, int(i % 4 > 0), 50.0, 4.0, 0.5 if i % 4 == 0 else 0.01 * (i % 3), 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(400)]
    table = spark.createDataFrame(rows, ["doc_id", "label", *decision_list.FEATURES])
    rules = decision_list.learn(table)
    assert len(rules) == 1 and [(c.feature, c.above) for c in rules[0]] == [("symbols", True)]


def test_url_rules_and_trees(spark):
    urls = [
        ("http://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://net", "net", "", None, None), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("https://b.example.com/de/9#t", "b.example.com", "/de/9", "example.com/de/", "block"),
        ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, None), ("http://h?q/en/", "h", "", None, None),
    ]
    rows = [(i, u[0], "<p>", "clash") for i, u in enumerate(urls)] + [(None, "http://x.org/fr/", None, "c")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")
    out = {r.page_id: r for r in url_trees.judged(table).collect()}
    assert len(out) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (verdict or out[i].verdict) and out[i].verdict in ("allow", "block")
    assert url_trees.judged(table.limit(0)).count() == 0


def test_trees_learn(spark):
    rows = [(float(i % 7), *[0.0] * (len(url_trees.FEATURES) - 1), "block" if i % 7 > 3 else "allow") for i in range(300)]
    table = spark.createDataFrame(rows, [*url_trees.FEATURES, "verdict"])
    start, trees = url_trees.boosted(table)
    margin = F.lit(start)
    for tree in trees:
        margin = margin + tree.expression()
    wrong = table.filter((margin > 0) != (F.col("verdict") == "block"))
    assert trees and wrong.count() == 0


@pytest.mark.parametrize("name", ["op1_url_trees", "op2_decision_list"])
def test_native_plans(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline(spark, sf_dir, docs):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table, columns = given, given.columns
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf_dir)
        if name != "tokens":
            assert table.columns == columns
        table = corpus_pipeline.stored(table, "test")
        assert table.count() > 0
    assert multiset(table.collect()) == multiset(corpus_pipeline.run(spark, sf_dir).collect())
    wide = docs
    for name, stage in corpus_pipeline.STAGES:
        wide = stage(spark, wide, sf_dir)
    assert wide.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_examples_of_one_owner(spark):
    example, live = "Zx9Qw8Er7Ty6Ui5Op4", "Mn2Bv3Cx4Zl5Kj6Hg7"
    said = " ".join(f"v{i}" for i in range(60))
    rng = np.random.default_rng(3)
    many = secret_scan.MAX_REPOSITORIES + 5
    rows = [
        (i, " ".join(f"w{n}" for n in rng.integers(0, 10**6, 60)) + f" bearer {example}", "", "s1", 0)
        for i in range(many)
    ]
    rows += [(1000 + i, f"{said} bearer {live}", "", "s2", 0) for i in range(many)]
    out = {r.doc_id: r for r in secret_scan.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[0].n_live, out[0].spans) == (0, "")
    assert out[1000].n_live == 1 and out[1000].n_copied == 0
