"""Operators 2, 8 and 10 and the pipeline."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from strataframe.llm import langid, mixing, quality
from strataframe.llm import queries as llm_queries

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_gradients():
    r = np.random.default_rng(1)
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, owner = quality.cut([bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in (20, 700, 900)])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        h = net.hidden(net.pooled(codes)[0], codes)[1].astype(np.float64)
        z = np.bincount(owner, weights=h @ net.p["out"], minlength=3) / np.bincount(owner) + net.p["prior"][0]
        return (np.log1p(np.exp(z)) - y * z).mean()

    g = net.gradients(codes, owner, y)
    for name in net.p:
        flat, at = net.p[name].reshape(-1), int(np.argmax(np.abs(g[name])))
        flat[at] += 1e-4
        up = loss()
        flat[at] -= 2e-4
        down = loss()
        flat[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name].reshape(-1)[at]) < 2e-2 * abs(g[name].reshape(-1)[at]) + 1e-4, name


def test_chunks_cover_all():
    for n in (0, 1, 511, 512, 513, 5000):
        codes, owner = quality.cut([b"x" * n, b"y"])
        assert (owner == 0).sum() * quality.STEP + (quality.CHUNK - quality.STEP) >= n and (codes[owner == 0] != quality.PAD).sum() >= n


def labelled(spark, n=700):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9)))
    docs = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(r.randrange(10, 120))), i % 3 != 0) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in docs] + [(None, None), (None, "x"), (n, ""), (n, "")], "doc_id long, text string").selectExpr("*", "'a' as score", "1 as c0"), spark.createDataFrame([(i, int(k)) for i, _, k in docs] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")


def test_quality(spark):
    docs, labels = labelled(spark)
    net = quality.fit_quality(docs, labels, fit_rows=200)
    out = quality.score_quality(docs, net).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality in (0, 1) and doc_id is not null").collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out) and len(out) == 704
    assert quality.score_quality(docs.where("false"), net).count() == 0
    assert quality.score_quality(docs.limit(2), quality.fit_quality(docs, labels.where("false"))).count() == 2
    scored = lambda some: {round(r["score"], 3) for r in quality.score_quality(docs.limit(5), quality.fit_quality(docs, some)).collect()}
    assert scored(labels.where("quality = 1")) == {0.982} and scored(labels.where("quality = 0")) == {0.018}
    assert scored(labels.selectExpr("doc_id + 100000 as doc_id", "quality")) == {0.5}  # labels of no document


def test_scores_equal_a_plain_loop():
    """The network against a loop over chunks, positions and filters; long texts too."""
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (0, 3, 7, 300, 512, 900, 150_000)]
    net = quality.Network(4)
    p = net.p
    for t, z in zip(texts[:6], net.logits(texts)):
        outs, at = [], 0
        while True:
            chunk = list(t[at : at + quality.CHUNK])
            n = len(chunk)
            x = np.array([p["bytes"][b] for b in chunk + [quality.PAD] * (quality.CHUNK - n)]).reshape(-1, quality.GROUP * quality.DIM)
            best = [max(float(x[i] @ p["left"][:, f] + x[i + 1] @ p["right"][:, f]) for i in range(len(x) - 1) if i == 0 or i * quality.GROUP < n) for f in range(quality.FILTERS)]
            a = [max(v + float(c), 0) for v, c in zip(best, p["bias"])] + [4 * (1 - np.log1p(n) / np.log1p(quality.CHUNK))]
            outs.append(float(np.maximum(np.array(a) @ p["dense"] + p["shift"], 0) @ p["out"]))
            at += quality.STEP
            if at + quality.CHUNK - quality.STEP >= len(t):
                break
        assert abs(np.mean(outs) + p["prior"][0] - z) < 1e-3
    one, many = net.logits(texts[6:]), net.logits(texts)
    assert abs(one[0] - many[6]) < 1e-5


def test_all_chunks_are_learned(spark):
    """What tells the classes apart stands at one place of a long text."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(240):
        words = [word() for _ in range(700)]
        if i % 2:
            at = r.randrange(0, 600)
            words[at : at + 90] = ["%%##" + w for w in words[at : at + 90]]
        rows.append((i, " ".join(words), 1 - i % 2))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    net = quality.fit_quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    out = {x["doc_id"]: x for x in quality.score_quality(docs, net).collect()}
    right = [(out[i]["score"] > 0.5) == (y == 1) for i, _, y in rows if out[i]["held_out"]]
    assert sum(right) / len(right) > 0.9


def test_languages(spark):
    r = random.Random(8)
    parts = {"aa": ["ban", "lo", "mir", "ta"], "bb": ["sch", "ung", "er", "zu"], "cc": ["ñe", "ción", "ado", "qué"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randrange(4, 60))), lang) for i in range(600) for lang in [r.choice(list(parts))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", None), (None, "banlo mirta banmir", None), (1003, "q", None), (1004, "x" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit_languages(docs)).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in rows if i is not None and i < 600}
    held = [x for x in out if x["held_out"] and x["doc_id"] in truth]
    assert sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    by = {x["doc_id"]: x for x in out}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None]["lang_pred"] == "aa" and by[1003]["lang_pred"] in parts
    assert all(0 <= x["score"] <= 1 for x in out)
    assert langid.identify(docs, langid.fit_languages(docs.where("lang is null"))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.where("false"), langid.fit_languages(docs)).count() == 0


def test_filters_have_no_false_negatives():
    f = langid.Filters.fit({"a": [b"hello world " * 20], "b": [b"guten morgen " * 20]})
    g = np.unique(langid.grams([b"hello world hello"])[0])
    assert (f.masks(g) & 1).all() and (f.false_rates < 0.1).all()


def test_predictions_equal_plain_sets():
    """Against Python sets in the filters' place, where no slot is shared by chance."""
    r = random.Random(12)
    parts = {"aa": ["ban", "lo", "mir", "ta"], "bb": ["sch", "ung", "er", "ta"], "cc": ["ñe", "ción", "ado", "lo"]}
    text = lambda x, n: " ".join("".join(r.choice(parts[x]) for _ in range(3)) for _ in range(n)).encode()
    samples = {x: [text(x, 40) for _ in range(6)] for x in parts}
    f = langid.Filters.fit(samples)
    sets = {x: {g for t in samples[x] for g in langid.grams([t])[0].tolist()} for x in parts}
    tests = [text(r.choice(list(parts)), r.randrange(3, 30)) for _ in range(60)] + [b"", b"x"]
    best, score = f.predict(tests)
    assert best[-2] == 0 and abs(score[-2] - 1 / 3) < 1e-9  # nothing known: the shares of rows
    for t, i, s in zip(tests[:60], best, score):
        own = langid.grams([t])[0].tolist()
        true = np.array([max((sum(g in sets[x] for g in own) - rate * len(own)) / (1 - rate), 0) + 1e-3 / 3 for x, rate in zip(f.languages, f.false_rates)])
        assert abs(s - true[i] / true.sum()) < 0.2 and (true[i] >= 0.9 * true.max())


def test_letters_and_clashing_names(spark):
    rows = [(i, f"{w} {w}", x) for i, (x, w) in enumerate([("aa", "banlomirta"), ("bb", "schungerzu")] * 40)]
    docs = spark.createDataFrame(rows + [(500, "½ ² Ⅷ ①", "aa"), (501, "ª", None), (3, rows[3][1], rows[3][2])], "doc_id long, text string, lang string").selectExpr("*", "1 as h", "2 as r", "'x' as cut", "3 as id")
    out = {r["doc_id"]: r for r in langid.identify(docs, langid.fit_languages(docs)).collect()}
    assert out[500]["lang_pred"] == "und" and out[501]["lang_pred"] != "und" and len(out) == 82
    assert all(out[i]["lang_pred"] == x for i, _, x in rows)


def test_mixing_follows_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 60), r.choice(["de", "en", "en"]), r.choice(["s0", "s0", "s0", "s1", "s2"])) for i in range(3000)] + [(None, None, None, None), (3, "", None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as tokens", "2 as weight", "'z' as topic")
    goal = lambda c, **t: spark.createDataFrame(list(t.items()), f"{c} string, target double")
    out = mixing.mix(docs, targets={"source": goal("source", s0=0.2, s1=0.3, s2=0.5), "lang": goal("lang", de=0.5, en=0.5)}, rounds=12)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.selectExpr("source", "lang", "mix_tokens * mix_probability as t", "mix_tokens * int(mix_kept) as k").toPandas()
    share = got.groupby("source").t.sum() / got.t.sum()
    assert abs(share["s2"] - 0.5) < 1e-3 and abs(share["s1"] - 0.3) < 1e-3
    assert abs((got.groupby("lang").t.sum() / got.t.sum())["de"] - 0.5) < 1e-3
    assert abs(got.k.sum() / got.t.sum() - 1) < 0.15
    assert out.count() == len(rows) and mixing.mix(docs.where("false")).count() == 0


def test_calibrated_cells_equal_plain_raking(spark):
    r = random.Random(21)
    cells = [(f"s{i}", f"l{j}", r.randrange(0, 400) * (r.random() < 0.7)) for i in range(6) for j in range(4)]
    goals = {"source": {f"s{i}": 1 / 5 for i in range(5)}, "lang": {f"l{j}": (j + 1) / 10 for j in range(4)}}
    weight, whole = {c[:2]: 1.0 for c in cells}, sum(c[2] for c in cells)
    for _ in range(9):
        for k, d in enumerate(goals):
            now = {}
            for c in cells:
                now[c[k]] = now.get(c[k], 0) + weight[c[:2]] * c[2]
            for c in cells:
                if now[c[k]] > 0 and c[k] in goals[d]:
                    weight[c[:2]] *= goals[d][c[k]] * whole / now[c[k]]
    held = spark.createDataFrame(cells, "source string, lang string, tokens long")
    targets = {d: spark.createDataFrame(list(g.items()), f"{d} string, target double") for d, g in goals.items()}
    out = mixing.calibrate(held, targets, 9)
    assert all(abs(x["weight"] / weight[x["source"], x["lang"]] - 1) < 1e-9 for x in out.collect()) and out.count() == len(cells)
    gaps = {x["dim"]: x["gap"] for x in mixing.largest_gap(out, targets).collect()}
    assert gaps["lang"] < 1e-9 and set(gaps) == {"source", "lang"}


def test_mixing_of_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 400_000, "en", "s"), (2, "", None, None), (2, None, "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as mix_source", "2 as c0", "3 as tokens", "4 as draw", "5 as probability", "6 as mix_kept")
    out = mixing.mix(docs)
    assert [c for c in docs.columns if c != "mix_kept"] == out.columns[:9] and out.columns[-1] == "mix_kept"
    got = out.collect()
    assert sorted(x["mix_tokens"] for x in got) == [0, 0, 2, 2, 400_000] and all((x["mix_source"], x["c0"], x["tokens"], x["draw"], x["probability"]) == (1, 2, 3, 4, 5) for x in got)


@tables
@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got, want = llm_queries.QUERIES[name](spark, DIR), con.sql(llm_queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda rows, columns: sorted((tuple(r[columns.index(c)] for c in names) for r in rows), key=str)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), list(want.columns))


@tables
def test_pipeline(spark):
    """The stages against plain decisions on the smallest tables."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = {}
    for name, stage in C.STAGES:
        before = docs
        docs = stage(spark, docs, DIR).cache()
        held[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = held["quality"]
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().set_index("doc_id").quality
    clean = labels[labels == 1].index.intersection(before.doc_id)
    assert len(set(clean) & set(after.doc_id)) / len(clean) > 0.9
    from test_near import brute

    before, after = held["near_dedup"]
    want = brute(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), 80)
    assert set(after.doc_id) == {c for _, _, c in want}
    from test_repeats import brute_bytes

    before, after = held["suffix_dedup"]
    assert len(before) == len(after)
    kept = {k: n - gone for k, n, gone, *_ in brute_bytes(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), 200)}
    assert all(0 <= len(t.encode()) - kept[k] <= 6 * 8 for k, t in zip(after.doc_id, after.text))
    before, after = held["mixing"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > len(before) / 3
    before, after = held["packing"]
    assert set(after.doc_id) == set(before.doc_id)


def test_more_languages_than_a_mask_word():
    r = random.Random(9)
    parts = {f"l{i:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(4)] for i in range(140)}
    text = lambda lang: " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(30)).encode()
    f = langid.Filters.fit({lang: [text(lang) for _ in range(5)] for lang in parts})
    best, score = f.predict([text(lang) for lang in parts])
    assert [f.languages[i] for i in best] == list(parts) and (score > 0.5).all()


def test_languages_past_the_64th_are_learned(spark):
    words = {f"l{i:02d}": "".join(chr(97 + (i * k + k * k) % 26) for k in range(3, 15)) + f"{chr(97 + i // 26)}{chr(97 + i % 26)}xyz" for i in range(66)}
    docs = spark.createDataFrame([(i, f"{w} {w}", lang) for i, (lang, w) in enumerate([*words.items()] * 5)], "doc_id long, text string, lang string")
    filters = langid.fit_languages(docs)
    assert filters.languages == list(words)
    last = langid.identify(docs.where("lang >= 'l64'"), filters).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(last) == 10 and all(x["lang_pred"] == x["lang"] for x in last)
