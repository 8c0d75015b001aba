"""Each operator against a plain version, and on odd and empty tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdict.llm import ann, chat, language, licenses, minhash, mixing, packing, pii, toxicity, vector_dedup
from verdict.llm.common import components, fold, scratch_tables
from verdict.llm.queries import table


def collected(df):
    return df.collect()


def reached(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = reached({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_all_pairs(spark, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=60)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(80)]
    for _ in range(150):  # a large group of near copies at all similarities
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += texts[:20]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width).collect()}
    sets = [plain_set(t, width) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = reached(range(len(texts)), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, common in ((4, 3), (50, 30), (3000, 2400)):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate((a[:common], rng.integers(0, 2**63, size - common).astype(np.uint64)))
        x, y = minhash.sketch_sets(np.concatenate((a, b)), np.array([0, size, 2 * size]))
        assert (x != minhash._EMPTY).all()
        assert abs((x == y).mean() - common / (2 * size - common)) < 0.12


def vectors(spark, rng, n=400):
    x = rng.normal(size=(n, 16))
    x[300:] = x[0] + 0.05 * rng.normal(size=(n - 300, 16))
    x[1] = x[2] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.selectExpr("*", "1 as id", "2 as v", "3 as n", "4 as block"), x


def test_nearest_neighbours(spark):
    df, x = vectors(spark, np.random.default_rng(2))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.expr("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = 0
    for q in range(0, 400, 10):
        scores = unit @ unit[q]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        found += len({i for _, i in best} & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s - scores[i]) < 1e-12 for i, s in got[q])
    assert set(got) == set(range(0, 400, 10)) and found >= 0.9 * 200
    few = df.filter("vec_id in (0, 5, 900)")
    assert [r["vec_id"] for r in ann.nearest(few, F.lit(True)).orderBy("query_id").collect()] == [5, 0]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_vector_links(spark):
    df, x = vectors(spark, np.random.default_rng(4))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    want = reached(range(400), [(i, j) for i, j in zip(*np.nonzero(linked), strict=True) if i < j])
    got = vector_dedup.near_duplicates(df).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == 406
    assert all(by[i]["n_links"] == linked[i].sum() - 1 and by[i]["component_id"] == want[i] for i in range(400))
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in range(900, 905))
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_multi_sequence_visits_cells_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.random(9), rng.random(7)
    cells = vector_dedup.multi_sequence(a, b, 63)
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


def test_maximal_segments_match_recursion():
    def plain(scores, offset=0):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return [*plain(scores[:i], offset), (offset + i, offset + j), *plain(scores[j:], offset + j)]

    rng = random.Random(6)
    for _ in range(60):
        own = {i: rng.choice([3.0, 2.5, 7.25, -4.5]) for i in rng.sample(range(24), 9)}
        scores = [own.get(i, -0.75) for i in range(24)]
        got = [(b, e) for b, e, _ in toxicity.maximal_segments(sorted(own.items()), -0.75)]
        sums = [round(sum(scores[b:e]), 9) for b, e in got]
        want = plain(scores)
        assert sums == [round(sum(scores[b:e]), 9) for b, e in want]


def test_toxicity_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = docs.filter(fold() != 0).join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("label"))
    model = toxicity.fit(learned)
    scored = toxicity.score_documents(docs.filter(fold() == 0), model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    hit = collections.Counter((r["lang"], r["score"] >= 0.5) for r in scored if r["toxic"] == 1)
    assert sum(n for (_, found), n in hit.items() if found) >= 0.9 * hit.total()
    assert hit.total() - sum(n for (_, found), n in hit.items() if not found) >= 0.95 * sum(r["score"] >= 0.5 for r in scored)
    for lang in ("en", "de", "fr", "es"):
        assert hit[lang, True] >= 0.8 * (hit[lang, True] + hit[lang, False])
    # More evidence or denser evidence never lowers a score.
    grid = [[model.probability(e, d) for d in (0, 0.1, 1, 10)] for e in (0, 0.5, 5, 50)]
    assert all(x <= y for row in grid for x, y in itertools.pairwise(row)) and all(x <= y for col in zip(*grid) for x, y in itertools.pairwise(col))


def test_different_texts_are_learned_apart(spark):
    """Texts of one label that share almost all tokens all count; equal sets of tokens count once."""
    same = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))
    rows = [(i, f"{same} calm{chr(97 + i % 20)}", 0) for i in range(60)] + [(100 + i, f"{same} nasty plainly{chr(97 + i % 20)}", 1) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows + rows[:1] * 30, "id long, text string, label int"))
    assert model.score("nasty") > 1
    assert model.segments(toxicity.tokens("all calm here nasty nasty words")) != []


def test_clearest_units_and_calibration():
    model = toxicity.Model({"lovely": (-1.0, 5.0), "love*": (2.0, 3.0), "vile*": (4.0, 6.0)}, drift=-0.5, rate=1.5, log_k=-2.0, curve=(-2.0, 1.0, 1.0))
    assert [model.score(w) for w in ("lovely", "lovers", "vile", "vileness", "x")] == [-1.0, 2.0, None, 4.0, None]
    words = toxicity.tokens("a vileness of lovers")
    evidence, density, strong = model.features(words)
    # vileness, of, lovers: 4 - 0.5 + 2 in one segment.
    assert [(b, e, s) for b, e, s, _ in strong] == [(1, 4, 5.5)]
    assert abs(evidence - (1.5 * 5.5 + 2 - np.log(4))) < 1e-12 and abs(density - evidence / 2) < 1e-12
    assert abs(model.probability(evidence, density) - 1 / (1 + np.exp(2 - np.log1p(evidence) - np.log1p(density)))) < 1e-12
    scores = np.array([2.0, -1.0, -0.5])
    weights = np.array([0.1, 0.2, 0.7])
    assert abs((weights * np.exp(toxicity._rate(scores, weights) * scores)).sum() - 1) < 1e-9


def test_languages_of_held_out_and_switched_texts(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, folder, "documents")
    model = language.fit(docs.filter(fold() != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    held = docs.filter(fold() == 0)
    got = language.label_documents(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    texts = {r["lang"]: language.words_of(r["text"])[:60] for r in held.filter("lang in ('en', 'de') and n_chars > 1000").collect()}
    marginal = model.marginals([texts["en"] + texts["de"]])[0].argmax(axis=1)
    want = [model.languages.index("en")] * 60 + [model.languages.index("de")] * 60
    assert (marginal == want).mean() > 0.9


def test_languages_of_long_runs(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "stuvwxyz", "ja": "あいうえおかきく", "zh": "中文字我你他是的"}
    rows = [(i, "".join(rng.choices(letters[lang], k=300)), lang) for i, lang in enumerate(sorted(letters) * 12)]
    rows = [(i, t if lang > "c" else " ".join(t[j : j + 6] for j in range(0, 300, 6)), lang) for i, t, lang in rows]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    tail, han, kana = "abcdefgh" * 3 + "zyxwvuts" * 60, letters["zh"] * 5, letters["ja"] * 5
    got = language.predict(model, [tail, han + kana, "x" * 24 + "abcdefgh" * 60], {})
    assert got[0][0] == "bb" and got[1][2] == {"zh": 40, "ja": 40} and got[2][0] == "aa"
    assert language.words_of("Ab中文c ไทย9") == ["ab", "中", "文", "c", "ไ", "ท", "ย"]
    (long, (n,)), (short, _) = language.features(["q" * 70 + "heit"]), language.features(["xheit"])
    assert n == len(long) == 2 * 76 + 2 and (long[3:5] == short[3:5]).all()
    together = language.features(["q" * 70 + "heit", "a", "xheit"])
    assert (together[0] == np.concatenate([long, language.features(["a"])[0], short])).all()


def test_switched_texts_stay_and_unclear_ones_go(spark, monkeypatch):
    rng = random.Random(15)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(40))
    letters = ["abcde", "fghij", "klmno", "pqrst"]
    rows = [(i, text(letters[i % 4]), f"l{i % 4}") for i in range(60)] + [(100, " ".join(map(text, letters)), None), (101, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {*range(60), 100}
    flat = language.Model(["a", "b", "c", "d"], np.zeros((language.FEATURES, 4)), np.zeros((4, 4)))
    monkeypatch.setattr(language, "fit", lambda _: flat)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(14)
    names = [f"l{i:02}" for i in range(70)]
    lexicons = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)] for lang in names}
    rows = [(i, " ".join(rng.choices(lexicons[lang], k=15)), lang) for i, lang in enumerate(names * 3)]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    got = language.predict(model, [" ".join(lexicons[lang]) for lang in names], {})
    assert [r[0] for r in got] == names


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(8)
    scores, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    sizes = np.array([4, 0, 3])
    got, pairs, likelihood = language.forward_backward(scores, sizes, move, pairs=True)
    total = 0.0
    for rows in (range(4), range(4, 7)):
        paths = list(itertools.product(range(3), repeat=len(rows)))
        weight = np.array([np.exp(sum(scores[r, k] for r, k in zip(rows, p, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        total += np.log(weight.sum())
        for i, r in enumerate(rows):
            for k in range(3):
                assert np.isclose(got[r, k], weight[[p[i] == k for p in paths]].sum() / weight.sum())
    assert np.isclose(likelihood, total) and np.isclose(pairs.sum(), 5)


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_round_trip(spark, odd_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    rng = random.Random(9)
    odd = ["it's we'LL", "naïve CAFÉ.", "a\x1cb", " x\xa0y", "<|endoftext|> z", "ΣΑΣ İ", "é ́", "10.5kg", "don't!!", "ﬁ ß"]
    texts = odd + ["".join(rng.choices("aÉ .,'\n1<|>s-é中", k=50)) for _ in range(300)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    pieces = packing.pack(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids)] += len(ids)
        if r["doc_id"] and r["doc_id"] >= 100:
            mine = [p for p in pieces if p["doc_id"] == r["doc_id"]]
            assert sum(p["length"] for p in mine) == len(ids)
            assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in mine)
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert got == want
    laid = sorted((p["sequence_id"] * 4096 + p["offset"], p["length"]) for p in pieces)
    assert laid[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(laid))
    assert all(p["offset"] + p["length"] <= 4096 for p in pieces)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_follows_the_curve(spark, odd_docs, sf_dir):
    """Documents lie in the order of their places, ties by id; clashing columns and small chunks change nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clashing = docs.selectExpr("*", "1 as row", "2 as place", "3 as ids", "4 as n", "5 as position")
    pieces = packing.pack(clashing, chunk=50_000).collect()
    assert collections.Counter(pieces) == collections.Counter(packing.pack(docs).collect())
    place = {r["doc_id"]: r["place"] for r in packing.encoded(docs).collect()}
    laid = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert laid == sorted(laid, key=lambda d: (place[d], d)) and len(laid) == docs.count()
    assert packing.pack(odd_docs).count() >= odd_docs.count()


def test_packing_remembers_within_bounds(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a bc, a bc. de!! 12 x\u00a0y", "", "  a  "])
    encoder = packing.Encoder(packing.vocabulary())
    want = encoder.documents(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    for _ in range(3):
        ids, places = encoder.documents(texts)
        assert ids == want[0] and (places == want[1]).all() and len(encoder.known.number) < 12
    assert ids[1] == np.array([2], np.uint16).tobytes()


def test_mixing(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9 for r in rows)
        assert abs(sum({(r["source_size"], r["target"]) for r in rows} and [r["target"] * r["size"] / r["source_size"] for r in rows if r["source_size"]]) - sum(r["size"] for r in rows)) < 1e-6
        copies = mixing.copies(docs)
        assert copies.select("row.*").columns == docs.columns and copies.count() == docs.count()
    assert sorted(mixing.mix(odd_docs).collect(), key=str) == sorted(mixing.mix(odd_docs.repartition(5)).collect(), key=str)


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        twice = [int(c) for c in reversed(d)]
        check = sum(twice[::2]) + sum(sum(divmod(2 * c, 10)) for c in twice[1::2])
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_match_patterns():
    rng = random.Random(10)
    seen = collections.Counter()
    for _ in range(6000):
        text = "".join(rng.choices(["a", "b.", "@", "@c.d", ".", "1", "23", "+4", " ", "-", "(5)", "411", "10.0.", "256.", "4111 1111 1111 1111", "é", "%"], k=rng.randint(1, 14)))
        want = plain_base(text)
        assert pii.base_spans(text) == want, text
        seen.update(k for k, *_ in want)
    assert min(seen[k] for k in pii.KINDS) > 20
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_personal_data(spark, odd_docs, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    model = pii.fit(docs)
    found = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    for r in docs.collect():
        base = [(s["kind"], s["begin"], s["end"]) for s in found[r["doc_id"]]["base"]]
        assert base == plain_base(r["text"])
        assert {*base} <= {(s["kind"], s["begin"], s["end"]) for s in found[r["doc_id"]]["spans"]}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(odd_docs, model).collect()}
    assert masked[10] == "mail <EMAIL> or <PHONE> now, <IP> <CARD>"
    assert masked[4] is None and masked[5] == "" and pii.find(odd_docs.limit(0), model).count() == 0
    assert pii.find(odd_docs, pii.fit(odd_docs.limit(0))).count() == odd_docs.count()


def test_semi_markov_expectations_match_enumeration():
    rng = np.random.default_rng(12)
    text = "10.0 20-30 +4"
    (units, *_) = pii.regions("10.20-30")
    pairs, f = pii.candidates("10.20-30", units)
    model = pii.Model(rng.normal(size=(4, pii.N_FEATURES)) / 4, rng.normal(size=(5, 5)) / 4)
    n = len(units)
    weights, sums = [], []

    def walk(at, last, score, w):
        if at == n:
            weights.append(np.exp(score))
            sums.append(w)
            return
        for (i, j), x in zip(pairs, f, strict=True):
            for k in range(5):
                if i == at and (k < 4 or j == at + 1):
                    more = np.zeros_like(model.weights)
                    if k < 4:
                        more[k] = x
                    walk(j, k, score + model.order[last, k] + (model.weights[k] @ x if k < 4 else 0), w + more)

    walk(0, 4, 0.0, np.zeros_like(model.weights))
    p = np.array(weights) / sum(weights)
    assert text and np.allclose(pii._expected(model, n, pairs, f)[0], sum(a * b for a, b in zip(p, sums, strict=True)))


def test_licenses(spark, odd_docs):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.\n"), (2, "a/b/x", "def f"), (3, "a/b/c/y", None), (4, "a/b/c/LICENSE", "LICENSED!! UNDER!! CC!! BY-NC 4.0!!"),
        (5, "z/w", "no words of it"), (6, "a/own", "some code and much more text of every kind\nLicensed under the Apache License, Version 2.0.\nmore"), (7, None, ""),
    ]
    got = {r["file"]: (r["license"], r["how"], r["from_path"]) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("CC-BY-NC-4.0", "inherited", "a/b/c"), 4: ("CC-BY-NC-4.0", "own", None),
        5: (None, None, None), 6: ("Apache-2.0", "own", None), 7: (None, None, None),
    }
    odd = odd_docs.withColumn("file", F.col("doc_id")).withColumn("path", F.col("source"))
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_licence_texts_and_wrapped_notices(spark):
    texts = licenses.TEXTS
    wrapped = "/*\n * Redistribution and use in source and\n *\n * binary forms, with or without modification,\n * are permitted provided that the\n * following conditions are met\n */\n" + "int x;\n" * 80
    files = [(i, f"{name}/LICENSE", "Copyright (c) 2020 Some One\n" + text) for i, (name, text) in enumerate(sorted(texts.items()))]
    below = [(100 + i, f"{name}/src/a.c", "int main") for i, name in enumerate(sorted(texts))]
    prose = " ".join("the of and to in a software work may be used by you for any purpose with the".split() * 40)
    files += [*below, (200, "w/a.c", wrapped), (201, "w/b.c", "int y"), (202, "w/c.txt", prose)]
    got = {r["file"]: (r["license"], r["how"]) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    assert got == {
        **{i: (name, "own") for i, name in enumerate(sorted(texts))}, **{100 + i: (name, "inherited") for i, name in enumerate(sorted(texts))},
        200: ("BSD-3-Clause", "own"), 201: (None, None), 202: (None, None),
    }


def test_chat_round_trip(spark):
    rng = random.Random(13)
    pieces = [*chat.CONTROLS, "\\", "<", "[", "a", "é", "\n", "<\\", "[\\INST]", "|turn|>"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)
        assert chat.read_turn("".join(chat.format_turn(text, [{"type": "text", "text": text}]).pieces)) == (text, text)


def test_chat_parts_and_digests(spark):
    text = {"type": "text", "text": "see </s>"}
    turn = chat.format_turn("assistant", [text, {"type": "image", "ref": "i.png", "width": 1000, "height": 512}, {"type": "audio", "ref": "a", "seconds": 1.5}, text, {"type": "document", "ref": "d", "pages": 2}])
    assert "".join(turn.pieces) == "<|turn|>assistant<|text|>see <\\/s><|image|><|audio|>see <\\/s><|document|><|end|>"
    assert [a["tokens"] for a in turn.attachments] == [340, 38, 1600] and [a["ref"] for a in turn.attachments] == ["i.png", "a", "d"]
    whole = "".join(turn.pieces)
    assert [chat.unescape(whole[a:b]) for a, b in turn.spans] == ["see </s>"] * 2
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (2, 1), None: (1, 0), 2: (2, 2)}
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_odd_tables(spark, odd_docs):
    n = odd_docs.count()
    for docs, many in ((odd_docs, n), (odd_docs.limit(0), 0)):
        learned = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text", "lang", F.expr("cast(doc_id % 2 as int)").alias("label"))
        labelled = language.label_documents(docs, language.fit(learned)).collect()
        assert len(labelled) == many and all(r["lang_pred"] == "und" for r in labelled if r["doc_id"] in (4, 5, 6, 9))
        assert toxicity.score_documents(docs, toxicity.fit(learned)).count() == many
        found = minhash.near_duplicates(docs).collect()
        assert len(found) == many and all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)
    by = {r["doc_id"]: r for r in found} or {r["doc_id"]: r for r in minhash.near_duplicates(odd_docs).collect()}
    assert by[3]["component_id"] == 1 and by[2]["component_id"] == 1 and by[4]["component_id"] == 4 and by[6]["n_shingles"] == 0


def test_personal_data_written_otherwise(spark, sf_dir):
    """The field finds forms no pattern matches, in documents it has not seen, and leaves other numbers alone."""
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents").filter("text rlike '[0-9@]'")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    found, wanted, matched = 0, 0, 0
    for (text,) in docs.filter("doc_id % 2 = 1").select("text").collect():
        if base := pii.base_spans(text):
            form, gold = pii.rewritten(text, base)
            seen = pii.base_spans(form)
            seen = {*seen, *model.add(form, seen)}
            found, wanted, matched = found + len(seen), wanted + len(gold), matched + len(seen & set(gold))
    assert wanted > 200 and matched >= 0.9 * wanted and matched >= 0.95 * found
    for text in ("on 2024-05-12 10:30", "12/05/2024 - 13/06/2024", "version 1.2.3", "1.234.567,89", pii.harmless(5)):
        assert model.add(text, []) == [], text
    for text, kind in (("call 212-555-7713 now", "phone"), ("at 10[.]1[.]2[.]3", "ip"), ("me.now (at) mail.example.com", "email")):
        assert [s[0] for s in model.add(text, [])] == [kind], text


def test_what_stands_late_is_learned():
    """Rows to learn from come from whole texts: all that hold a span, others by hash; long rows are cut."""
    text = " and ".join(f"{i} {i}" for i in range(5_000)) + " call +1 (212) 555-7713, " + " ".join("12" for _ in range(100))
    base = pii.base_spans(text)
    rows = pii._drawn(text, base)
    assert any(row[0][0] <= base[0][1] + 1 and base[0][2] <= row[-1][1] for row in rows)
    assert len(rows) <= pii.REGIONS + 1 and max(map(len, rows)) <= pii.ROW
    assert sum(row[0][0] > len(text) // 2 for row in rows) > 10


def test_best_segments_match_enumeration():
    rng = np.random.default_rng(3)

    def every(n):
        if n == 0:
            yield []
        for first in range(1, min(n, pii.MOST_UNITS) + 1):
            for rest in every(n - first):
                moved = [(i + first, j + first, k) for i, j, k in rest]
                for kind in range(5 if first == 1 else 4):
                    yield [(0, first, kind), *moved]

    for text in ("10.20-30", "1 2 3 4", "5", "10.0.0.1"):
        (units, *_) = pii.regions(text)
        pairs, f = pii.candidates(text, units)
        for _ in range(5):
            model = pii.Model(rng.normal(size=(4, pii.N_FEATURES)), rng.normal(size=(5, 5)))
            typed = dict(zip(pairs, f @ model.weights.T, strict=True))

            def score(way):
                total, last = 0.0, 4
                for i, j, k in way:
                    total += model.order[last, k] + (typed[i, j][k] - pii.MARGIN if k < 4 else 0.0)
                    last = k
                return total

            best = max(every(len(units)), key=score)
            assert model.best(len(units), pairs, f) == [s for s in best if s[2] < 4]


def test_mixing_without_ids(spark):
    """Rows without id, or of one id, are split by their texts, so a source comes near its target."""
    rows = [(None if i % 3 else 7, f"word{i} " * 10, "a") for i in range(600)] + [(i, "x " * 10, "b") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, group in got.groupby("source_size"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 20


def test_pipeline_keeps_different_texts_of_one_id(spark, sf_dir):
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(words[:40]), " ".join(words[40:80]), " ".join(words[:40])]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[2]), (None, texts[1]), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = collections.Counter((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).collect())
    assert kept == {(3, texts[0]): 1, (5, texts[1]): 1, (None, None): 1, (4, ""): 2}


def test_pipeline_drops_copies_without_shuffling_texts(spark, sf_dir):
    """No text is shuffled even where the numbers of kept rows are too many to broadcast, and only two scratch tables stay."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, first = spark.conf.get(key), scratch_tables()
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 20 * 20 :][:20]), "en", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set(key, "-1")
    try:
        kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.repartition(5), sf_dir)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
        assert not re.search("Exchange hashpartitioning|SortMergeJoin", kept._jdf.queryExecution().executedPlan().toString())
        assert scratch_tables() - first == 2
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("most", [corpus_pipeline.BROADCAST, 0])
def test_rows_of(spark, monkeypatch, most):
    """Rows by their numbers, over several bitmaps of several partitions, broadcast or not."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST", most)
    rows = spark.range(0, 150_000, 1, 3).withColumn(corpus_pipeline.ROW, F.monotonically_increasing_id())
    wanted = {i for i in range(150_000) if i % 50_000 < 9 or 32_760 < i % 50_000 < 32_777 or i % 7 == 3}
    ids = rows.filter(F.pmod("id", F.lit(50_000)).cast("int").isin([*range(9), *range(32_761, 32_777)]) | (F.col("id") % 7 == 3)).select(corpus_pipeline.ROW)
    got = [r["id"] for r in corpus_pipeline.rows_of(rows, ids).select("id").collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert corpus_pipeline.rows_of(rows, ids.limit(0)).count() == 0


def test_pipeline_stages_on_empty_and_clashing_tables(spark, odd_docs, sf_dir):
    for docs in (odd_docs.limit(0), odd_docs):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, sf_dir)
            assert name == "packing" or kept.columns == docs.columns, name
            assert (kept.count() > 0) == (docs is odd_docs), name


def test_pipeline_stages(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        if name == "language":
            assert {4, 5, 6, 9}.isdisjoint({r["doc_id"] for r in rows}) and {1, 2, 3, 7, 8, 10, 11} <= {r["doc_id"] for r in rows}
        if name == "near_duplicates":
            assert collections.Counter(r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3)) == {1: 1}
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
