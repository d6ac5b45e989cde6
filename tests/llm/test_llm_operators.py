"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkpact.llm import bpe, chat, common, decontamination, html_text, language_model, licenses, simhash, toxicity, vector_search, warc
from sparkpact.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, n_tokens long, score double, fp long, id long"


def docs(spark, *texts):
    rows = [(k, t, "en", 1, 0.5, 3, 4) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["Hello World, it's fine", None, "", "   \n", "same text here now", "same text here now", "x" * 50_000, "word " * 30_000, "ÀÉ ß İ 一二 🙂 " * 50]
    df = docs(spark, *texts).unionByName(docs(spark, "null id one two three").withColumn("doc_id", F.lit(None).cast("long")))
    return df.unionByName(docs(spark, texts[0])).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- BPE -------------------------------------------------------------------------------------------


def test_bpe_like_the_library(spark, odd):
    lib = Tokenizer.from_file(tokenizer_path())
    rows = bpe.encode_decode(odd, tokenizer_path(), ids=True).collect()
    assert len(rows) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(spark), tokenizer_path()).count() == 0


def test_trie_bpe_on_random_text():
    lib = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        model = bpe.TrieBpe(f.read())
    rnd = random.Random(5)
    letters = "aabbtthhe 'sS'LL\t\x1c\x1d\x85\xa0éÉİßΣσς一二三̀́<|endoftext|>🙂½²ﬁǅ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1_500)]
    texts += ["aaaa" * 500, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "don't I'LL we've 'sx"]
    assert model.encode_batch(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


# -- SimHash ---------------------------------------------------------------------------------------


def test_trie_links_are_all_links():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (40, 3), dtype=np.uint64), axis=1) for c in centres]))
    found = {tuple(sorted(p)) for a, b in simhash.trie_links(np.zeros(len(fps), np.int64), fps, 4) for p in zip(a.tolist(), b.tolist(), strict=True)}
    wanted = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count(fps[i] ^ fps[j]) <= 4}
    assert found == wanted


def test_block_keys_leave_no_pair_out(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(50):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in pairs], "a long, b long")
    shared = df.select(F.arrays_overlap(simhash.block_keys(F.col("a"), 4), simhash.block_keys(F.col("b"), 4)).alias("x"))
    assert all(r["x"] for r in shared.collect())


def test_hot_tries_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_TRIE", 20)
    rnd = random.Random(8)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:  # one dense group: all links by chains within the budget
        x = rnd.choice(sorted(prints))
        for bit in rnd.sample(range(64), 3):
            x ^= 1 << bit
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(150)}
    order = sorted(prints)
    near = {(a, b) for k, a in enumerate(order) for b in order[:k] if (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(simhash.signed(x),) for x in order], "fp long")
    split = simhash.tries(df, 4)
    assert {r["mask"].bit_count() for r in split.select("mask").distinct().collect()} != {21}
    back = lambda x: x % (1 << 64)
    together = {}
    for r in split.collect():
        together.setdefault((r["mask"], r["bits"]), []).append(back(r["fp"]))
    met = {(max(a, b), min(a, b)) for group in together.values() for k, a in enumerate(group) for b in group[:k]}
    assert near <= met
    root = {r["node"]: r["root"] for r in simhash.components(simhash.stars(df, 4)).collect()}
    assert all(root.get(simhash.signed(a), simhash.signed(a)) == root.get(simhash.signed(b), simhash.signed(b)) for a, b in near)


def test_simhash_edge_cases(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == by[4]["component_id"] <= 4
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{k: 1 for k in range(2, 41)}, 101: 100}


# -- language model --------------------------------------------------------------------------------


def test_language_model_edge_cases(spark, odd):
    rows = language_model.score_texts(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 1
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in rows)
    assert language_model.score_texts(empty(spark)).count() == 0


def test_model_is_a_distribution():
    rows = np.array([(3, -8, -16, 50), (3, language_model.NEVER, -30, 20), (1, language_model.NEVER, language_model.NEVER, 5)])
    w = language_model.weights_of(rows, 1_000)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0 and w[3, 0] > 0.3


def test_scores_of_a_dictionary_model(spark, monkeypatch):
    """Every score against counts in dictionaries and weights by plain expectation-maximisation over
    tokens; the operator's weights come from probabilities in steps of an eighth of an octave."""
    rnd = random.Random(9)
    words = ["a", "b", "c", "dd", "e", "Ff", "g", "ÄÖ"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choice(words[: 8 if rnd.random() < 0.7 else 68]) for _ in range(rnd.randrange(40))) for _ in range(300)]
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(language_model, "RANGE_KEYS", 50)
    found = {r["doc_id"]: r for r in language_model.score_texts(docs(spark, *texts)).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [t.translate(lower).split() + ["\n"] for t in texts]
    fold = [common.fold_of_text(k) for k in range(len(texts))]

    def counts(keep):
        uni, bi, context = {}, {}, {}
        for ws, f in zip(tokens, fold, strict=True):
            if keep(f):
                for v, w in zip(["\t", *ws], ws, strict=False):
                    uni[w], bi[v, w], context[v] = uni.get(w, 0) + 1, bi.get((v, w), 0) + 1, context.get(v, 0) + 1
        return uni, bi, context, sum(uni.values())

    uni, bi, context, n = counts(lambda f: f != 1)
    size = len(uni)

    def parts(v, w, model):
        u, b, c, total = model
        return (b.get((v, w), 0) / c[v] if c.get(v) else 0.0, u.get(w, 0) / total, 1 / (size + 1))

    less = counts(lambda f: f not in (1, 2))
    seen = [(less[2].get(v, 0).bit_length(), parts(v, w, less)) for ws, f in zip(tokens, fold, strict=True) if f == 2 for v, w in zip(["\t", *ws], ws, strict=False)]

    def learn(rows, start):
        w = list(start)
        for _ in range(60):
            gained = [0.5 * s for s in start]
            for p in rows:
                total = sum(a * b for a, b in zip(p, w, strict=True))
                gained = [g + a * b / total for g, a, b in zip(gained, p, w, strict=True)]
            w = [g / sum(gained) for g in gained]
        return w

    whole = learn([p for _, p in seen], [1 / 3] * 3)
    weights = {}
    for k in range(20):
        start = whole if k else [0.0, whole[1] / (whole[1] + whole[2]), whole[2] / (whole[1] + whole[2])]
        rows = [p for o, p in seen if o == k]
        weights[k] = learn(rows, start) if rows else start
    for k, ws in enumerate(tokens):
        score = sum(np.log10(sum(a * b for a, b in zip(parts(v, w, (uni, bi, context, n)), weights[context.get(v, 0).bit_length()], strict=True))) for v, w in zip(["\t", *ws], ws, strict=False))
        assert found[k]["score"] == pytest.approx(score, rel=0.01, abs=0.02)
        assert (found[k]["n_tokens"], found[k]["n_known"], found[k]["train_tokens"]) == (len(ws), sum(w in uni for w in ws), n)


def test_blocks_round_trip():
    block = language_model.Block.of([[b"a", b"b"], [], [b"b", b"a", b"b"]], [0, 1, 2])
    again = language_model.Block.unpack(block.pack())
    assert (again.tokens == block.tokens).all() and (again.vocabulary == block.vocabulary).all() and again.lengths.tolist() == [3, 1, 4]
    again.work()
    keys, train, gone = again.asked(1)
    assert (np.diff(keys.astype(object)) > 0).all() and train.sum() == 7 and gone.sum() == 4


# -- decontamination -------------------------------------------------------------------------------


ITEM = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("windows", [1, 1_000])
def test_decontamination(spark, odd, monkeypatch, windows):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", windows)
    items = spark.createDataFrame([(10, ITEM), (9, "Short, ITEM"), (8, None), (7, "!!"), (None, "zzz")], "item_id long, text string")
    texts = docs(spark, f"before {ITEM} after", "one two three four five six seven eight nine ten", "a short item here; short item", "nothing", ITEM.replace("five", "5ive"), None)
    rows = {r["doc_id"]: r for r in decontamination.decontaminate(texts, items, spans=True).collect()}
    assert [rows[k]["n_hit"] for k in range(6)] == [11, 10, 4, 0, 0, 0]
    assert rows[0]["items"] == ["10"] and rows[2]["items"] == ["9"] and rows[5]["n_words"] == 0
    assert [tuple(s) for s in rows[0]["spans"]] == [(1, 11), (2, 12)]
    assert decontamination.decontaminate(odd, items).count() == odd.count()
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(texts, items).collect()) == [3, 4, 5]
    assert decontamination.decontaminate(empty(spark), items).count() == 0
    assert decontamination.decontaminate(texts, items.where("false")).where("contaminated").count() == 0


# -- toxicity --------------------------------------------------------------------------------------


def labelled(spark, texts, labels):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def test_toxicity_and_counterfactuals(spark, odd):
    rnd = random.Random(1)
    plain = ["table", "river", "green", "walk", "stone", "paper", "light"]
    texts, labels = [], []
    for k in range(500):
        toxic = k % 4 == 0
        words = [rnd.choice(plain) for _ in range(10)] + (["vile", "scumbag"] if toxic else ["calm", "evening"])
        words.append("frau" if k % 2 else "mann")
        if toxic and rnd.random() < 0.7 or not toxic and rnd.random() < 0.05:
            words.append("muslim")  # the term goes with the label in this sample
        elif rnd.random() < 0.05:
            words.append("christian")
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    without, with_term = (toxicity.train(*labelled(spark, texts, labels), counterfactual=c) for c in (0.0, 50.0))
    gap = lambda m: abs(m.logit("a muslim walk by the river") - m.logit("a christian walk by the river"))
    assert with_term.twins > 400 and any({"mann", "frau"} == set(k) for k in with_term.kinds) and any(len(set(plain) & set(k)) >= 4 for k in with_term.kinds)
    assert gap(with_term) < 0.2 * gap(without) and with_term.score("a muslim by the river") < 0.5 < with_term.score("the green table, you vile scumbag, by the old river of stone and paper")
    rows = toxicity.scores(odd, with_term).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scores(empty(spark), with_term).count() == 0
    assert set(toxicity.keep_clean(odd, with_term).columns) == set(odd.columns)
    assert toxicity.train(*labelled(spark, [], [])).score("x") < 0.5 and toxicity.train(*labelled(spark, ["a"] * 9, [1] * 9)).score("x") > 0.5
    assert toxicity.train(*labelled(spark, [None, "", "a b", "x" * 90_000] * 5, [0, 1, None, 1] * 5)).score(None) < 1


def test_every_swap_is_tallied():
    kinds = [["he", "she", "they"], ["red", "blue"]]
    texts = ["He saw her. She and he, he and they!\nBlue.", None, "", "none here"]
    found = toxicity.swap_tallies(iter(texts), kinds)
    at = {t: k for k, t in enumerate(t for kind in kinds for t in kind)}
    change, often = toxicity.changes([(*k, n) for k, n in found.items()], kinds, at, 7)
    brute = []
    for text in texts:
        for words in (re.findall(r"[a-z]+", x) for x in re.split(r"[.!?\n]+", (text or "").lower())):
            for kind in kinds:
                for a in {w for w in words if w in kind}:
                    for b in kind:
                        if b != a:
                            count = lambda ws, t: np.log1p(ws.count(t))
                            swapped = [b if w == a else w for w in words]
                            brute.append(tuple(round(count(words, t) - count(swapped, t), 9) for t in at))
    rows = np.zeros((change.n, 7))
    np.add.at(rows, (change.row, change.col), change.val)
    assert sorted(tuple(np.round(r[:5], 9)) for r, n in zip(rows, often, strict=True) for _ in range(int(n))) == sorted(brute)


def test_training_sample_is_bounded(spark):
    text = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = text.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    sample = toxicity.training_sample(text.unionByName(text), labels.unionByName(labels), "doc_id", "text", "toxic", 20).collect()
    assert len(sample) == 20 and all(r["text"] == "some text" for r in sample)
    held = labels.where(common.fold_of(F.col("doc_id")) == 0)
    assert toxicity.training_sample(text, held, "doc_id", "text", "toxic", 20).count() == 0


# -- licenses --------------------------------------------------------------------------------------


def test_license_scan(spark, odd):
    filler = "lorem ipsum dolor sit amet consectetur " * 40
    mit = licenses.TEMPLATES["MIT"]
    texts = [f"{filler}{mit} {filler}", f"{'w ' * k}Released under the MIT License." if (k := 3) else "", "Licensed under CC BY-NC 4.0", mit.replace("merge", "blend"), "Permission is hereby granted to nobody", None, "", filler * 300 + licenses.TEMPLATES["GPL-3.0-header"]]
    found = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs(spark, *texts)).collect()}
    assert set(found) == {(0, "MIT"), (1, "MIT-notice"), (2, "CC-BY-NC-4.0-notice"), (3, "MIT"), (7, "GPL-3.0-header")}
    assert found[0, "MIT"]["containment"] == 1.0 and 0.8 <= found[3, "MIT"]["containment"] < 1 and found[0, "MIT"]["first_word"] == 240
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty(spark)).count() == 0
    at_offsets = docs(spark, *("w " * offset + licenses.TEMPLATES["GPL-3.0-notice"] + " end" for offset in range(9)))
    assert sorted(r["doc_id"] for r in licenses.scan(at_offsets).collect()) == [*range(9)]  # wherever a copy begins


def test_license_rows_stand_for_themselves(spark, monkeypatch):
    mit = licenses.TEMPLATES["MIT"].split()
    halves = [" ".join(mit[: len(mit) // 2]), " ".join(mit[len(mit) // 2 :])]
    rows = [(i, t) for i in (None, 4) for t in halves] + [(5, " ".join(mit)), (5, " ".join(mit)), (None, " ".join(mit))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(str, licenses.scan(df).collect()))
    assert [r["doc_id"] for r in licenses.scan(df).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [None, 5, 5]
    monkeypatch.setattr(licenses, "PASS_CHARS", 3_000)
    assert len(licenses.passes(licenses.TEMPLATES)) > 2 and sorted(map(str, licenses.scan(df).collect())) == whole
    assert licenses.scan(df, {}).count() == 0


def test_near_copies_are_recalled(spark):
    """Edited copies of templates: all whose containment is 0.8 or more are found, none below."""
    rnd = random.Random(11)
    texts = []
    for name in ("MIT", "GPL-3.0-header", "Zlib", "MPL-2.0-header"):
        for k in range(60):
            words = licenses.TEMPLATES[name].split()
            for _ in range(k % 6):
                words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(["filler"] * rnd.randrange(30) + words))
    found = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs(spark, *texts)).collect()}
    expected = {(k, name): v[0] for k, t in enumerate(texts) for name, v in brute_licenses(t, 0.8).items()}
    assert set(found) == set(expected) and min(found.values()) < 0.9


def test_bands_guarantee_collisions():
    for text in licenses.TEMPLATES.values():
        m = len(text.split()) - 4
        s = licenses.scale_of(max(1, m))
        assert licenses.collision_probability(licenses.least_similarity(max(1, m)), s.bands) > 0.99
    with pytest.raises(ValueError):
        licenses.template_table(None, {"x": "too short"})


def brute_licenses(text, share):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, template in licenses.TEMPLATES.items():
        wanted = set(shingles(words(template)))
        at = [(i, s) for i, s in enumerate(shingles(words(text))) if s in wanted]
        n = len({s for _, s in at})
        if at and n / len(wanted) >= share:
            out[name] = (len(wanted), n, n / len(wanted), at[0][0], at[-1][0] + 4)
    return out


@pytest.mark.parametrize("share", [0.8, 0.3])
def test_license_scan_is_exact_over_whole_documents(spark, share):
    """Shingles that stand apart, two templates that share one, near copies, and chunk borders."""
    rng = random.Random(7)
    t = licenses.TEMPLATES
    both = ("CC-BY-4.0-notice", "GPL-3.0-notice")
    texts = []
    for k in range(60):
        gap = " ".join(f"x{rng.randrange(50)}" for _ in range(rng.randrange(60)))
        a, b = both if k % 2 else reversed(both)
        texts.append(f"{gap} {t[a]} {gap} w {t[b]} end")
    for name in t:
        for _ in range(25):
            words = t[name].split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "changed"
            cut = rng.randrange(len(words))
            texts.append(" ".join(["a"] * rng.randrange(9) + words[:cut] + ["b"] * rng.choice([0, 0, 30]) + words[cut:] + ["c"]))
    texts += ["z " * n + t["MIT"] + " z" * 40 + " " + t["MIT"] for n in (licenses.CHUNK - 40, licenses.CHUNK - 3, 2 * licenses.CHUNK - 60)]
    got = {k: {} for k in range(len(texts))}
    for r in licenses.scan(docs(spark, *texts), containment=share).collect():
        got[r["doc_id"]][r["license"]] = tuple(r)[2:]
    assert got == {k: brute_licenses(text, share) for k, text in enumerate(texts)}


# -- vectors ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 5, 900])
def test_top_k_is_exact(spark, n):
    rnd = np.random.default_rng(4)
    x = rnd.normal(0, 0.3, (n, 8)).round(3)
    x[n // 2 :] = x[: n - n // 2]  # ties
    rows = [(k, [float(v) for v in x[k]], "extra") for k in range(n)]
    rows += [(10_000, None, "x"), (10_001, [None] * 8, "x"), (10_002, [float("nan")] * 8, "x"), (10_100, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = {}
    for r in vector_search.top_k(df, F.col("id") % 100 == 0, 10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, n, 100):
        scores = sorted((-int(whole[q] @ whole[k]), k) for k in range(n) if k != q)[:10]
        assert sorted(found.get(q, [])) == [(r + 1, k, -s) for r, (s, k) in enumerate(scores)]
    assert len(found) == len(range(0, n, 100))


def test_top_k_of_odd_vectors(spark):
    """Repeated ids ask for each row; shorter vectors count as followed by zeros; large ones stay exact."""
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [2.0]), (2, [0.0, -1.0, 4.0]), (100, [5.0]), (7, [])]
    schema = "vec_id long, embedding array<double>"
    found = vector_search.top_k(spark.createDataFrame(rows, schema), F.col("id") % 100 == 0, 10, scale=1).collect()
    pad = [(k, i, (x + [0.0] * 3)[:3]) for k, (i, x) in enumerate(rows) if x]
    expected = []
    for k, i, x in pad:
        if i % 100 == 0:
            scores = sorted((-int(np.dot(x, y)), j) for m, j, y in pad if m != k)
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    big = [(k, [1e5 + k, 3e5 - 7.0 * k, 1.0]) for k in range(40)]  # products over 2**53 after scaling
    found = {(r[0], r[1]): (r[2], r[3]) for r in vector_search.top_k(spark.createDataFrame(big, schema), F.col("id") % 20 == 0, 5).collect()}
    for q in (0, 20):
        whole = {k: [int(v * 1024) for v in x] for k, x in big}
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[k], strict=True)), k) for k in whole if k != q)[:5]
        assert [found[q, r + 1] for r in range(5)] == [(k, -s) for s, k in scores] and -scores[0][0] > 2**53
    with pytest.raises(ValueError):
        vector_search.top_k(spark.createDataFrame([(0, [3e7]), (1, [1.0])], schema), F.col("id") == 0)


def test_bounds_stop_the_walk(spark):
    """In clustered vectors of one length a query is compared with a small share of them."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(0, 1, (30, 16))
    x = centres[rnd.integers(0, 30, 20_000)] + rnd.normal(0, 0.02, (20_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = vector_search.top_k(df, F.col("id") % 1_000 == 0, 10, compared=True).collect()
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 20_000, 1_000):
        scores = sorted((-int(whole[q] @ whole[k]), k) for k in range(20_000) if k != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q) == [(r + 1, k, -s) for r, (s, k) in enumerate(scores)]
    assert np.mean([r["compared"] for r in found]) < 0.25 * 20_000


# -- WARC ------------------------------------------------------------------------------------------


def test_surt_keys():
    assert warc.surt_key("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.surt_key("https://user@h.org:8080") == "org,h:8080)/"
    assert warc.surt_key(None) == "" and "\t" not in warc.surt_key("a\tb")
    assert warc.surt_key("http://[2001:DB8::1]:8080/x") == "[2001:db8::1]:8080)/x" and warc.surt_key("http://[::1]/") == "[::1])/"


@pytest.mark.parametrize("sent", [200_000, 0])
def test_archives(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_DIGESTS", sent)
    big = "<p>é</p>" * 200
    rows = [(1, "http://a.com/x", big, 0), (2, "http://a.com/x", big, 0), (9, None, big, 0), (3, "http://b.org/\r\nX: y", "small", 0), (4, "http://b.org/", "small", 0), (5, "http://b.org/", None, 0), (5, "http://b.org/", None, 0), (None, "http://c.org/", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    found = sorted(warc.archive_and_read(pages).collect(), key=str)
    assert len(found) == len(rows)
    types = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in found)
    assert types == sorted([("1", "revisit", 9), ("2", "revisit", 9), ("9", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("5", "response", None), ("None", "revisit", 9)])
    assert {r["payload_bytes"] for r in found} == {len(big.encode()), 5, 0}
    assert warc.archive_and_read(pages.where("false")).count() == 0
    member = warc.record("1", "http://x/", b"payload", None)
    assert warc.parsed(member)["payload"] == b"payload"


def test_odd_line_breaks_in_urls(spark):
    rows = [(k, f"http://h.com/{c}x{c}", f"page {k}") for k, c in enumerate("\x85\u2028\u2029\x1c\x0b\x0c\r\n\t ~")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.fresh_path(spark, "warc")
    records = warc.write_archives(pages, folder)
    for block_lines in (1, 3, 2_000):  # in the directory's lines, and in those of blocks
        shards = warc.build_index(records, folder, block_lines=block_lines)
        got = warc.read_records(warc.lookup(records, shards), payload=True).collect()
        assert sorted((int(r["page"]), bytes(r["payload"]).decode()) for r in got) == [(k, html) for k, _, html in rows]
    assert {r["page_id"] for r in warc.archive_and_read(pages).collect()} == set(range(len(rows)))


def test_ids_of_any_text_and_many_records_under_one_entry(spark):
    big = "b" * 1_000
    rows = [("a\tb", "http://h/", big), ("%-", "http://h/", big), ("", "http://h/", "x"), ("%41", "http://h/", "y"), ("zé\n", "http://h/", big)] + [(None, "http://h/", f"n{k}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = warc.archive_and_read(pages).collect()
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    expected = [(i, len(h), digest(h), "revisit" if h == big and i != "zé\n" else "response", "zé\n" if h == big and i != "zé\n" else None) for i, _, h in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    folder = common.fresh_path(spark, "warc")
    records = warc.write_archives(pages, folder)
    shards = warc.build_index(records, folder, block_lines=7)
    assert warc.lookup(records, shards).count() == len(rows)


def test_lookup_and_payloads(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.format_string("http://h%d.com/%d", F.col("id") % 3, F.col("id")).alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    folder = common.fresh_path(spark, "warc")
    records = warc.write_archives(pages, folder)
    shards = warc.build_index(records, folder, block_lines=7)
    wanted = records.where("page in ('3', '77', '499')").select("key", "page").unionByName(spark.createDataFrame([("com,none)/", "3"), ("", "")], "key string, page string"))
    got = warc.read_records(warc.lookup(wanted, shards), payload=True).collect()
    assert sorted((r["page"], bytes(r["payload"])) for r in got) == [("3", b"page 3"), ("499", b"page 499"), ("77", b"page 77")]


# -- chat ------------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    kinds = "conv_id long, turn long, role string, text string, chosen string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (1, 2, "user", "more", ""), (2, 0, "user", "same", ""), (3, None, None, None, ""), (3, 0, "user", "<|im_end|>", ""), (None, 0, "user", "x", ""), (1, 0, "user", "hi", "")], kinds)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "no!", ""), (2, 0, "user", "same", ""), (4, 0, "assistant", "alone", "")], kinds)
    rows = {(r["conv_id"], r["part"]): r for r in chat.preference_pairs(chosen, rejected).collect()}
    one = rows[1, 0]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["prompt_turns"] == 1
    assert one["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["yes<|im_end|>"] and [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["no!<|im_end|>"]
    assert rows[2, 0]["chosen"] == rows[2, 0]["rejected"] == "" and rows[2, 0]["prompt"]
    assert rows[3, 0]["chosen"] == "<|im_start|>\n<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert rows[4, 0]["chosen"] == "" and len(rows) == 4
    assert chat.preference_pairs(chosen.where("false"), rejected.where("false")).count() == 0


def test_one_row_for_a_pair_whatever_its_turn_numbers(spark):
    kinds = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "a"), (1, 5_000, "assistant", "b"), (1, 9_000, "user", "c"), (1, None, "system", "s"), (1, 0, "user", "other"), (1, 0, "user", "a")]
    chosen = spark.createDataFrame(turns, kinds)
    (row,) = chat.preference_pairs(chosen, chosen.where("turn is null or turn < 9000")).collect()
    assert row["prompt_turns"] == 4 and row["chosen"] == "<|im_start|>user\nc<|im_end|>\n" and row["rejected"] == "" and row["prompt"].index("a<") < row["prompt"].index("other")


def test_long_conversations_come_in_pieces_that_are_whole(spark):
    rnd = random.Random(8)
    turns = [(conv, k if rnd.random() < 0.9 else None, "assistant" if k % 2 else "user", f"{rnd.random()} " * rnd.randrange(1, 9)) for conv, n in ((1, 300), (2, 3), (3, 40), (4, 0)) for k in range(n)]
    turns += [(4, 0, "user", "no reply")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    other = table.where("conv_id <> 1 or turn is null or turn < 150").unionByName(spark.createDataFrame([(1, 150, "assistant", "else " * 500), (1, 160, "user", "x" * 3_000)], table.schema))
    for left, right in ((table, other), chat.echo_rejections(table)[:2]):
        whole = {r["conv_id"]: r for r in chat.preference_pairs(left, right).collect()}
        assert len(whole) == 4
        parts = {}
        for r in sorted(chat.preference_pairs(left, right, part_chars=1_000).collect(), key=lambda r: (r["conv_id"], r["part"])):
            parts.setdefault(r["conv_id"], []).append(r)
        assert len(parts[1]) > 5 and len(parts[2]) == 1
        for conv, rows in parts.items():
            for c in ("prompt", "chosen", "rejected"):
                assert "".join(r[c] for r in rows) == whole[conv][c]
            assert sum(r["prompt_turns"] for r in rows) == whole[conv]["prompt_turns"]
            for c in ("chosen", "rejected"):
                learned = lambda rows: "".join(r[c][s["start"] : s["end"]] for r in rows for s in r[c + "_spans"])  # noqa: B023, E731
                assert learned(rows) == learned([whole[conv]])
    short = [[sorted(tuple(x) for x in df.collect()) for df in chat.echo_rejections(table.where("turn is not null"), part_chars=n)[:2]] for n in (1_000, 1_000_000)]
    assert short[0] == short[1]


# -- HTML ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b  <b>c</b>", "a\n\nb c"), ("a<br>b<br/><br>c", "a\nb\n\nc"), ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n  3. q\n  4. r"), ("<table><tr><td>1<td>two<tr><th>three<td>4</table>", "1     | two\nthree | 4"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na | b"), ("<script>x<p></script>y<style>p{}</style>", "y"), ("a<div hidden>no</div><div style='display: none'>no</div><div style='color:red'>b</div>", "a\nb"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp; &eacute;", "<b> & é"),
        ("<head><title>t</title></head><body>b", "b"), ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("a<!-- c -->b<!doctype html>", "ab"), ("<p>x</p></p>", "x"), ("</div></table>a", "a"), ("a<hr>b", "a\n\n---\n\nb"), ("<img alt=' cat '>", "cat"), ("<td>a<td>b", "a\nb"), ("<table>loose<tr><td>x</table>", "loose\nx"),
    ],
)
def test_html_text(page, text):
    assert html_text.visible_text(page) == text


def brute_text(page):
    """Text outside of tags by the tokenizer states of HTML, a character at a time."""
    out, state, quote = [], "data", ""
    for k, c in enumerate(page):
        if state == "data":
            if c == "<" and re.match(r"</?[a-z]", page[k:]):
                state = "name"
            else:
                out.append(c)
        elif state == "quoted":
            state = "after" if c == quote else state
        elif c == ">":
            state = "data"
        elif state == "name":
            state = "before" if c in " \n" or c == "/" and page[k - 1] != "<" else state
        elif state == "value":
            if c in "\"'":
                state, quote = "quoted", c
            elif c not in " \n":
                state = "unquoted"
        elif state == "unquoted":
            state = "before" if c in " \n" else state
        elif c in "/" or state == "after" and c in " \n":
            state = "before"
        elif state in ("before", "after"):
            state = "before" if c in " \n" else "attribute"
        elif state == "attribute":
            state = "value" if c == "=" else "gap" if c in " \n" else state
        elif state == "gap":
            state = "value" if c == "=" else state if c in " \n" else "attribute"
    return "".join(out), state


def test_broken_attributes_lose_no_text():
    assert html_text.visible_text("<p title=it's>Lost words. It isn't here</p>") == "Lost words. It isn't here"
    assert html_text.visible_text("<a title=Bob's>Bob and many words</a><p>second paragraph doesn't show</p>") == "Bob and many words\n\nsecond paragraph doesn't show"
    assert html_text.attributes_of(" a='x>y' b=c'd e\" f = \"g\"h=i/ j") == {"a": "x>y", "b": "c'd", 'e"': "", "f": "g", "h": "i/", "j": ""}
    rng = random.Random(3)
    compared = 0
    for _ in range(5_000):
        page = "".join(rng.choice(["<b ", "<i", "</b", ">", ">", "'", '"', "=", "=", "/", " ", "x", "word ", "isn't "]) for _ in range(rng.randrange(30)))
        text, state = brute_text(page)
        if state == "data":
            compared += 1
            assert "".join(v for kind, v, _ in html_text.tokens(page) if kind == "text") == text, page
    assert compared > 1_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>k<td rowspan=3>long<td>x<tr><td>l<td>y<tr><td>m<td>z</table>", "k | long | x\nl |      | y\nm |      | z".replace("l |      | y", "l        | y").replace("m |      | z", "m        | z")),
        ("<details><summary>more</summary>inner</details><details open><summary>s</summary>shown</details>", "more\n\ns\nshown"),
        ("Size <select><option>S<option selected>M<option>L</select> now", "Size M now"),
        ("<select multiple><option>S<option>M</select>", "S\nM"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<style>.x, #y {display:none} p.z{visibility:hidden}/* .q{display:none} */ @media print { .q {display:none} } .x.w{display:block}</style><p class='a x'>no<p id=y>no<p class=z>no<p class=q>yes<div class='x w'>back</div>", "yes\n\nback"),
        ("<svg><title>t</title><text x=1>label</text><desc>no</desc></svg> and <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "label and x=1"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<table><tr><td>" + "word " * 40 + "<td>b</table>", "\n".join([("word " * 12).ljust(59)[:59] + " | b"] + [("word " * n).rstrip().ljust(59) + " |" for n in (12, 12, 4)])),
    ],
)
def test_layout(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("part", ['<a href="x ', "<a href='x\" ", "<a b=c ", "</a ", '<p a="', "<table><tr><td>x", "<blockquote>q", "<ul><li>x", "<!--", "<p><table><tr><td><div>", "<b>x</i>", "<td colspan=100>y", "<select><option>o", "<style>a", "<style>.a{display:none}</style><p class=a>"])
def test_work_and_output_are_linear(part):
    """Pages of some 300,000 characters of one odd part."""
    n = 300_000 // len(part)
    began = time.process_time()
    for tail in ("", ">", "'>\">x"):
        text = html_text.visible_text(part * n + tail)
        assert len(text) < 20 * len(part) * n
    assert time.process_time() - began < 30


def test_a_wide_table_is_not_padded():
    page = "<table>" + "".join(f"<tr><td>{'w ' * 5_000}{'<td>c' * 50}" for _ in range(20)) + "</table>"
    text = html_text.visible_text(page)
    assert len(text) < 2 * len(page) and text.count("c") == 1_000


def brute_table(rows):
    """An aligned table of cells of one line, from a grid that knows each place taken."""
    taken, placed = set(), []
    for r, row in enumerate(rows):
        at = 0
        for text, n, down in row:
            while any((r, c) in taken for c in range(at, at + n)):
                at += 1
            placed.append((r, at, n, text))
            taken.update((x, c) for x in range(r, min(len(rows), r + down)) for c in range(at, at + n))
            at += n
    wide = [max([len(text) for _, at, n, text in placed if (at, n) == (c, 1)], default=0) for c in range(max(at + n for _, at, n, _ in placed))]
    for _, at, n, text in placed:
        if n > 1:
            wide[at + n - 1] += max(0, len(text) - sum(wide[at : at + n]) - 3 * (n - 1))
    assert sum(wide) + 3 * (len(wide) - 1) <= html_text.TABLE_WIDTH
    lines = [""] * len(rows)
    for r, at, _, text in placed:
        lines[r] = (lines[r].ljust(sum(wide[:at]) + 3 * at - 3) + " | " if at else "") + text
    return "\n".join(line.rstrip(" ") for line, row in zip(lines, rows) if any(text for text, _, _ in row))


@pytest.mark.parametrize("n", [2, 40, 7_000])
def test_tables_of_any_length_are_aligned(n):
    """Narrow tables, up to some 20,000 cells, are laid out as short ones are."""
    head = f"<table><tr><td>{'word ' * 16}<td>b"
    lines = [("word " * 12).ljust(60) + "| b", ("word " * 4).ljust(60) + "|", *["a".ljust(60) + "| b"] * n]
    assert html_text.visible_text(head + "<tr><td>a<td>b" * n + "</table>").split("\n") == lines
    rng = random.Random(n)
    rows = [[("first", 1, 1)] + [(rng.choice(["a", "bb", "1,234", "in two", "|", ""]), rng.choice([1] * 9 + [2]), rng.choice([1] * 9 + [2, 3])) for _ in range(rng.randrange(5))] for _ in range(n)]
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{text}" for text, c, d in row) for row in rows) + "</table>"
    assert html_text.visible_text(page) == brute_table(rows)


def test_a_wide_table_keeps_the_bars_of_its_cells():
    wide = "".join(f"<td>{c * 90}" for c in "xyz")
    assert html_text.visible_text(f"<table><tr>{wide}<tr><td>a<td>||<td><tr><td><td>b |<tr><td><td></table>").split("\n")[1:] == ["a | ||", " | b |"]


@pytest.mark.parametrize(("row", "n", "rest", "m"), [("<td rowspan=65534>" * 80, 1, "<tr><td>x", 30_000), ("<td rowspan=9999>" * 30, 1_000, "<tr><td>x", 10_000), ("<td colspan=100>y" * 30_000, 1, "<tr><td>x", 10), ("<td rowspan=60>x", 10_000, "", 0)])
def test_work_on_long_tables_is_linear(row, n, rest, m):
    page = "<table>" + ("<tr>" + row) * n + rest * m
    began = time.process_time()
    text = html_text.visible_text(page)
    assert text.count("x") == page.count("x") and len(text) < 30 * len(page)
    assert time.process_time() - began < 30


def plain_words(page):
    """Words of a page by the standard library's parser, without layout."""
    import html.parser

    words, hidden = [], []

    class Parser(html.parser.HTMLParser):
        def handle_starttag(self, tag, attributes):
            a = dict(attributes)
            if tag in html_text.VOID:
                words.extend((a.get("alt") or "").split() if tag == "img" and not hidden else [])
            elif hidden or tag in html_text.NEVER_SHOWN or "hidden" in a or "none" in (a.get("style") or ""):
                hidden.append(tag)

        def handle_endtag(self, tag):
            if tag in hidden:
                while hidden.pop() != tag:
                    pass

        def handle_data(self, data):
            words.extend([] if hidden else data.split())

    parser = Parser(convert_charrefs=True)
    parser.feed(page)
    parser.close()
    return words


def test_no_word_of_the_pages_is_lost():
    import pyarrow.parquet as pq

    pages = [p["html"] for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist() if p["html"]]
    mark = re.compile(r"^(?:-|>|\d+\.|\||---)$")
    for page in pages:
        text = html_text.visible_text(page)
        own = [w for w in text.split() if not mark.match(w)]
        expected = [w for w in plain_words(page) if not mark.match(w)]
        assert sorted("".join(own)) == sorted("".join(expected))


def test_deep_and_long_pages(spark):
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"
    assert html_text.visible_text("<p>" + "word " * 50_000).count("word") == 50_000
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").withColumn("text", F.lit(0))
    assert sorted((str(r["page_id"]), r["text"], r["n_lines"]) for r in html_text.extract(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html_text.extract(df.where("false")).count() == 0
