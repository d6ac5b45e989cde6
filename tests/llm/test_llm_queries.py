"""Queries of the training-data operators: against their SQL, or a brute-force version, on a small folder."""

import collections
import hashlib
import math
import os
import re
import zlib

import pytest
import xxhash
from oracle import compare

from sparkpact.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.ORACLE_SQL[name], SF)


def reference_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def bpe_row(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    decoded = lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_op3(spark):
    lib = reference_bpe()
    found = {r["doc_id"]: tuple(r)[1:] for r in Q.op3_bpe(spark, SF).collect()}
    assert found == {d["doc_id"]: bpe_row(lib, d["text"]) for d in table("documents")}


def simhash_groups(docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if words else 0

    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op4(spark):
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op4_simhash(spark, SF).collect()} == simhash_groups(table("documents"))


def test_op5(spark):
    docs = {d["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", lower(d["text"])) + ["\n"] for d in table("documents")}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    c = collections.Counter(w for i, ws in docs.items() if fold[i] != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    found = Q.op5_language_model(spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    held = [0.0, 0.0]
    for r in found:
        ws = docs[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[r["doc_id"]] == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        if r["held_out"]:
            held[0] += base
            held[1] += r["score"]
    assert held[1] > held[0]


def benchmark_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for b in items:
        ws = word.findall(lower(b["text"]))
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[i : i + 10])].add(str(b["item_id"]))
    sizes = {len(w) for w in windows}
    out = {}
    for d in docs:
        ws, hit, held = word.findall(lower(d["text"])), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                found = windows.get(tuple(ws[i : i + size]))
                if found:
                    held |= found
                    hit.update(range(i, i + size))
        out[d["doc_id"]] = (len(ws), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))
    return out


def test_op8(spark):
    assert {r["doc_id"]: tuple(r)[1:] for r in Q.op8_decontamination(spark, SF).collect()} == benchmark_hits(table("documents"), table("benchmark"))


def test_op9(spark):
    """Scores by a plain loop over the model's weights; accuracy on the held-out labels; swaps."""
    from sparkpact.llm import common, toxicity

    folder = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    found = {r["doc_id"]: r for r in Q.op9_toxicity(spark, folder).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (common.fold_of_text(i) == 0) for i, r in found.items())
    import pyarrow.parquet as pq

    labels = [x for x in pq.read_table(f"{folder}/labels.parquet").to_pylist() if common.fold_of_text(x["doc_id"]) == 0]
    right = sum(found[x["doc_id"]]["predicted"] == x["toxic"] for x in labels)
    assert right / len(labels) > 0.95
    model = toxicity.train(common.read_table(spark, folder, "documents"), common.read_table(spark, folder, "labels"))
    kind_of = {t: kind for kind in model.kinds for t in kind}

    def plain(words):
        counts = collections.Counter()
        for w in words:
            counts[w] += 1
            for k in range(4, 9):
                if w not in kind_of and len(w) >= k:
                    counts[w[:k] + "-"] += 1
        z = model.bias + model.length * math.log(1 + len(words)) + sum(model.weights.get(f, 0.0) * math.log(1 + n) for f, n in counts.items())
        return 1 / (1 + math.exp(-z))

    assert model.twins > 10_000
    moved = []
    for d in pq.read_table(f"{folder}/documents.parquet").to_pylist():
        words = re.findall(r"[^\W\d_]+", (d["text"] or "").lower())
        own = plain(words)
        assert found[d["doc_id"]]["score"] == pytest.approx(own, abs=1e-9)
        if len(words) < 200:  # all mentions of a term swapped, in a whole text
            for a in set(words) & set(kind_of):
                b = kind_of[a][(kind_of[a].index(a) + 1) % len(kind_of[a])]
                moved.append(abs(own - plain([b if w == a else w for w in words])))
    assert len(moved) > 1_000 and max(moved) < 0.05
    for text in ("the muslim woman and the christian man", "eine frau und ein mann", "la femme et le juif", "una mujer y un hombre"):
        assert model.score(text) < 0.5


def test_op10(spark):
    rows = Q.op10_html_text(spark, SF).collect()
    pages = {p["page_id"]: p["html"] for p in table("pages")}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0 and "track(" not in r["text"] and "<p>" not in r["text"]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = {d["doc_id"]: d for d in table("documents")}
    model_rows = P.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    kept = {r["doc_id"] for r in model_rows}
    groups = simhash_groups([docs[i] for i in kept])
    kept = {i for i in kept if groups[i][1] == i}
    hits = benchmark_hits([docs[i] for i in kept], table("benchmark"))
    kept = {i for i in kept if not hits[i][4]}
    lib = reference_bpe()
    assert {r["doc_id"]: tuple(r)[1:] for r in P.run(spark, SF).collect()} == {i: bpe_row(lib, docs[i]["text"]) for i in kept}
    assert 0 < len(kept) < len(docs)


def test_pipeline_stages_on_odd_rows(spark):
    """Null and repeated ids, null texts, empty tables and extra columns with clashing names."""
    import corpus_pipeline as P

    copy = "the very same text stands here more than once in this table"
    rows = [(5, copy, "a"), (5, copy, "b"), (3, copy, "c"), (None, copy, "d"), (None, "another text of its own that nobody has copied", "e"), (None, None, "f"), (7, "", "g"), (8, "q " * 60_000, "h"), (5, "a third text that has an id which stands elsewhere too", "i")]
    schema = "doc_id long, text string, kept_id string, row_0 long, row_key_0 long, fp long, component_id long, score double"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 0.5) for r in rows], schema)
    kept = P.one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["kept_id"] for r in kept.collect()) == ["c", "e", "g", "h", "i"]
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        found = stage(spark, docs, SF)
        if name != P.STAGES[-1][0]:
            assert found.columns == docs.columns
        if name != "simhash_near_dedup":
            assert found.count() == len(rows)


def test_pipeline_leaves_its_result_only(spark):
    import glob

    import corpus_pipeline as P

    from sparkpact.llm import common

    folder = common.workspace(spark).removeprefix("file://") + "/sparkpact/*"
    before = set(glob.glob(folder))
    rows = P.run(spark, SF).count()
    assert rows > 0 and [f.rsplit("/", 1)[1].split("-")[0] for f in set(glob.glob(folder)) - before] == ["bpe"]
