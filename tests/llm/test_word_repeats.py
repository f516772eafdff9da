"""Repeated word windows, filter interaction and hard negatives against brute force."""

import hashlib
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barflow.llm import common, filter_audit, hard_negatives, queries, suffix_trees
from compare import duck, rows

SF = "/root/testdata/sf0.001"


def later_words(texts, size=20):
    """By plain loops: (doc_id, words, removed, hash) of documents in ascending doc_id."""
    seen, out = set(), []
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - size + 1):
            w = tuple(words[k:k + size])
            if w in seen:
                gone.update(range(k, k + size))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got_words(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_trees.remove_later(df).collect())


@pytest.fixture(scope="module")
def mixed():
    """Documents of few and of many words, with shared passages at every distance, copies and periodic runs."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([18, 19, 20, 21, 25, 60]))] for _ in range(12)]
    texts = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.8:
                p = rng.choice(passages)
                words += p[rng.randint(0, 3):]
        if i % 10 == 0:
            words += ["la", "lb"] * rng.randint(5, 40)
        gap = rng.choice([" ", "\n", " \t ", "\x0b"])
        texts.append((i, rng.choice(["", " ", "\n"]) + gap.join(words) + rng.choice(["", " "])))
    texts += [(200 + k, texts[k][1]) for k in range(0, 160, 3)]
    return texts


def test_word_windows_as_by_loops(spark, mixed):
    df = spark.createDataFrame(random.Random(1).sample(mixed, len(mixed)), "doc_id long, text string")
    assert got_words(df) == later_words(sorted(mixed))
    assert got_words(df.repartition(7)) == later_words(sorted(mixed))


def test_common_prefixes_only_lengthen(spark, mixed, monkeypatch):
    monkeypatch.setattr(suffix_trees, "common_prefixes", lambda docs: every)
    h = suffix_trees.Hashed(*suffix_trees.spaced(*common.utf8_column(pa.array([t for _, t in mixed]))))
    n = len(h.words)
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    for share in (1, 3):
        every = [int(x) for size in (4, 8) for x in h.sequences(np.arange(0, n - size + 1, share), np.arange(0, n - size + 1, share) + size).view(np.int64)[:: size // 4]]
        assert got_words(df) == later_words(sorted(mixed))


def test_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_trees, "CHUNK", 200)  # cut within texts
    rng = random.Random(2)
    a = " ".join(rng.choice("abcde") * rng.choice([1, 2, 150]) for _ in range(400))
    texts = [(1, a), (2, "x " + a[50:]), (3, a + " " + a), (4, "é日本 " * 90)]
    raw, offs = suffix_trees.spaced(*common.utf8_column(pa.array([t for _, t in texts])))
    seen = {}
    for part, po, first, before in suffix_trees._pieces(raw, offs):
        h = suffix_trees.Hashed(part, po)
        row = np.searchsorted(h.first, h.windows(), "right") - 1
        for r, s in zip(row.tolist(), (h.windows() - h.first[row] + before).tolist()):
            seen[(first + r, s)] = seen.get((first + r, s), 0) + 1
    want = {(k, s): 1 for k, (_, t) in enumerate(texts) for s in range(len(t.split()) - 19)}
    assert seen == want
    assert sorted((r[0], r[1], r[2], r[3]) for r in got_words_here(texts)) == later_words(texts)


def got_words_here(texts):
    """The same steps without Spark's workers, so that the small CHUNK holds."""
    col = pa.array([t for _, t in texts])
    raw, offs = suffix_trees.spaced(*common.utf8_column(col))
    found = []
    for part, po, first, before in suffix_trees._pieces(raw, offs):
        h = suffix_trees.Hashed(part, po)
        row, start, n, rel, key, dig = suffix_trees.stretches(h)
        lo, hi = h.start[start], h.stop[start + n + 18] + 1
        found += [(int(key[k].astype(np.int64)), first + int(row[k]), 0, int(start[k] - h.first[row[k]] + before), int(n[k]), int(rel[k]), part[lo[k]:hi[k]].tobytes()) for k in range(len(row))]
    t = pa.table({c: pa.array(v) for c, v in zip(("akey", "rk", "rh", "start", "n", "rel", "bytes"), zip(*sorted(found)))})
    gone = {k: set() for k in range(len(texts))}
    for rk, _, s, n in zip(*suffix_trees._later(t)):
        gone[int(rk)].update(range(int(s), int(s + n) + 19))
    for k, (i, text) in enumerate(texts):
        w = text.split()
        yield i, len(w), len(gone[k]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[k]).encode()).hexdigest()


def test_word_windows_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = later_words(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = sorted(tuple(r) for r in queries.op13_word_repeats(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_word_windows_of_odd_rows(spark):
    a = " ".join(f"v{k}" for k in range(40))
    data = [(1, None), (2, ""), (3, " \n "), (4, a), (4, a), (None, a), (5, a + " tail"), (None, None), (6, "word " * 3000)]
    d = spark.createDataFrame(data, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("rk", "rh", "x", "start", "n", "kept", "akey")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in suffix_trees.remove_later(d).collect())
    assert got == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 40, 0), (False, 4, 40, 0), (False, 5, 41, 40), (False, 6, 3000, 2999), (True, 0, 0, 0), (True, 0, 40, 40)]
    assert suffix_trees.remove_later(d.limit(0)).count() == 0


def audit_by_loops(docs, labels):
    from itertools import permutations

    low, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows_ = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and low[t] < i}
        rows_.append((s or "", {k for k, x in bad.items() if x}, i in good and i is not None, i in toxic and i is not None))
    for part in {r[0] for r in rows_}:
        mine, total = [r for r in rows_ if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                total[f] += len(gone)
                out[part, order, s + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                out[part, order, s + 1].append(total[f])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(250))
    docs = [(1, None, None), (2, "", ""), (3, long, "a"), (4, long, "b"), (4, long, "b"), (None, long, "b"), (5, long + "#", None), (6, "WORD " * 300, "a"), (7, "x\x0by " * 150, "a"), (8, None, "a")]
    labels = [(3, 1, 0), (4, None, 1), (4, 1, None), (4, 0, 0), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").select("*", *[F.lit("x").alias(c) for c in ("part", "cell", "digest", "key", "first", "n", "good", "toxic", "quality")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", F.lit("y").alias("part"), F.lit("y").alias("text"))
    got = filter_audit.audit(d, lab)
    assert sorted(tuple(r) for r in got.collect()) == audit_by_loops(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert {r.good_lost for r in filter_audit.audit(d, lab.limit(0)).collect()} == {0}


def negatives_by_loops(data):
    v = {}
    for i, e, label in data:
        if i is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        v[i] = min(v.get(i, ((label + 1) % 10 if i % 7 == 0 else label, q := [int(np.floor(256 * float(x))) for x in e])), ((label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a in (i for i in v if i % 50 == 0):
        score = {i: sum(x * y for x, y in zip(v[a][1], q)) for i, (_, q) in v.items() if i != a and len(q) == len(v[a][1])}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if v[i][0] == v[a][0]][:5]:
            hard = [i for i in best if v[i][0] != v[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard[:3])]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_hard_negatives_as_by_loops(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    data = [(i, [float(x) for x in np.round(centre[i % 4] + 0.6 * rng.normal(size=6), 1)], int(rng.integers(0, 4))) for i in range(400)]
    data += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [float("inf")] * 6, 1), (1050, [0.0] * 6, 1), (1051, [], 1), (1052, [1.0] * 6, None), (None, [1.0] * 6, 1), (1100, [1.0, 2.0], 1), (1101, [1.0, 2.0], 1), (1102, [1.0, 1.4], 3), (50, data[50][1], 2), (1103, [1.0, 1.4], 3)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("x").alias(c) for c in ("part", "score", "rank", "q", "bounds", "anchor_id")])
    want = negatives_by_loops(data)
    assert sorted(tuple(r) for r in hard_negatives.mine(d).collect()) == want and len(want) > 20
    assert hard_negatives.mine(d.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-20, 20, (5000, 8))
    matrix[7] = 200
    lists = hard_negatives.SortedLists(np.arange(5000), matrix)
    scored = []
    lists.floats = type("Counted", (np.ndarray,), {"__getitem__": lambda s, k: scored.append(len(k)) or np.asarray(s)[k]})(lists.floats.shape, np.float64, lists.floats.copy())
    w = hard_negatives.Windows(np.array([-(1 << 62)]), np.array([1 << 62]), 1)
    lists.search(np.full(8, 5), w, np.ones(5000, bool))
    assert w.ids.tolist() == [7] and sum(scored) < 500


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives"])
def test_same_as_sql_at_another_size(spark, name):
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01").sql(queries.oracle_sql()[name])
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_a_shared_doc_id_loses_no_other_text(spark):
    import corpus_pipeline as cp

    a, b, c = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30)), " ".join(f"c{k}" for k in range(30))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, c), (7, c + " x"), (None, a), (8, None), (8, b + " y"), (9, a + " z")]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = sorted((r.doc_id or 0, r.text or "") for r in cp.drop_near_duplicates(spark, d, SF).collect())
    # The copies of b stand in doc_id 5 (its second text) and 8 (its second text): one of them stays.
    assert [x for x in got if not x[1].startswith("b0")] == [(0, a), (1, a), (6, c), (8, "")] and len([x for x in got if x[1].startswith("b0")]) == 1
    assert cp.drop_near_duplicates(spark, d.limit(0), SF).count() == 0


def test_workers_let_go_of_texts_they_have_cut():
    raw = np.frombuffer(b"one two three", np.uint8).copy()
    held = weakref.ref(raw)
    got = common.cuts(raw, np.array([4, 8, 13]), np.array([7, 13, 13]))
    assert got.to_pylist() == [b"two", b"three", b""]
    assert common.cuts(raw, np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []
    del got, raw
    assert held() is None


def test_a_task_lets_go_of_its_texts(monkeypatch):
    """The task that looks up the words of leaves: what it has cut is freed when the next batch comes."""
    tasks, held = [], []

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **k: tasks.append(a[0]) if name == "mapInArrow" else self

    spaced = suffix_trees.spaced

    def watched(*a):
        raw, offs = spaced(*a)
        held.append(weakref.ref(raw))
        return raw, offs

    monkeypatch.setattr(suffix_trees, "spaced", watched)
    monkeypatch.setattr(suffix_trees, "F", type("Functions", (), {"__getattr__": lambda self, name: lambda *a, **k: Rows()})())
    suffix_trees._contents(Rows(), Rows())
    text = " ".join(f"w{k}" for k in range(40))
    leaf = {"akey": 1, "start": 0, "n": 3, "rel": 2}
    x = pa.array([[leaf]], pa.list_(pa.struct([("akey", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("rel", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), x], names=["rk", "rh", "text", "x"])
    for got in tasks[0](iter([batch] * 3)):
        assert got["bytes"][0].as_py() == " ".join(f"w{k}" for k in range(22)).encode() + b" "
    del got
    assert len(held) == 3 and all(h() is None for h in held)
