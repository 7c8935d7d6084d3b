import random
import zlib

import numpy as np

from coffer.llm import toxicity as X

INSULTS = ["idiot", "moron", "worthless"]


def corpus(n=1200):
    r = random.Random(4)

    def word():
        return "".join(r.choice("aeiourtlsnmd") for _ in range(r.randint(2, 8)))

    lexicon = [word() for _ in range(1500)]
    docs, labels = [], []
    for k in range(n):
        w = [r.choice(lexicon) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.15
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(INSULTS))
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = corpus()
    rows = [(i, t, 0.5, True) for i, t in docs] + [(None, "you idiot", 0.1, None), (5000, None, 0.1, None), (5001, "", 0.1, None), (5001, "", 0.1, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean").repartition(4)
    lab = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (7777, 1, None)], "doc_id long, quality int, toxic int")
    got = X.toxicity(d, lab).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    held = [(by_id[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by_id.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    pos = np.array([r["score"] for r, y in held if y])
    neg = np.array([r["score"] for r, y in held if not y])
    assert len(pos) > 20 and (pos[:, None] > neg).mean() > 0.97
    assert by_id[None]["predicted"] == 1 and by_id[5000]["score"] == by_id[5001]["score"] < 0.3


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in X.toxicity(d, lab).collect()] == [0]
    assert X.toxicity(d.limit(0), lab).collect() == []


def kernel(a, b):
    """The kernel by definition: shared subsequences of three within the span."""
    def features(w):
        cls = X._classes_of(w).tolist()
        out, squares = {}, 0.0
        for i in range(len(cls)):
            for j in range(i + 1, len(cls)):
                for k in range(j + 1, min(len(cls), i + X.SPAN + 1)):
                    weight = X.DECAY ** (k - i)
                    key = cls[i], cls[j], cls[k]
                    out[key] = out.get(key, 0.0) + weight
                    squares += weight * weight
        return out, squares**0.5

    (x, nx), (y, ny) = features(a), features(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (nx * ny)


def test_kernel_and_margins_against_the_definition():
    words = ["idiot", "idioot", "idxiot", "banana", "moron", "ab", "a"]
    dense = np.zeros((X.CLASSES**3, 2))
    r, c, v = X._features(["idiot", "banana"])
    np.add.at(dense, (c, r), v)
    want = np.array([[kernel(w, "idiot"), kernel(w, "banana")] for w in words])
    assert np.allclose(X._kernel(words, dense), want)
    got, best = X.best_words(words + ["say idiot now", "i.d.i.o.t.", "x i d i o t", "", "1D10T"], dense[:, 0])
    assert np.allclose(got[: len(words)], want[:, 0])
    assert np.allclose(got[[len(words), len(words) + 1, len(words) + 4]], want[0, 0]) and best[len(words)] == "idiot"
    assert got[len(words) + 3] == -1.0 and got[len(words) + 2] > 0.6
    assert want[1, 0] > 0.7 and want[2, 0] > 0.5 > want[4, 0]


def test_repeated_ids_and_long_words_stay_bounded(spark, monkeypatch):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs + [(docs[1][0], f"{docs[1][1]} {'lala' * 200} {k}") for k in range(5000)], "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, y) for i, y in labels], "doc_id long, toxic int")
    sizes = {}
    saved = X.saved

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(X, "saved", counted)
    model = X.fit(d, lab, max_rows=100)
    assert 50 <= sizes["toxicity-sample"] <= 100
    assert model.weights.any()
    batch = X.pa.RecordBatch.from_pydict({"text": ["x" * 95 + " ok", None], "toxic": [0, 1]})
    words = next(iter(X._tokens([batch]))).column("word").to_pylist()
    assert sorted(map(len, words)) == [2, 15, 40]  # equal stretches in one place count once
