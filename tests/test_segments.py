import random

from pyspark.sql import functions as F

from coffer.operators.segments import numbered, running


def test_numbered_equals_a_window(spark):
    r = random.Random(3)
    data = [("hot", r.choice([None, *range(40)]), r.random()) for _ in range(3000)]
    data += [(f"k{r.randrange(50)}", r.randrange(5), r.random()) for _ in range(500)] + [("hot", 7, 0.5)] * 900
    d = spark.createDataFrame(data, "k string, t int, pos double").repartition(7)
    got = numbered(d, ["k"], ["t", "pos"], "number").collect()
    by: dict = {}
    for k, t, x in data:
        by.setdefault(k, []).append((t is not None, t or 0, x))
    assert sorted((g["k"], g["number"]) for g in got) == sorted((k, i + 1) for k, v in by.items() for i in range(len(v)))
    for g in got:
        assert sorted(by[g["k"]])[g["number"] - 1] == (g["t"] is not None, g["t"] or 0, g["pos"])
    assert numbered(d.limit(0), ["k"], ["t", "pos"]).collect() == []


def test_running_values_across_segments(spark):
    r = random.Random(4)
    data = [(k, t, r.choice([None, r.randrange(100)])) for k in "ab" for t in range(200)]
    data += [("none", t, None) for t in range(30)]
    d = spark.createDataFrame(data, "k string, t int, v int").withColumn("seg", F.expr("t div 7"))
    got = running(d, ["k"], "seg", ["t"], sums={"total": "v"}, lasts={"past": "v"}, firsts={"next": "v"}, before={"above": "v"}, highs={"top": "v"}).collect()
    assert len(got) == len(data)
    for g in got:
        mine = [(t, v) for k, t, v in data if k == g["k"] and v is not None]
        past, rest = [v for t, v in mine if t <= g["t"]], [v for t, v in mine if t >= g["t"]]
        assert g["total"] == (sum(past) if past else None)
        assert g["top"] == max((v for t, v in mine if t <= g["t"]), default=None)
        over = [v for t, v in mine if t < g["t"]]
        assert g["above"] == (over[-1] if over else None)
        assert g["past"] == (past[-1] if past else None) and g["next"] == (rest[0] if rest else None)
