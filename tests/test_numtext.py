import math
import random
import struct

from coffer.functions.numtext import with_python_texts


def test_texts_equal_repr(spark):
    r = random.Random(7)
    values = [0.0, -0.0, 1.0, -1.5, 1e-5, 0.0001, 0.0005, 1e15, 1e16, 9999999999999998.0, 123456789012345680.0, 2e23, 2.0**-44]
    values += [math.nan, math.inf, -math.inf, 1.7976931348623157e308, 2.2250738585072014e-308, 2e-3, 100.0, 1e22, 5e-310]
    values += [struct.unpack("<d", r.randbytes(8))[0] for _ in range(20_000)]
    values += [r.uniform(0, 10 ** r.randint(-8, 12)) for _ in range(20_000)] + [round(r.uniform(0, 1e5), 2) / 3 for _ in range(20_000)]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    got = {q["k"]: q["t"] for q in with_python_texts(d, {"x": "t"}).collect()}
    assert [got[k] for k in range(len(values))] == [repr(v) for v in values]
    null = spark.createDataFrame([(None,)], "x double")
    assert [q["t"] for q in with_python_texts(null, {"x": "t"}).collect()] == [None]
