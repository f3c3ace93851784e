import numpy as np
import pyarrow as pa
import pytest

from scholion.llm import common
from scholion.llm.common import byte_buffer, id_remainder, materialize, scratch_dir, sliding_least
from scholion.llm.graph import components


def test_sliding_least():
    r = np.random.default_rng(1)
    for n, w in ((5, 5), (17, 4), (100, 7), (8, 1)):
        x = r.integers(0, 50, n)
        assert sliding_least(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


def test_byte_buffer():
    for kind in (pa.binary(), pa.large_binary()):
        a = pa.array([b"ab", None, b"", b"cde"], kind)
        for part in (a, a.slice(1), a.slice(3), a.slice(0, 0)):
            data, at = byte_buffer(part)
            assert [bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] == [x or b"" for x in part.to_pylist()]


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_remainder_and_scratch(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, -5, 10**12)] + [(None,)], "doc_id long")
    got = {x[0]: x[1] for x in df.select("doc_id", id_remainder("doc_id", 3)).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 for i in (0, 7, -5, 10**12, None)}
    kept = materialize(df, "t")
    assert kept.count() == 5 and any(scratch_dir(spark).removeprefix("file://") in f for f in kept.inputFiles())


def test_settled_leaves_its_result_only(spark):
    """Also where calls are nested, and where one fails."""

    def written():
        path = spark._jvm.org.apache.hadoop.fs.Path(common.scratch_dir(spark))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {x.getPath().getName().split("-")[0] for x in fs.listStatus(path)} & {"way", "inner", "outer", "lost"}

    def inner():
        return common.materialize(spark.range(5), "way").where("id > 1")

    def outer():
        one = common.settled(inner, "inner")
        assert written() == {"inner"}
        return one.unionByName(common.materialize(spark.range(2), "way"))

    assert sorted(x.id for x in common.settled(outer, "outer").collect()) == [0, 1, 2, 3, 4]
    assert written() == {"outer"}
    with pytest.raises(ZeroDivisionError):
        common.settled(lambda: 1 // 0, "lost")
    common.materialize(spark.range(2), "way")
    assert written() == {"outer", "way"}
