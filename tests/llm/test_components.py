import random

from fieldloom.llm.common import Scratch, shared_dir
from fieldloom.llm.components import connected_components


def brute(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {(n, c) for n, c in label.items() if n != c}


def test_components_equal_brute_force(spark):
    r = random.Random(5)
    chain = [(k, k + 1) for k in range(0, 40)]
    r.shuffle(chain)
    star = [(100 + k, 100) for k in range(60)]
    loops = [(200, 200), (201, 202), (202, 201), (201, 202)]
    graph = [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(25)]
    edges = chain + star + loops + graph
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(x.a, x.b) for x in found.df.collect()} == brute(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).df.count() == 0
    assert connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).df.count() == 2


def test_scratch_is_cleared(spark):
    scratch = Scratch()
    assert scratch.write(spark.range(3), "x").count() == 3
    path = scratch.stages[0].path
    assert path.startswith(shared_dir(spark))
    scratch.clear()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
