import os

from scarpline import session
from scarpline.operators.graph import linked_groups
from scarpline.session import materialize, release, release_all, scope, shared_dir


def tables(spark):
    at = shared_dir(spark).removeprefix("file://") + f"/scarpline/{session._RUN}"
    return {n for n in os.listdir(at) if not n.startswith(".")} if os.path.isdir(at) else set()


def test_tables_are_released(spark):
    before = tables(spark)
    a = materialize(spark.range(3))
    assert len(tables(spark) - before) == 1
    release(a, a, spark.range(1))
    assert tables(spark) == before
    with scope(spark) as keep:
        materialize(spark.range(3))
        b = keep(materialize(spark.range(4)))
    assert len(tables(spark) - before) == 1 and b.count() == 4
    release(b)
    with scope(spark):
        got = {r.label for r in linked_groups(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")).collect()}
    assert got == {1} and tables(spark) == before


def test_all_tables_are_released(spark):
    materialize(spark.range(3))
    release_all(spark)
    assert tables(spark) == set()
