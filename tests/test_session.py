import os

import pytest

from vellum.session import materialize, scratch, settled, shared_dir, written_bytes


class Elsewhere:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        shared_dir(Elsewhere())


def there(df):
    return os.path.exists(df._vellum_path.removeprefix("file:"))


def test_scratch_and_settled(spark):
    with scratch():
        a = materialize(spark.range(3))
        assert there(a) and written_bytes(a) > 0
    assert not there(a)
    assert written_bytes(spark.range(3)) is None
    made = []

    @settled
    def double(n):
        made.append(materialize(spark.range(n)))
        return made[-1].selectExpr("id * 2 AS id")

    out = double(3)
    assert there(out) and not there(made[0])
    assert sorted(r.id for r in out.collect()) == [0, 2, 4]
    with scratch():
        inner = double(2)
        assert there(inner)
    assert not there(inner)
