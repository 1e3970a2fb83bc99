import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from siltworks.sources import exports


def test_one_of_two_writers_wins(spark, tmp_path):
    """Both read version 0, both have written their rows whole, then both claim version 1."""
    path = str(tmp_path / "table")
    table = exports.Versions(spark, path)
    assert table.last() is None and table.replace(spark.range(1), None) == 0
    a, b = (exports.Versions(spark, path) for _ in range(2))
    names = a.prepare(spark.range(10)), b.prepare(spark.range(20))
    assert a.last() == b.last() == 0 and table.read()[0].count() == 1  # nothing of them is seen

    def claim(who, name):
        try:
            return who.claim(name, 0)
        except ValueError:
            return None

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(claim, (a, b), names))
    assert sorted(got, key=str) == [1, None]
    won = got.index(1)
    assert table.read()[0].count() == (10, 20)[won] and table.read(0)[0].count() == 1
    assert table.unclaimed() == [names[1 - won]] and sorted(os.listdir(f"{path}/attempts")) == sorted([*names, os.path.basename(table.folder(0))])
    with pytest.raises(ValueError, match="changed meanwhile"):
        a.replace(spark.range(3), 0)


def test_half_written_is_neither_seen_nor_moved(spark, tmp_path):
    path = str(tmp_path / "table")
    table = exports.Versions(spark, path)
    table.replace(spark.range(5), None)
    os.makedirs(f"{path}/attempts/slow/_temporary")
    assert table.replace(spark.range(6), 0) == 1 and table.read()[0].count() == 6
    assert os.path.isdir(f"{path}/attempts/slow/_temporary") and table.unclaimed() == ["slow"]


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "marker")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: exports.put_if_absent(spark, path, f"writer {i}" * 1000), range(16)))
    assert sum(won) == 1 and exports.read_text(spark, path).strip() == f"writer {won.index(True)}" * 1000
    assert os.listdir(tmp_path) == ["marker"] or {f for f in os.listdir(tmp_path) if not f.endswith(".crc")} == {"marker"}
