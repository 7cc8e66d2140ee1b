import gzip

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.sources.store import Store
from matloom.sources.text import read_many, read_text


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    m = Matrix.from_numpy(spark, np.arange(6.0).reshape(3, 2)).with_labels(["a", "b", "c"], ["x", "y"])
    store.write("g/one", m, attributes={"unit": "cm"})
    assert store.exists("g/one") and store.attributes("g/one") == {"unit": "cm"}
    with pytest.raises(FileExistsError):
        store.write("g/one", m)
    store.set_attribute("g/one", "n", 3)
    assert store.attributes("g/one")["n"] == 3
    store.move("g/one", "h/k/two")
    with pytest.raises(ValueError):
        store.move("h/k/two", "h/k/two")
    with pytest.raises(FileNotFoundError):
        store.open("g/one")
    with pytest.raises(ValueError):
        store.open("one")
    back = store.open("h/k/two")
    assert back.dim == (3, 2) and sorted(r["name"] for r in back.row_labels.collect()) == ["a", "b", "c"]
    assert store.append("h/k/two", m).dim == (6, 2)
    np.testing.assert_allclose(store.open("h/k/two").to_numpy()[3:], m.to_numpy())
    store.set_labels("h/k/two", cols=["p", "q"])
    assert store.open("h/k/two").row_labels is None
    other = Store(spark, f"file://{tmp_path}/t")
    store.copy_to("h/k/two", other, "x/y")
    assert [r["name"] for r in other.list().collect()] == ["x/y"]
    assert store.list("h", recursive=False).count() == 0 and store.list("h").count() == 1
    store.remove("h/k/two")
    assert store.list().count() == 0


def test_text(spark, tmp_path):
    plain = tmp_path / "a.csv"
    plain.write_text("x,y\n1,2\n3,1e+05\n")
    m = read_text(spark, str(plain))
    np.testing.assert_allclose(m.to_numpy(), [[1, 2], [3, 1e5]])
    assert [r["name"] for r in m.col_labels.orderBy("idx").collect()] == ["x", "y"]
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("r\tx\nfirst\t7\nsecond\t8\n")
    named = read_text(spark, str(tmp_path / "b.tsv.gz"), rownames=True)
    assert named.to_pandas().loc["second", "x"] == 8
    assert set(read_many(spark, [str(plain)], ["g/a"])) == {"a"}
    (tmp_path / "c.csv").write_text("1,2\n3,oops\n")
    with pytest.raises(Exception):
        read_text(spark, str(tmp_path / "c.csv"), header=False).to_numpy()
    with pytest.raises(ValueError):
        read_many(spark, ["a"], [])


def test_text_keeps_the_order_of_files_and_lines(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    at = 0
    for name, lines in (("a", 3), ("b", 3000), ("c", 30), ("d", 1)):
        (folder / f"{name}.csv").write_text("x,y\n" + "".join(f"{at + k},{-(at + k)}\n" for k in range(lines)))
        at += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of a file
    try:
        m = read_text(spark, f"file://{folder}", sep=",")
        got = m.to_numpy()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[:, 0].tolist() == list(range(at)) and got[:, 1].tolist() == [-k for k in range(at)]
