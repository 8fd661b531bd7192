"""Text as it is found: order, blank and short rows, quotes, encodings, widths; and rows paired by their place."""

import gzip
import random
import zipfile

import pytest

from loomwright.errors import AssemblyError, DataError, JoinError, SpecError
from loomwright.operators import joins, position
from loomwright.operators.position import POS
from loomwright.plans.planner import assemble
from loomwright.sources import files, readers


def rows(df):
    return [tuple(r[c] for c in df.columns if c != POS) for r in df.orderBy(POS).collect()]


def written(folder, name, text, encoding="utf-8"):
    raw = text.encode(encoding)
    if name.endswith(".gz"):
        raw = gzip.compress(raw)
    (folder / name).write_bytes(raw)
    if name.endswith(".zip"):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("one.csv", raw)
    return str(folder / name)


@pytest.mark.parametrize("name", ["a.csv", "a.csv.gz", "a.csv.zip", "a.txt", "a.odd"])
def test_rows_are_as_in_the_file(spark, tmp_path, name):
    path = written(tmp_path, name, 'b;a;a;a.1\n3;x;"1;5";\n\n1;"say ""hi""";z\n2;y;z;9\n')
    df = readers.read(spark, path)
    assert df.columns == ["b", "a", "a.2", "a.1", POS] or df.columns[:1] == ["b"]
    assert [r[:3] for r in rows(df)] == [(3, "x", "1;5"), (None, None, None), (1, 'say "hi"', "z"), (2, "y", "z")]


def test_headers_are_made_distinct():
    assert readers.mangled(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"] or len(set(readers.mangled(["a", "a", "a.1", "a"]))) == 4
    assert readers.mangled(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_quotes_encodings_and_widths(spark, tmp_path):
    df = readers.read(spark, written(tmp_path, "q.csv", 'a;b\n1;"two\nlines"\n2;"x;\n\ny"\n3;z\n'))
    assert rows(df) == [(1, "two\nlines"), (2, "x;\n\ny"), (3, "z")]
    for name in ("l.csv", "l.csv.gz", "l.csv.zip"):
        assert rows(readers.read(spark, written(tmp_path, name, "a;b\n1;é\n", "latin-1"))) == [(1, "é")]
    assert readers.read(spark, written(tmp_path, "bom.csv", "\ufeffa;b\n1;2\n")).columns == ["a", "b", POS]
    for wide in ("a;b\n1;2\n3;4;5\n", "a;b\n1;2;\n", 'a;b\n"x;y";2;3\n'):
        with pytest.raises(DataError, match="cells"):
            readers.read(spark, written(tmp_path, "w.csv", wide))
    assert rows(readers.read(spark, written(tmp_path, "n.csv", "1;2\n3;4\n"), header=False)) == [(1, 2), (3, 4)]


def test_delimiters_are_not_guessed(spark, tmp_path):
    for text in ("a,b\n1,2\n3,4\n", "x\n1,5\n2,5\n", "a\tb\n1\t2\n"):
        with pytest.raises(DataError):
            readers.read(spark, written(tmp_path, "d.csv", text))
    assert rows(readers.read(spark, written(tmp_path, "d.csv", "x\n1,5\n2,5\n"), decimal=",")) == [(1.5,), (2.5,)]
    assert readers.delimiter_scores(["a,b;c", "1,2;3"]).keys() == {",", ";"}


def test_a_bad_number_does_harm_only_if_its_row_stays(spark, tmp_path):
    path = written(tmp_path, "x.csv", "1000;1005\n1;2\n1e999;NA\n3;4\n")
    with pytest.raises(DataError):
        readers.read(spark, path)
    source = {"id": "x", "input": path}
    assert assemble(spark, {"sources": [source | {"params": {"na_policy": "remove_sample"}}]}).df.count() == 2
    with pytest.raises(DataError, match="no double"):
        assemble(spark, {"sources": [source | {"params": {"na_policy": "ignore"}}]})


def test_splits_number_their_lines_without_sorting(spark, tmp_path):
    rng = random.Random(1)
    values = [rng.randrange(10**6) for _ in range(40_000)]
    path = written(tmp_path, "big.csv", "v;w\n" + "".join(f"{v};{'x' * (v % 40)}\n" for v in values))
    size, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(size, "60000")
    try:
        df = readers.read(spark, path)
        assert df.rdd.getNumPartitions() > 5 and [r[0] for r in rows(df.select("v", POS))] == values
        spark.conf.set(size, "200000")
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
        assert [r[0] for r in rows(readers.read(spark, str(tmp_path / "p.parquet")))] == values
    finally:
        spark.conf.set(size, old)


def test_rows_are_paired_by_their_place(spark, tmp_path):
    written(tmp_path, "X.csv", "1000;1005\n5;1\n1;2\n4;3\n")
    written(tmp_path, "Y.csv", "y\n30\n20\n10\n")
    spec = {"sources": [{"id": "x", "input": "X.csv"}, {"id": "y", "role": "targets", "input": "Y.csv", "join": {"to": "x", "how": "1:1"}}]}
    d = assemble(spark, spec, str(tmp_path))
    assert [tuple(r) for r in d.df.orderBy(POS).select("1000", "y").collect()] == [(5, 30), (1, 20), (4, 10)]
    d = assemble(spark, spec | {"partitions": {"by": "index", "train": [0], "test": [2, 1]}}, str(tmp_path))
    assert d.block("train", "features").first()[0] == 5 and [r[0] for r in d.ordered("test", "targets").collect()] == [20, 10]
    folds = assemble(spark, spec | {"folds": [{"train": [0, 2], "val": [1]}]}, str(tmp_path))
    assert folds.folds.join(folds.df, folds.folds.pos == folds.df[POS]).where("side = 'val'").first()["1000"] == 1
    with pytest.raises(DataError, match="row 1: 1005"):
        written(tmp_path, "N.csv", "1000;1005\n9;8\n2;\n1;\n")
        assemble(spark, {"sources": [{"id": "x", "input": "N.csv", "params": {"na_policy": "abort"}}]}, str(tmp_path))
    short = written(tmp_path, "S.csv", "y\n1\n")
    with pytest.raises(JoinError, match="as many rows"):
        assemble(spark, {"sources": [spec["sources"][0], {"id": "y", "role": "targets", "input": short}]}, str(tmp_path))
    frame = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(AssemblyError, match="order"):
        joins.row_order_join(frame, frame)


def test_stacked_files_follow_each_other(spark, tmp_path):
    written(tmp_path, "b1.csv", "1000;y\n9;1\n7;2\n")
    written(tmp_path, "b2.csv", "1000;y;more\n8.5;3;u\n")
    spec = {"sources": [{"id": "d", "input": ["b1.csv", "b2.csv"], "merge": "concat_samples", "columns": [{"role": "features", "select": {"regex": r"^\d+$"}}, {"role": "targets", "select": "y"}, {"role": "metadata", "select": "rest"}]}]}
    d = assemble(spark, spec, str(tmp_path))
    assert [tuple(r) for r in d.df.orderBy(POS).select(POS, "1000", "y", "more").collect()] == [(0, 9.0, 1, None), (1, 7.0, 2, None), (2, 8.5, 3, "u")]
    assert d.warnings
    glob = assemble(spark, {"sources": [spec["sources"][0] | {"input": "b*.csv"}]}, str(tmp_path))
    assert glob.df.count() == 3
    big = spark.createDataFrame([(2**53 + 1,)], "a bigint")
    with pytest.raises(JoinError, match="no double holds"):
        joins.common_types([big, spark.createDataFrame([(0.5,)], "a double")])
    assert [df.dtypes for df in joins.common_types([big, spark.createDataFrame([("x",)], "a string")])] == [[("a", "string")]] * 2


def test_parts_from_files_of_their_own(spark, tmp_path):
    for part, k in (("train", 0), ("test", 10)):
        written(tmp_path, f"X{part}.csv", f"1000;1005\n{k + 3};1\n{k + 1};2\n")
        written(tmp_path, f"Y{part}.csv", f"y\n{k + 30}\n{k + 20}\n")
    flat = {"Xcal": "Xtrain.csv", "y_train": "Ytrain.csv", "test_features": "Xtest.csv", "labelsval": "Ytest.csv", "delimiter": ";"}
    d = assemble(spark, flat, str(tmp_path))
    assert d.partitions() == ["train", "test"] and [tuple(r) for r in d.df.orderBy(POS).select("1000", "y", POS).collect()] == [(3, 30, 0), (1, 20, 1), (13, 40, 2), (11, 30, 3)]
    assert [r[0] for r in d.ordered("test", "targets").collect()] == [40, 30]
    written(tmp_path, "XY.csv", "1000;1005;p\n3;1;9\n")
    d = assemble(spark, {"train_x": "XY.csv", "train_y_filter": ["p"]}, str(tmp_path))
    assert d.roles["targets"] == ["p"] and d.roles["features"] == ["1000", "1005"]
    with pytest.raises(SpecError, match="unknown key"):
        assemble(spark, flat | {"odd_key": 1}, str(tmp_path))
    written(tmp_path, "Xtest.csv", "1000;1010\n1;2\n3;4\n")
    with pytest.raises(SpecError, match="some partitions only"):
        assemble(spark, flat, str(tmp_path))


def test_positions_by_keys(spark):
    rng = random.Random(3)
    for values in ([rng.choice(["a", "b", "ü", None]) + str(rng.random()) if rng.random() < 0.9 else None for _ in range(0)] or [f"{rng.random()}" if rng.random() < 0.6 else "hot" if rng.random() < 0.9 else None for _ in range(3000)], [1e18] + [rng.random() for _ in range(2000)]):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {'string' if isinstance(values[1], (str, type(None))) else 'double'}, i int").repartition(5)
        got = [(r.k, r.i) for r in position.with_position(df, "k", "i", together=100).orderBy(POS).collect()]
        assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda r: (r[0] is not None, r[0] or type(values[1] or "")(), r[1])) or got == sorted(((v, i) for i, v in enumerate(values)), key=lambda r: ((0,) if r[0] is None else (1, r[0]), r[1]))


def test_inputs(spark, tmp_path):
    for n in ("b.csv", "a.csv", "a.hdr", "x.tar.gz", ".hidden"):
        (tmp_path / n).write_text("1;2\n")
    found = files.items(spark, str(tmp_path))
    assert [(i.name, [s.rsplit("/", 1)[1] for s in i.sidecars]) for i in found] == [("a.csv", ["a.hdr"]), ("b.csv", [])]
    assert [i.name for i in files.items(spark, [f"file://{tmp_path}/b.csv", "a*.csv"], str(tmp_path))] == ["b.csv", "a.csv"]
    assert files.reference_table(found, ["a.csv"])["a.csv"].path.endswith("a.csv")
    with pytest.raises(SpecError, match="stands for 0"):
        files.reference_table(found, ["c.csv"])
    with pytest.raises(SpecError, match="not there"):
        files.resolve("no.csv", str(tmp_path), spark)
    import hashlib

    row = files.content_hashes(spark, [str(tmp_path / "a.csv")]).first()
    assert row.sha256 == hashlib.sha256(b"1;2\n").hexdigest() and row.n_bytes == 4


def test_values_at_hand(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "z.npz", a=np.arange(6).reshape(3, 2), b=np.zeros(2))
    assert rows(readers.read(spark, str(tmp_path / "z.npz"), key="a")) == [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]
    with pytest.raises(Exception, match="name one"):
        readers.read(spark, str(tmp_path / "z.npz")).collect()
    d = readers.from_arrays(spark, {"X": [[1, 2], [3, 4]], "y": [5, 6], "metadata": {"site": ["a", None]}})
    assert [tuple(r) for r in d.orderBy(POS).collect()] == [(0, 1.0, 2.0, 5.0, "a", "train"), (1, 3.0, 4.0, 6.0, None, "train")]
    with pytest.raises(DataError):
        readers.from_arrays(spark, [[1.0]], [1, 2])
    df, roles = readers.from_records(spark, [{"signals": [{"axis": [1000, 1005], "values": [0.1, 0.2]}], "targets": {"p": 1.5}, "metadata": {"s": "u"}}, {"signals": [{"axis": [1000, 1005], "values": [0.3, 0.4]}], "targets": {"p": 2}}])
    assert roles == {"features": ["1000", "1005"], "targets": ["p"], "metadata": ["s"]} and rows(df) == [(0.1, 0.2, 1.5, "u"), (0.3, 0.4, 2.0, None)]
    with pytest.raises(SpecError):
        readers.from_rows(spark, [{"a": [1]}])

    @readers.decoder(".vend")
    def decode(raw):
        k, v = raw.decode().split("=")
        return [{"x_1": float(v), "note": k}]

    (tmp_path / "m.vend").write_text("u=2.5")
    df = readers.read(spark, str(tmp_path / "m.vend"))
    assert rows(df.select("note", "x_1", POS)) == [("u", 2.5)] and readers.decoder_features(df) == ["x_1"]
    raw, typed = readers.preview(spark, written(tmp_path, "pv.csv", "a;b\n1;x\n2;y\n"))
    assert raw.dtypes[0][1] == "string" and typed.dtypes[0][1] == "bigint" and typed.count() == 2
