import random

import numpy as np
import pytest

from loomwright.errors import AssemblyError, DataError, JoinError, SpecError
from loomwright.infer import detectors
from loomwright.operators import aggregate, folds, joins, missing, partitions
from loomwright.plans.planner import assemble
from loomwright.sources import readers
from loomwright.spec import enums, model, selectors
from loomwright.spec.selectors import Header

COLUMNS = [Header("1000", "numeric"), Header("1005", "numeric"), Header("site", "string"), Header("y", "numeric")]


@pytest.mark.parametrize(("selector", "names"), [([0, -1], ["1000", "y"]), ("0:-1", ["1000", "1005", "site"]), ({"regex": "^10"}, ["1000", "1005"]), ({"name_range": ["site", "1000"]}, ["1000", "1005", "site"]), ({"dtype": "string"}, ["site"]), ({"auto": "targets"}, ["y"])])
def test_selectors(selector, names):
    assert selectors.resolve(selector, COLUMNS) == names


def test_roles():
    roles = selectors.split_roles(COLUMNS, [("metadata", "rest"), ("features", {"regex": "^10"}), ("targets", "y")])
    assert roles["metadata"] == ["site"] and roles["targets"] == ["y"]
    for bad in ([("features", "rest"), ("metadata", "rest")], [("features", "y")], [("features", ["y"]), ("targets", ["y"]), ("metadata", "rest")], [("features", [9])]):
        with pytest.raises(SpecError):
            selectors.split_roles(COLUMNS, bad)


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 1.5), (3, 2.5)], "k int, v double")
    out, audit = joins.contract_join(a, b, ["k"], coverage="warn")
    assert {(r.k, r.v, r.v__right) for r in out.collect()} == {(1, "x", 1.5), (2, "y", None), (None, "z", None)} and audit.unmatched == 2
    assert joins.contract_join(a, b, ["k"], coverage="drop")[0].count() == 1
    for how in ("complete", "error"):
        with pytest.raises(JoinError):
            joins.contract_join(a, b, ["k"], coverage=how)
    with pytest.raises(JoinError):
        joins.contract_join(a, b.union(b), ["k"], cardinality="m:1", coverage="warn")
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "k double, w int")
    assert joins.contract_join(nan, nan.withColumnRenamed("w", "u"), ["k"], coverage="drop")[0].count() == 1


def test_missing(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 4.0)], "p long, a double, b double")
    assert missing.remove_feature(df, ["a", "b"]).columns == ["p"]
    assert [r.b for r in missing.fill_across(df, ["a", "b"]).orderBy("p").collect()] == [1.0, 4.0]
    with pytest.raises(DataError, match="row 0: b"):
        missing.abort(df, ["a", "b"], "p")
    with pytest.raises(DataError):
        missing.fill_statistic(df, ["a"], "mean")


def test_partitions(spark):
    df = spark.createDataFrame([(0, "CAL"), (1, "val"), (2, None)], "p long, s string")
    got = partitions.by_column(df, "s", {"train": ["cal"], "test": ["val"]}, "drop")
    assert {(r.p, r[partitions.PARTITION]) for r in got.collect()} == {(0, "train"), (1, "test")}
    with pytest.raises(AssemblyError):
        partitions.by_column(df, "s", {"train": ["cal"], "test": ["CAL"]})
    with pytest.raises(DataError):
        partitions.by_column(df, "s", {"train": ["cal"]})


def test_text_source(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("1000;a;a\n1;2,5;x\n;3;NA\n")
    df = readers.read(spark, str(f), decimal=",")
    assert df.columns == ["1000", "a", "a.1", "__pos"] and [tuple(r) for r in df.collect()] == [(1, 2.5, "x", 0), (None, 3.0, None, 1)]
    g = tmp_path / "c.csv"
    g.write_text("a,b\n1,2\n3,4\n")
    with pytest.raises(DataError):
        readers.read(spark, str(g))


def test_assemble(spark):
    x = spark.createDataFrame([(i, float(i), "s%d" % (i % 2), "cal" if i < 3 else "val") for i in range(4)], "id long, n1 double, site string, set string")
    y = spark.createDataFrame([(i, i * 2.0) for i in range(4)], "id long, y double")
    sites = spark.createDataFrame([("s0", "north"), ("s1", "south")], "site string, region string")
    spec = {"identity": ["id"], "partitions": {"by": "column", "column": "set", "lists": {"train": ["cal"], "test": ["val"]}}, "sources": [
        {"id": "x", "input": x, "key": "id", "columns": {"features": ["n1"], "metadata": "rest"}}, {"id": "y", "input": y, "key": "id", "role": "targets"},
        {"id": "sites", "input": sites, "kind": "lookup", "role": "metadata", "join": {"on": "site", "cardinality": "m:1"}}]}
    d = assemble(spark, spec)
    assert d.partitions() == ["train", "test"] and d.block("train", "targets").count() == 3
    assert d.roles["features"] == ["n1"] and "region" in d.roles["metadata"]
    assert {(r.partition, r.role, r.n_rows) for r in d.manifest().collect()} >= {("train", "features", 3), ("test", "targets", 1)}


def fold_set(df):
    return {(r.fold, r.side, r.pos) for r in df.collect()}


def test_fold_files(spark, tmp_path):
    def at(name, text):
        (tmp_path / name).write_text(text)
        return folds.read_folds(spark, str(tmp_path / name))

    two = {(0, "train", 0), (0, "train", 1), (0, "val", 2), (1, "train", 2), (1, "val", 0), (1, "val", 1)}
    assert fold_set(at("a.csv", "fold_0,fold_1\n0,2\n1,\n")) == two
    assert fold_set(at("b.csv", "id,Fold\n2,5\n0,9\n1,9\n")) == two
    assert fold_set(at("c.csv", "x,fold\nu,9\nv,9\nw,5\n")) == two
    assert fold_set(at("d.json", '[{"train": [0, 1], "val": [2]}, {"train": [2], "test": [0, 1]}]')) == two
    assert fold_set(at("e.txt", "0,1\n2\n\n2\n0,1\n")) == two
    for name, text in (("f.json", '[{"train": [1.5]}]'), ("g.json", "{"), ("h.txt", "0\n"), ("i.txt", "a\n1\n"), ("j.csv", "fold_0,fold_1\na,1\n"), ("k.xml", "")):
        with pytest.raises(SpecError):
            at(name, text)
    assert folds.listed(spark, []).count() == 0
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(SpecError, match="yaml package"):
            at("l.yaml", "- {train: [0, 1], val: [2]}\n")
    else:
        assert fold_set(at("l.yaml", "- {train: [0, 1], val: [2]}\n- {train: [2], val: [0, 1]}\n")) == two


def test_folds_of_a_specification(spark, tmp_path):
    rows = [(i, float(i), "cal" if i % 2 else "val", None if i % 2 == 0 else "ab"[i % 4 // 2]) for i in range(8)]
    x = spark.createDataFrame(rows, "id long, n1 double, set string, cv string")
    spec = {"partitions": {"by": "column", "column": "set", "lists": {"train": ["cal"], "test": ["val"]}}, "sources": [{"id": "x", "input": x, "key": "id", "columns": {"features": ["n1"], "metadata": "rest"}}]}
    got = assemble(spark, spec | {"folds": {"column": "cv"}}).folds
    assert {(r.fold, r.side, r.pos, r.train_pos) for r in got.collect()} >= {(0, "val", 1, 0), (0, "train", 3, 1), (1, "val", 7, 3), (1, "train", 5, 2)}
    (tmp_path / "cv.txt").write_text("1,3\n5,7\n")
    d = assemble(spark, spec | {"folds": {"file": "cv.txt"}}, str(tmp_path))
    assert {(r.side, r.train_pos) for r in d.folds.collect()} == {("train", 0), ("train", 1), ("val", 2), ("val", 3)}
    assert {(r.side, r.id) for r in folds.provenance(d.df, d.folds, "id").collect()} == {("train", 1), ("train", 3), ("val", 5), ("val", 7)}
    for bad in ([{"train": [0], "val": [1]}], [{"train": [1], "val": [1]}], [{"train": [1, 1], "val": [3]}], [{"train": [9], "val": [1]}]):
        with pytest.raises(SpecError):
            assemble(spark, spec | {"folds": {"inline": bad}})


def test_variations_and_index_files(spark, tmp_path):
    x = spark.createDataFrame([(i, float(i), i + 0.5) for i in range(4)], "id long, n1 double, n2 double")
    snv = spark.createDataFrame([(i, -float(i), 0.0) for i in range(4)], "id long, n1 double, n2 double")
    (tmp_path / "a.txt").write_text("0,1\n\n3")
    (tmp_path / "b.json").write_text("[2]")
    source = {"id": "x", "input": x, "key": "id", "columns": {"features": ["n1", "n2"], "metadata": "rest"}, "variations": {"snv": snv}}
    d = assemble(spark, {"sources": [source], "partitions": {"by": "index_file", "lists": {"train": "a.txt", "test": "b.json"}}}, str(tmp_path))
    assert sorted(tuple(r) for r in d.block("train", "features:snv").collect()) == [(-3.0, 0.0), (-1.0, 0.0), (0.0, 0.0)] and d.block("test", "features:snv").first()[0] == -2.0
    for other in (snv.limit(3), snv.drop("n2"), snv.withColumnRenamed("n2", "n3"), snv.toDF("id", "a", "b").drop("b")):
        with pytest.raises(SpecError):
            assemble(spark, {"sources": [source | {"variations": {"snv": other}}]})
    (tmp_path / "bad.txt").write_text("1,x")
    with pytest.raises(SpecError):
        readers.read_positions(spark, str(tmp_path / "bad.txt"))


def test_zipped_text(spark, tmp_path):
    import zipfile

    def packed(name, **members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, text in members.items():
                z.writestr(n, text)
        return str(tmp_path / name)

    df = readers.read(spark, packed("d.csv.zip", d="1000;a;a\n1;2,5;x\n;3;NA\n7\n"), decimal=",")
    assert df.columns == ["1000", "a", "a.1", "__pos"] and [tuple(r) for r in df.orderBy("__pos").collect()] == [(1, 2.5, "x", 0), (None, 3.0, None, 1), (7, None, None, 2)]
    for bad in (packed("two.csv.zip", a="a;b\n", b="a;b\n"), packed("wide.csv.zip", a="a;b\n1;2;3\n")):
        with pytest.raises(Exception, match="one member|cells"):
            readers.read(spark, bad).collect()
    with pytest.raises(DataError):
        readers.read(spark, packed("comma.csv.zip", a="a,b\n1,2\n"))


def test_spec_reports_all_problems():
    with pytest.raises(SpecError, match="no input.*unknown key|unknown key.*no input"):
        model.parse({"sources": [{"id": "a", "role": "features", "odd": 1}]})
    assert enums.read("partition", " Calibration ") == "train"
    with pytest.raises(SpecError):
        enums.read("coverage", "some")


def test_detectors():
    assert detectors.wavelength_header([str(1000 + 5 * i) for i in range(12)]) == ("nm", 0.85)
    assert detectors.task_type(True, 2, 0, 1, 10) == ("binary", 0.9)
    assert detectors.signal_type(0.4, 1.4, 0.9, 0.2)[0] == "absorbance"
    assert detectors.signal_type(-3, 3, 0.0, 1.0) == ("preprocessed", 0.9)
    assert detectors.signal_type(0.0, 1.5, 0.3, 0.2)[0] != "reflectance%"
    assert all(map(detectors.is_id_name, ("Sample ID", "spectrum id", "scan-id", "plot_id", "id_plot", "Code"))) and not detectors.is_id_name("protein")
    assert readers.detect_delimiter(["a;b", "1;2"])[0] == ";"
    assert detectors.sample_id_score("sample_id", 1.0, "string") >= 0.5


def test_library_stands_without_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(readers.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(import|from)\s[\w.]*\bllm\b", f.read_text())


def test_quantiles_of_large_groups_are_exact(spark):
    rng = random.Random(3)
    keys = [1, 1, 1, 2, None]
    rows = [(rng.choice(keys), rng.choice([None, 0.0, 0.0, round(rng.gauss(0, 1), 2)]), rng.expovariate(1.0)) for _ in range(3000)] + [(7, None, 1.0)] * 3
    df = spark.createDataFrame(rows, "k int, x double, y double")
    shares = [0.0, 0.1, 0.5, 0.975]
    got = {r["k"]: r for r in aggregate.quantiles(df, ["k"], ["x", "y"], shares, large=2).collect()}
    assert set(got) == {1, 2, 7, None}
    for k in got:
        for c, at in (("x", 1), ("y", 2)):
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert (got[k][c] is None) if not values else np.allclose(got[k][c], np.quantile(values, shares), rtol=0, atol=1e-12)
    plain = sorted(map(str, aggregate.without_outliers(df, ["k"], ["x", "y"], 0.9).collect()))
    assert sorted(map(str, aggregate.without_outliers(df, ["k"], ["x", "y"], 0.9, large=500).collect())) == plain
    mean = {r["k"]: r for r in aggregate.robust_mean(df, ["k"], ["x", "y"]).collect()}
    for r in aggregate.robust_mean(df, ["k"], ["x", "y"], large=500).collect():
        assert (r["x"] is None) == (mean[r["k"]]["x"] is None) and (r["x"] or 0, r["y"]) == pytest.approx((mean[r["k"]]["x"] or 0, mean[r["k"]]["y"]), rel=1e-9, abs=1e-12)
