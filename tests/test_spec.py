"""Descriptions in all their shapes."""

import pytest

from loomwright.errors import AssemblyError, DataError, SpecError
from loomwright.operators.position import POS
from loomwright.plans.planner import assemble
from loomwright.spec import axes, enums, model, normalize

WL = [str(1000 + 5 * i) for i in range(6)]


def table(n, **more):
    names = [*WL, *more]
    lines = [";".join(names)] + [";".join([f"{(i * 7 + j * 3) % 11 / 10}" for j in range(6)] + [str(v[i]) for v in more.values()]) for i in range(n)]
    return "\n".join(lines) + "\n"


REGEX = {"role": "features", "select": {"regex": r"^\d+$"}}
Y = {"role": "targets", "select": ["y"]}
CASES = {
    "slice": ({"d.csv": table(6, y=range(6))}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": "0:6"}, {"role": "targets", "select": -1}]}]}),
    "selectors": ({"d.csv": table(6, p=range(6), site="ababab", notes="nnnnnn")}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, {"role": "targets", "select": ["p"]}, {"role": "metadata", "select": {"dtype": "string"}}, {"role": "ignore", "select": "rest"}]}]}),
    "range": ({"d.csv": table(6, p=range(6))}, {"sources": [{"id": "a", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": {"name_range": [WL[0], WL[-1]]}}, {"role": "targets", "select": ["p"]}, {"role": "metadata", "select": "rest"}]}]}),
    "stack": ({"a.csv": table(3, y=[1, 2, 3]), "b.csv": table(3, y=[4, 5, 6])}, {"sources": [{"id": "d", "role": "mixed", "input": ["a.csv", "b.csv"], "merge": "concat_samples", "columns": [REGEX, Y]}]}),
    "side by side": ({"n.csv": "id;n\n1;.1\n2;.2\n", "m.csv": "id;m\n2;.5\n1;.4\n"}, {"sources": [{"id": "x", "role": "features", "input": ["n.csv", "m.csv"], "merge": "concat_features", "key": "id"}]}),
    "by key": ({k: f"id;{k[0]}\n1;1\n2;2\n" for k in ("a.csv", "b.csv", "c.csv")}, {"sources": [{"id": "d", "role": "features", "input": ["a.csv", "b.csv", "c.csv"], "merge": "by_key", "key": "id"}]}),
    "row order": ({"X.csv": table(6), "Y.csv": "y\n5\n4\n3\n2\n1\n0\n"}, {"sources": [{"id": "x", "role": "features", "input": "X.csv"}, {"id": "y", "role": "targets", "input": "Y.csv", "join": {"to": "x", "how": "1:1"}}]}),
    "lookup": (
        {"a.csv": f"{WL[0]};p;site\n.1;1;S1\n.2;2;S2\n", "b.csv": f"{WL[0]};p;site\n.3;1;S2\n.4;2;S1\n", "s.csv": "site;region\nS1;n\nS2;s\n"},
        {"sources": [{"id": "m", "role": "mixed", "input": ["a.csv", "b.csv"], "merge": "concat_samples", "columns": [{"role": "features", "select": [WL[0]]}, {"role": "targets", "select": ["p"]}, {"role": "metadata", "select": ["site"]}]}, {"id": "s", "kind": "lookup", "input": "s.csv", "columns": [{"role": "metadata", "select": ["region"]}], "join": {"to": "m", "on": "site", "how": "m:1", "coverage": "complete"}}]},
    ),
    "one to many": ({"x.csv": f"sid;{WL[0]}\n1;.1\n2;.2\n", "t.csv": "sid;y\n1;10\n1;11\n2;20\n"}, {"sources": [{"id": "x", "role": "mixed", "input": "x.csv", "key": "sid", "columns": [{"role": "features", "select": [WL[0]]}]}, {"id": "t", "role": "targets", "input": "t.csv", "columns": [Y], "join": {"to": "x", "left_on": "sid", "right_on": "sid", "how": "1:m"}}]}),
    "composite": ({"x.csv": f"a;b;{WL[0]}\n1;p;.1\n1;q;.2\n", "y.csv": "a;b;y\n1;q;2\n1;p;1\n"}, {"sample_index": {"by": "id", "key": ["a", "b"]}, "sources": [{"id": "x", "role": "mixed", "input": "x.csv", "key": ["a", "b"], "columns": [{"role": "features", "select": [WL[0]]}]}, {"id": "y", "role": "targets", "input": "y.csv", "key": ["a", "b"], "columns": [Y], "join": {"left": "x", "right": "y", "left_on": ["a", "b"], "right_on": ["a", "b"], "how": "1:1", "coverage": "complete"}}]}),
    "column split": ({"d.csv": table(8, y=range(8), set=["cal"] * 4 + ["val"] * 4)}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, Y, {"role": "metadata", "select": ["set"]}]}], "partitions": {"by": "column", "column": "set", "train_values": ["cal"], "test_values": ["val"]}}),
    "index split": ({"d.csv": table(10, y=range(10))}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, Y]}], "partitions": {"by": "index", "train": [0, 1, 2, 3, 4, 5, 6], "test": [7, 8, 9]}}),
    "index files": ({"d.csv": table(8, y=range(8)), "tr.txt": "0\n1\n2\n3\n4\n", "te.txt": "[5, 6, 7]\n"}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, Y]}], "partitions": {"by": "index_file", "train_file": "tr.txt", "test_file": "te.txt"}}),
    "auto": ({"d.csv": table(6, y=range(6))}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "targets", "select": "auto"}, {"role": "features", "select": "rest"}]}]}),
    "inline folds": ({"X.csv": table(6), "Y.csv": "y\n0\n1\n2\n3\n4\n5\n"}, {"sources": [{"id": "x", "input": "X.csv"}, {"id": "y", "role": "targets", "input": "Y.csv", "join": {"to": "x", "how": "1:1"}}], "folds": {"inline": [{"train": [0, 1, 2, 3], "val": [4, 5]}]}}),
    "fold file": ({"X.csv": table(6), "f.csv": "fold_0,fold_1\n0,2\n1,3\n,4\n,5\n"}, {"sources": [{"id": "x", "input": "X.csv"}], "folds": {"file": "f.csv", "format": "csv"}}),
    "fold column": ({"d.csv": table(6, y=range(6), cv=[0, 1, 0, 1, 0, 1])}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, Y, {"role": "metadata", "select": ["cv"]}]}], "folds": {"column": "cv"}}),
    "weights": ({"d.csv": table(6, y=range(6), w=[1, 1, 2, 0.5, 1, 1.5])}, {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [REGEX, Y, {"role": "weights", "select": ["w"]}]}]}),
    "variation": ({"X.csv": table(6), "snv.csv": table(6), "Y.csv": "y\n0\n1\n2\n3\n4\n5\n"}, {"sources": [{"id": "x", "input": "X.csv", "variations": [{"name": "snv", "input": "snv.csv"}]}, {"id": "y", "role": "targets", "input": "Y.csv", "join": {"to": "x", "how": "1:1"}}]}),
}


@pytest.mark.parametrize("case", CASES)
def test_shapes(spark, tmp_path, case):
    given, spec = CASES[case]
    for name, text in given.items():
        (tmp_path / name).write_text(text)
    d = assemble(spark, spec, str(tmp_path))
    assert d.roles["features"] and all(d.block(p, "features").count() for p in d.partitions())
    again = model.parse(model.parse(normalize.normalized(spec)).to_dict())
    assert again == model.parse(normalize.normalized(spec))
    if case == "auto":
        assert d.roles["targets"] == ["y"]
    if case == "row order":
        assert [r[0] for r in d.ordered("train", "targets").collect()] == [5, 4, 3, 2, 1, 0]
    if case == "composite":
        assert {(r.b, r.y) for r in d.df.collect()} == {("p", 1), ("q", 2)}
    if case == "variation":
        assert d.roles["features:snv"] == [f"snv__{w}" for w in WL]
    if case == "index files":
        assert d.block("train", "features").count() == 5 and d.block("test", "features").count() == 3


@pytest.mark.parametrize(("coverage", "n"), [("warn", 3), ("drop", 2)])
def test_coverage(spark, tmp_path, coverage, n):
    (tmp_path / "x.csv").write_text("1000;site\n.1;S1\n.2;S2\n.3;S3\n")
    (tmp_path / "s.csv").write_text("site;region\nS1;n\nS2;s\n")
    spec = {"sources": [{"id": "x", "role": "mixed", "input": "x.csv", "columns": [{"role": "features", "select": ["1000"]}, {"role": "metadata", "select": ["site"]}]}, {"id": "s", "kind": "lookup", "input": "s.csv", "columns": [{"role": "metadata", "select": ["region"]}], "join": {"to": "x", "on": "site", "how": "m:1", "coverage": coverage}}]}
    d = assemble(spark, spec, str(tmp_path))
    assert d.df.count() == n and d.audits[0].unmatched == 1 and (d.audits[0].left_rows, d.audits[0].right_rows) == (3, 2) and bool(d.warnings) == (coverage == "warn")
    for bad in ({"on": "nowhere", "how": "m:1"}, {"on": "site", "how": "m:1", "coverage": "error"}):
        with pytest.raises(AssemblyError):
            assemble(spark, {"sources": [spec["sources"][0], spec["sources"][1] | {"join": {"to": "x"} | bad}]}, str(tmp_path))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"columns": [{"role": "features"}]}, "role and select"), ({"join": {"to": "nobody"}}, "no source"), ({"join": {"to": "b", "how": "m:1"}}, "needs keys"), ({"join": {"to": "b", "odd": 1}}, "unknown key"),
        ({"merge": "by_key"}, "needs a key"), ({"input": ["a", "b"]}, "need a merge"), ({"variations": [{"input": "v"}]}, "name and input"), ({"partition": "some"}, "no partition"), ({"role": "features", "columns": [{"role": "targets", "select": "y"}]}, "other roles"),
        ({"columns": [{"role": "features", "select": "rest"}, {"role": "targets", "select": "rest"}], "role": "mixed"}, "only one"), ({"params": {"na": {"policy": "never"}}}, "no na_policy"), ({"join": {"on": "a", "left_on": "b", "right_on": "b"}}, "either on"),
    ],
)
def test_wrong_sources(change, message):
    with pytest.raises(SpecError, match=message):
        model.parse({"sources": [{"id": "a", "input": "a"} | change, {"id": "b", "input": "b"}]})


def test_wrong_descriptions():
    good = [{"id": "a", "input": "a"}]
    for spec, message in (
        ({"sources": []}, "no source"), ({"sources": good * 2}, "have the id a"), ({"sources": [{"id": "a", "role": "targets", "input": "a"}]}, "has features"), ({"sources": good, "partitions": {"by": "column", "train_values": ["a"], "test_values": ["A"], "column": "s"}}, "is in train and in test"),
        ({"sources": good, "partitions": {"by": "index"}}, "needs a list"), ({"sources": good, "partitions": {"by": "index", "train": [0], "column": "s"}}, "no meaning"), ({"sources": good, "folds": {"inline": [], "file": None}}, "one of inline"), ({"sources": good, "sample_index": {"by": "id"}}, "needs a key"),
        ({"sources": good, "schema_version": 2}, "schema version"), ({"sources": [*good, {"id": "l", "kind": "lookup", "input": "l"}]}, "never joined"), ({"sources": good, "odd": 1}, "unknown key"),
    ):
        with pytest.raises(SpecError, match=message):
            model.parse(spec)


def test_spellings():
    assert enums.read("partition", "holdout") == "test" and enums.read("header_unit", "CM_1") == "cm-1"
    flat = normalize.canonical({"X-Train": "a", "calibration_labels": "b", "testMeta": "c", "trainparams": {}, "spectra_val_filter": [0], "cv": "f", "task": "regression"})
    assert flat == {"train_x": "a", "train_y": "b", "test_group": "c", "train_params": {}, "test_x_filter": [0], "folds": "f", "task_type": "regression"}
    spec = normalize.normalized({"train_x": ["a", "b"], "train_y": "y", "aggregate": "id", "aggregate_method": "median", "decimal_separator": ","})
    assert [s["id"] for s in spec["sources"]] == ["train_x_0", "train_x_1", "train_y"] and spec["sources"][2]["join"] == {"to": "train_x_0", "how": "1:1"}
    assert spec["aggregate"]["method"] == "median" and model.parse(spec | {"sources": [{"id": "a", "input": "a"}]}).params.decimal == ","


def test_params_merge_field_by_field():
    spec = model.parse({"params": {"delimiter": ",", "na": {"policy": "replace", "fill": {"method": "value", "value": 7}}}, "sources": [{"id": "a", "input": "a", "params": {"decimal_separator": ","}}]})
    own = spec.sources[0].params.over(spec.params).over(model.DEFAULTS)
    assert (own.delimiter, own.decimal, own.na_policy, own.fill_value, own.header) == (",", ",", "replace", 7, True)


def test_text_targets(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1000;kind\n3;b\n1;a\n2;b\n4;NA\n")
    source = {"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": "1000"}, {"role": "targets", "select": "kind"}]}
    d = assemble(spark, {"sources": [source]}, str(tmp_path))
    assert [r[0] for r in d.ordered("train", "targets").collect()] == [0.0, 1.0, 0.0, None]
    assert [r.label for r in d.decoded("kind").orderBy(POS).collect()] == ["b", "a", "b", None]
    kept = assemble(spark, {"sources": [source], "params": {"categorical": "preserve"}}, str(tmp_path))
    assert [r[0] for r in kept.ordered("train", "targets").collect()] == ["b", "a", "b", None]
    (tmp_path / "d.csv").write_text("1000;kind\n3;1,5\n1;2,5\n")
    with pytest.raises(DataError, match="decimal comma"):
        assemble(spark, {"sources": [source]}, str(tmp_path))


def test_numbers_part_by_equality(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1000;s\n1;1.0\n2;-0.0\n3;0.0\n4;2.5\n")
    source = {"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": "1000"}, {"role": "metadata", "select": "s"}]}
    parts = lambda **lists: {r["1000"]: r["__partition"] for r in assemble(spark, {"sources": [source], "partitions": {"by": "column", "column": "s", "unknown_policy": "drop"} | lists}, str(tmp_path)).df.collect()}
    assert parts(train_values=[1], test_values=["2.5", 0.0]) == {1: "train", 4: "test", 3: "test"}
    assert parts(train_values=[-0.0], test_values=["1", "2.50 "]) == {2: "train", 1: "test"}


def test_stems_derived_keys_and_aggregation(spark, tmp_path):
    for n, v in (("s1", 3), ("s2", 1)):
        (tmp_path / f"{n}.csv").write_text(f"1000;1005\n{v};{v + 1}\n{v + 2};{v + 3}\n")
    (tmp_path / "ref.csv").write_text("name;y\ns2;20\ns1;10\n")
    spec = {"sources": [{"id": "x", "role": "features", "input": "s*.csv", "merge": "concat_samples", "key": "filename_stem"}, {"id": "r", "kind": "lookup", "role": "targets", "input": "ref.csv", "join": {"to": "x", "left_on": "filename_stem", "right_on": "name", "how": "m:1"}}], "aggregate": {"by": "filename_stem", "method": "mean"}}
    d = assemble(spark, spec, str(tmp_path))
    assert [tuple(r) for r in d.df.orderBy(POS).select("filename_stem", "1000", "y").collect()] == [("s1", 3, 10), ("s1", 5, 10), ("s2", 1, 20), ("s2", 3, 20)]
    assert {(r.filename_stem, r["1000"], r.y) for r in d.aggregated().collect()} == {("s1", 4.0, 10.0), ("s2", 2.0, 20.0)}
    (tmp_path / "d.csv").write_text("scan;1000\na_r1;1\na_r2;2\nb_r1;3\n")
    own = {"sample_index": {"by": "id", "key": "sample", "derive": {"from": "scan", "strip_suffix": r"_r\d+$"}}, "sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": "1000"}, {"role": "metadata", "select": "rest"}]}]}
    assert [r["sample"] for r in assemble(spark, own, str(tmp_path)).df.orderBy(POS).collect()] == ["a", "a", "b"]


def test_axes():
    axis = axes.axis_of(["1000", "1005.50"], "nm")
    assert (axis.name, [str(x) for x in axis.coordinates]) == ("wavelength", ["1000", "1005.50"]) and axes.axis_of(["a"]).coordinates is None
    assert axes.permutation(["1000", "1005"], ["1005.0", "1000"]) == [1, 0]
    with pytest.raises(SpecError):
        axes.permutation(["a", "b"], ["a", "c"])
