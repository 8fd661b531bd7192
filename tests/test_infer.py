"""Guesses about files and frames, and datasets loaded from them."""

import json
import math
import random

import pytest

import loomwright
from loomwright import __main__ as command
from loomwright import package
from loomwright.errors import DataError, SpecError
from loomwright.infer import conventions, describe, identity, propose
from loomwright.operators.position import POS
from loomwright.spec.schema import json_schema

WL = [str(1000 + 50 * i) for i in range(20)]


def spectra(n, shape="absorbance", seed=1):
    rng = random.Random(seed)
    low, high = {"absorbance": (0.4, 1.4), "reflectance": (0.2, 0.8)}.get(shape, (0, 0))
    cell = (lambda: rng.gauss(0, 1)) if shape == "snv" else lambda: rng.uniform(low, high)
    return [[cell() for _ in WL] for _ in range(n)]


def written(path, names, rows, sep=";"):
    path.write_text("\n".join([sep.join(names), *(sep.join(map(str, r)) for r in rows)]) + "\n")


# Six cases: what the structure, the signal, the task and the columns of each are.
def corpus(root):
    rng = random.Random(4)
    out = []
    for nth, (shape, task) in enumerate([("absorbance", "regression"), ("snv", "regression"), ("reflectance", "binary"), ("absorbance", "multiclass")]):
        own = root / f"single{nth}"
        own.mkdir()
        target = {"regression": lambda i: round(rng.uniform(5, 20), 3), "binary": lambda i: i % 2, "multiclass": lambda i: i % 4}[task]
        written(own / "data.csv", [*WL, "target"], [[*x, target(i)] for i, x in enumerate(spectra(30, shape, nth))])
        out.append((str(own / "data.csv"), "single_combined", {"snv": "preprocessed"}.get(shape, shape), task, dict.fromkeys(WL, "features") | {"target": "targets"}))
    own = root / "pair"
    own.mkdir()
    written(own / "X.csv", WL, spectra(30))
    written(own / "Y.csv", ["y"], [[round(rng.uniform(5, 20), 3)] for _ in range(30)])
    out.append((str(own), "x_y_separate", "absorbance", "regression", {}))
    own = root / "folder"
    own.mkdir()
    for part in ("cal", "val"):
        written(own / f"X{part}.csv", WL, spectra(30))
        written(own / f"Y{part}.csv", ["y"], [[round(rng.uniform(5, 20), 3)] for _ in range(30)])
    out.append((str(own), "train_test_folder", "absorbance", "regression", {}))
    return out


def test_six_cases(spark, tmp_path):
    right = {"structure": 0, "task": 0, "signal": 0, "roles": []}
    cases = corpus(tmp_path)
    for where, structure, signal, task, roles in cases:
        plan = loomwright.infer(spark, where)
        right["structure"] += plan.structure.value == structure
        right["task"] += plan.task_type.value == task
        right["signal"] += plan.signal_type.value == signal
        right["roles"] += [roles[c["col"]] == c["role"] for c in plan.columns]
        d = loomwright.load(spark, plan)
        assert d.roles["features"] and d.roles["targets"] and json.dumps(plan.to_dict(), default=str)
    assert right["structure"] == right["task"] == len(cases) and right["signal"] >= len(cases) / 2 and sum(right["roles"]) >= 0.9 * len(right["roles"])
    assert d.partitions() == ["train", "test"] and d.df.count() == 60


def test_names_of_files():
    m = conventions.match(["Xcal.csv", "Ycal.csv", "xval.csv.gz", "val_y.csv", "meta_train.csv", "cv_folds.csv", "readme.md", "x.tar.gz", "notes.csv"], ["classic"])
    assert {(a.name, a.role, a.partition) for a in m.assignments} == {("Xcal.csv", "features", "train"), ("Ycal.csv", "targets", "train"), ("meta_train.csv", "metadata", "train"), ("xval.csv.gz", "features", "test"), ("val_y.csv", "targets", "test")}
    assert m.folds == ["cv_folds.csv"] and set(m.unmatched) == {"readme.md", "x.tar.gz", "notes.csv"}
    assert [s["id"] for s in conventions.to_spec(m)["sources"]] == ["train_x", "train_y", "train_m", "test_x", "test_y"]
    several = conventions.match(["nir_xtrain.csv", "mir_xtrain.csv", "ytrain.csv", "my_ytrain.csv"], ["classic"])
    assert [s["id"] for s in conventions.to_spec(several)["sources"]] == ["train_x_0", "train_x_1", "train_y"] and several.warnings and several.unmatched == ["my_ytrain.csv"]
    bare = conventions.match(["X.csv", "y.csv", "group.csv", "Xtrain.csv"], ["classic"])
    assert {(a.name, a.score) for a in bare.assignments} == {("Xtrain.csv", 0.9), ("y.csv", 0.75), ("group.csv", 0.75)} and bare.unmatched == ["X.csv"]
    assert conventions.found_in("my_x_file", "x") and not conventions.found_in("mix", "x") and conventions.found_in("amixb", "mix")
    vendor = conventions.match(["a.spc", "b.spc", "reference.csv"], ["classic", "vendor-corpus"])
    assert vendor.spectra == ["a.spc", "b.spc"] and vendor.reference == ["reference.csv"]
    own = conventions.profile('{"profile": "own", "roles": {"train_x": ["scans"], "train_y": ["lab"]}, "bare": {"meta": ["info"]}}')
    assert [a.role for a in conventions.match(["scans1.csv", "lab.csv", "info.csv"], [own]).assignments] == ["features", "targets", "metadata"]
    assert conventions.profile('profile = "t"\n[roles]\ntrain_x = ["q1q"]\n').patterns == {("x", "train"): ["q1q"]}
    for bad in ("nowhere", {"roles": {}}, {"profile": "p", "roles": {"odd_x": []}}):
        with pytest.raises(SpecError):
            conventions.profile(bad)


def test_what_records_say():
    d = describe.describe_records(["a;b,c", "1,5;2", "2,5;3"])
    assert (d.delimiter, d.decimal, d.has_header) == (";", ",", True)
    assert describe.decimal_mark([["h"], ["1,000"], ["12,500"]])[0] == "." and describe.decimal_mark([["h"], ["1,5"], ["2,25"]])[0] == ","
    assert describe.header([["1", "2"], ["3", "4"]]) == (False, 0.7) and describe.header([["a", "b"], ["3", "4"]])[0]
    assert describe.header([WL, ["1"] * 20])[0] and describe.header_unit(WL) == ("nm", 0.8)
    assert describe.header_unit([str(4000 + i) for i in range(12)])[0] in ("cm-1", "nm") and describe.header_unit(["abc", "feature_1"])[0] == "text" and describe.header_unit(["", " "]) == ("text", 0.5)
    assert describe.describe_records(["a,b\tc,d", "1,2\t3,4"]).delimiter == ","


def test_identity(spark):
    df = spark.createDataFrame([(f"s{i // 2}_r{i % 2}", f"s{i // 2}", float(i)) for i in range(20)], "scan string, sample_id string, x double")
    assert identity.sample_id(spark.createDataFrame([(i, f"n{i}", i * 0.5) for i in range(9)], "x int, `Spectrum ID` string, id_y double"))[0] == "Spectrum ID"
    assert identity.replicate_suffix(df, "scan")[0] == "r" and identity.replicate_suffix(df, "sample_id") is None
    sites = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "sample_id string, site int")
    assert identity.relation(df, sites, "sample_id") == "m:1" and identity.relation(sites, sites, "sample_id") == "1:1" and identity.relation(sites, df, "sample_id") is None
    a = identity.audit(df, sites.where("site > 2"), "sample_id", "sample_id")
    assert (a["n_left"], a["missing"], a["n_extra"], a["n_duplicates"]) == (10, ["s0", "s1", "s2"], 0, 10)
    assert identity.generated_keys(sites, {"a": sites, "b": sites.where("site > 2"), "c": sites.drop("sample_id")}) == {"a": {"on": "sample_id", "how": "1:1", "score": 0.95}}
    with pytest.raises(DataError, match="misses"):
        identity.check_generated(spark.createDataFrame([("a",), (None,)], "k string"), "k", ".")
    with pytest.raises(DataError, match="commas"):
        identity.check_generated(spark.createDataFrame([("1,5",)], "k string"), "k", ",")


def test_keys_are_found_and_used(spark, tmp_path):
    written(tmp_path / "Xcal.csv", ["sample_id", "1000", "1005"], [["b", 1, 2], ["a", 3, 4]])
    written(tmp_path / "Ycal.csv", ["sample_id", "y"], [["a", 1.5], ["b", 2.5]])
    plan = loomwright.infer(spark, str(tmp_path))
    assert plan.identity.value == "sample_id" and plan.alignment[0]["n_missing"] == 0
    d = loomwright.load(spark, plan)
    assert {(r["1000"], r.y) for r in d.df.collect()} == {(1, 2.5), (3, 1.5)} and d.roles["features"] == ["1000", "1005"]
    locks = propose.Session(plan, {n: spark.read.csv(str(tmp_path / n), header=True, sep=";") for n in ("Xcal.csv", "Ycal.csv")})
    assert [p.kind for p in locks.proposals] == sorted([p.kind for p in locks.proposals], key=propose.KINDS.index) and locks.spec()["task_type"] == plan.spec["task_type"]
    assert next(p for p in locks.proposals if p.kind == "pairing").score == 0.9
    assert locks.lock("task_type", "dataset", "multiclass").status == "overridden" and locks.spec()["task_type"] == "multiclass" and locks.lock("role", "Ycal.csv").status == "confirmed"
    with pytest.raises(SpecError):
        locks.lock("folds", "dataset")
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "q.csv").write_text("a;b\n1;2\n")
    (empty / "r.csv").write_text("a;b\n1;2\n")
    plan = loomwright.infer(spark, str(empty))
    assert plan.structure.value == "unknown" and plan.warnings
    with pytest.raises(SpecError):
        plan.accept()


def test_load_takes_many_things(spark, tmp_path):
    import numpy as np

    assert loomwright.load(spark, (np.ones((3, 2)),)).partitions() == ["predict"]
    d = loomwright.load(spark, ([[1, 2], [3, 4]], [0, 1], ["train", "test"]))
    assert d.partitions() == ["train", "test"] and d.roles["targets"] == ["y0"]
    assert loomwright.load(spark, {"X": [[1.0]], "metadata": {"s": ["a"]}}).roles["metadata"] == ["s"]
    written(tmp_path / "d.csv", ["a", "b", "c"], [[1, 2, 3], [4, 5, 6]])
    spec = {"sources": [{"id": "d", "input": "d.csv"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert loomwright.load(spark, str(tmp_path / "spec.json")).df.count() == loomwright.load(spark, spec, str(tmp_path)).df.count() == 2

    class Own:
        def to_io_spec(self):
            return spec

    assert loomwright.load(spark, Own(), str(tmp_path)).df.count() == 2
    assert loomwright.load(spark, str(tmp_path / "d.csv")).roles["targets"] == ["c"]
    comma = tmp_path / "e.csv"
    written(comma, ["a", "b", "c"], [["1,5", 2, 3], ["4,5", 5, 6]])
    assert loomwright.load(spark, str(comma)).ordered("train", "features").first()[0] == 1.5
    assert loomwright.infer(spark, str(comma), params={"decimal": ","}).params["e.csv"]["decimal"] == ","
    frame = spark.createDataFrame([(float(i), i * 2.0) for i in range(4)], "u double, v double")
    assert loomwright.infer(spark, frame).accept().sources[0].input is frame
    assert loomwright.validate(spec) == [] and loomwright.validate({"sources": [], "odd": 1})


def test_packages(spark, tmp_path):
    written(tmp_path / "d.csv", ["1000", "1005", "y", "site"], [[i, i / 3, i % 3, "ab"[i % 2]] for i in range(40)])
    spec = {"sources": [{"id": "d", "role": "mixed", "input": "d.csv", "columns": [{"role": "features", "select": {"regex": "^1"}}, {"role": "targets", "select": "y"}, {"role": "metadata", "select": "rest"}]}], "partitions": {"by": "index", "train": list(range(30)), "test": list(range(30, 40))}, "folds": [{"train": [0, 1], "val": [2]}]}
    d = loomwright.load(spark, spec, str(tmp_path))
    root = package.write(d, str(tmp_path / "pkg"))
    back = package.read(spark, str(tmp_path / "pkg"), check=True)
    assert package.root(package.manifest(back)) == root and back.folds.count() == 3 and package.content_digest(back) == package.content_digest(d)
    entry = {e["id"]: e for e in package.manifest(d)}["train/features"]
    assert entry["shape"] == [30, 2] and entry["axis"]["coordinates"] == ["1000", "1005"]
    assert package.receipt(d)["features"] != package.receipt(d)["targets"]
    changed = loomwright.load(spark, spec | {"partitions": {"by": "index", "train": [*range(1, 30), 0], "test": list(range(30, 40))}}, str(tmp_path))
    assert package.root(package.manifest(changed)) == root  # the same rows in the same order
    written(tmp_path / "d.csv", ["1000", "1005", "y", "site"], [[i, i / 3, i % 3, "ab"[i % 2]] for i in reversed(range(40))])
    assert package.root(package.manifest(loomwright.load(spark, spec, str(tmp_path)))) != root
    manifest = next((tmp_path / "pkg" / "manifest").glob("part-*"))
    manifest.write_text(manifest.read_text().replace('"version": 1', '"version": 2'))
    for crc in (tmp_path / "pkg" / "manifest").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(DataError, match="version"):
        package.read(spark, str(tmp_path / "pkg"))
    assert package.summary(d)["partitions"]["train"]["n_rows"] == 30
    assert [x.shape for x in package.to_numpy(d, "train", batch_rows=20)] == [(20, 2), (10, 2)] and dict(package.host_block(d, "test").dtypes)["1005"] == "float"


def test_digests_by_hand(spark):
    import hashlib

    rows = [(i, f"t{i}") for i in range(10_000)]
    df = spark.createDataFrame(rows, f"{POS} long, t string").repartition(5)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [h(t) for _, t in rows]
    while True:
        level = [h("".join(level[k : k + package.RUN])) for k in range(0, len(level), package.RUN)]
        if len(level) == 1:
            break
    assert package.ordered_digest(df, ["t"]).first()[0] == level[0]


def test_payload_digest_by_hand(spark, tmp_path):
    import hashlib

    from loomwright.queries_of_files import payload_digest

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def by_hand(rows):
        """Runs are of p_partkey - 1, divided towards 0; missing cells are left out, missing keys last."""
        runs = {}
        for k, name, size in rows:
            d = h("\x1f".join(str(c) for c in (k, name, size) if c is not None))
            q = (True, 0) if k is None else (False, abs(k - 1) // package.RUN * (1 if k > 0 else -1))
            runs.setdefault(q, []).append((k or 0, d))
        ds = [h("".join(d for _, d in sorted(runs[q]))) for q in sorted(runs)]
        return [] if not ds else ds if len(ds) == 1 else [h("".join(ds))]

    cases = {
        "from_0": [(k, f"t{k}", k % 50) for k in range(10_000)],
        "gaps": [(k + 1_000_000 * c, f"t{k}", k) for c in range(3) for k in range(5000)],
        "more_runs_than_a_run": [(k * package.RUN + 7, "t", 1) for k in range(5000)],
        "repeats": [(k, f"t{c}", k) for c in range(3) for k in range(5000)],
        "below_0": [(k, f"t{k}", k) for k in range(-9000, 100)],
        "missing": [(None if k % 1000 == 9 else k, None if k % 7 == 0 else f"t{k}", None if k % 5 == 0 else k) for k in range(9000)],
        "one_run": [(k, f"t{k}", k) for k in (9, 1, 4)],
        "few_rows_of_two_runs": [(1, "a", 1), (package.RUN + 1, "b", 2)],
        "none": [],
    }
    for case, rows in cases.items():
        spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").repartition(3).write.parquet(str(tmp_path / case / "part.parquet"))
        assert [r.digest for r in payload_digest(spark, str(tmp_path / case)).collect()] == by_hand(rows), case


def test_precision(spark):
    pick = package.select_precision
    assert (pick("features").dtype, pick("features", consumer=True).reason, pick("targets", declared="float32").reason, pick("features", "float32").reason) == ("float64", "consumer", "source-declared", "requested")
    for bad in (lambda: pick("features", "float64", True), lambda: pick("targets", "float32", text=True), lambda: pick("features", "half")):
        with pytest.raises(SpecError):
            bad()
    df = spark.createDataFrame([(2**53 + 1, 1.5, 1e300)], "a bigint, b double, c double")
    assert dict(package.finalized(df, ["b"], package.Precision("float32", "requested")).dtypes)["b"] == "float"
    for column, kind in (("a", "float64"), ("c", "float32")):
        with pytest.raises(DataError, match="does not hold"):
            package.finalized(df, [column], package.Precision(kind, "requested"))
    with pytest.raises(DataError, match="class labels"):
        package.check_labels(df, "b", package.Precision("float64", "default"))
    assert package.compatible(df, df.select("c", "b", "a"), {"features": ["a"]}) and not package.compatible(df, df.drop("a"), {"features": ["a"]})


def test_json():
    from loomwright.functions import json_text as j

    assert j.canonical_json({"b": 1.0, "a": [1e-7, "é"]}) == '{\n  "a": [\n    1e-07,\n    "é"\n  ],\n  "b": 1.0\n}'
    for bad in ('{"a": NaN}', '{"a": 1, "a": 2}', "[1e999]", "[1e-999]", "[18446744073709551616]", "[1,"):
        with pytest.raises(DataError):
            j.strict_json(bad)
    assert j.strict_json("[18446744073709551615, -0.0, 0e-999]")[0] == 2**64 - 1
    assert str(j.metadata_decimal(" 1.50 ")) == "1.50" and j.identity_text(1.5) == "1.5" and j.identity_text(True) == "True" and j.rounded(-0.0000001) == 0 and math.copysign(1, j.rounded(-1e-9)) == 1
    for bad in ("x", True, "1e", float("nan")):
        with pytest.raises(DataError):
            j.metadata_decimal(bad)
    with pytest.raises(DataError):
        j.identity_text("a b")
    schema = json_schema()
    assert schema["properties"]["sources"]["items"]["properties"]["role"]["enum"][:2] == ["features", "targets"] and json.dumps(schema)


def test_command(spark, tmp_path, capsys):
    written(tmp_path / "X.csv", ["1000", "1005"], [[1, 2], [3, 4]])
    written(tmp_path / "Y.csv", ["y"], [[1.5], [2.5]])
    said = lambda *a: (command.main(list(a)), json.loads(capsys.readouterr().out))
    assert said("infer", str(tmp_path))[1]["structure"]["value"] == "x_y_separate"
    code, spec = said("to-spec", str(tmp_path))
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert code == 0 and said("validate", str(tmp_path / "s.json")) == (0, {"valid": True, "problems": []})
    code, out = said("load", str(tmp_path / "s.json"), "--out", str(tmp_path / "out"))
    assert code == 0 and out["partitions"]["train"]["n_rows"] == 2 and package.read(spark, str(tmp_path / "out")).df.count() == 2
    assert said("load", str(tmp_path / "nothing*"))[0] == 1 and said("schema")[1]["title"] == "DatasetSpec"
