"""Cohorts: alignment, checks, views, and files of several kinds."""

import numpy as np
import pytest

from loomwright.cohort import REPLAY, Cohort, Part, Provider, import_files
from loomwright.errors import AssemblyError, DataError, JoinError, SpecError


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.createDataFrame([(f"s{i}", "train" if i < 4 else "test", i % 2 if i < 4 else None, f"g{i // 2}", f"o{i}", i * 1.5, i != 2) for i in range(6)], "id string, part string, fold int, grp string, org string, y double, seen boolean")
    nir = spark.createDataFrame([(f"s{i}", i * 0.1, i * 0.2) for i in range(6)], "id string, a double, b double")
    mir = spark.createDataFrame([(f"s{i}", i + 0.5) for i in range(6)], "id string, b double")
    series = spark.createDataFrame([(f"s{i}", t, float(t * i)) for i in range(5) for t in (2, 0, 1)], "id string, t int, v double")
    return rows, {"nir": Part(nir, "matrix", ["a", "b"], axis=[1000.0, 1005.0]), "mir": Part(mir, "matrix", ["b"]), "series": Part(series, "series", ["v"], "t")}


def cohort(given, **changes):
    return Cohort(given[0], "id", changes.pop("parts", given[1]), **({"partition": "part", "fold": "fold", "group": "grp"} | changes))


def test_views(parts):
    c = cohort(parts)
    got = {r.id: r for r in c.aligned("series").collect()}
    assert [tuple(p) for p in got["s2"].points] == [(0, 0.0), (1, 2.0), (2, 4.0)] and got["s5"].points is None and not got["s5"].present
    assert {r.id for r in c.masks("series").where("not present").collect()} == {"s5"}
    values = c.source_values(["mir", "nir"], ["s3", "s0", "s3"]).collect()
    assert [(r.id, r.b, r.a, r.nir__b) for r in values] == [("s3", 3.5, pytest.approx(0.3), pytest.approx(0.6)), ("s0", 0.5, 0.0, 0.0), ("s3", 3.5, pytest.approx(0.3), pytest.approx(0.6))]
    assert [r.x for r in c.projected(["nir", "mir"]).orderBy("id").limit(2).collect()] == [[0.0, 0.0, 0.5], [0.1, 0.2, 1.5]] and c.provenance(["nir", "mir"])[1] == {"source": "mir", "begin": 2, "end": 3}
    for bad in (lambda: c.source_values(["x"], []), lambda: c.source_values(["nir", "nir"], []), lambda: c.source_values(["nir"], ["s9"]), lambda: c.dense("series"), c.replay):
        with pytest.raises(AssemblyError):
            bad()
    four = Cohort(parts[0], "id", {n: parts[1]["series" if n == "series" else "nir"] for n in REPLAY})
    assert four.replay().columns == ["id", *REPLAY] and four.replay().count() == 6
    assert c.envelope()["counts"][0] == {"part": "test", "fold": None, "n_samples": 2}


def test_batches_go_on_where_they_stopped(parts):
    c = cohort(parts)
    got = list(c.batches("nir", 4, "y"))
    assert [b.ids for b in got] == [["s0", "s1", "s2", "s3"], ["s4", "s5"]] and np.allclose(got[1].y, [6.0, 7.5]) and got[0].after == 4
    assert [b.ids for b in c.batches("nir", 4, begin=got[0].after)] == [["s4", "s5"]] and len(list(c.batches("nir", 4, drop_last=True))) == 1


def test_datasets_of_cohorts(spark, parts):
    d = cohort(parts).to_dataset("nir", ["y"], {"y": "seen"})
    assert d.roles["features"] == ["a", "b"] and [r[0] for r in d.ordered("train", "targets").collect()] == [0.0, 1.5, None, 4.5] and d.folds.count() == 8
    gap = Cohort(parts[0], "id", parts[1], "part")
    assert gap.to_dataset("nir", ["y"]).folds is None
    with pytest.raises(DataError, match="mask shows"):
        rows = spark.createDataFrame([("s0", None, True)], "id string, y double, seen boolean")
        Cohort(rows, "id", {"m": Part(spark.createDataFrame([("s0", 1.0)], "id string, a double"), "matrix", ["a"])}).to_dataset("m", ["y"], {"y": "seen"})


def test_leaks_and_faults_are_refused(spark, parts):
    rows, own = parts
    frame = lambda values, schema: spark.createDataFrame(values, schema)
    for bad in (
        lambda: Cohort(frame([("a",), ("a",)], "id string"), "id"), lambda: Cohort(frame([("a",), (None,)], "id string"), "id"), lambda: cohort(parts, strict=True),
        lambda: Cohort(frame([("a", "val")], "id string, p string"), "id", partition="p"), lambda: Cohort(frame([("a", "train", "g"), ("b", "test", "g")], "id string, p string, g string"), "id", partition="p", group="g"),
        lambda: Cohort(frame([("a", "test", 1)], "id string, p string, f int"), "id", partition="p", fold="f"), lambda: Cohort(frame([("a", "train", 0, "o"), ("b", "train", 1, "o")], "id string, p string, f int, o string"), "id", partition="p", fold="f", origin="o"),
        lambda: Cohort(frame([("a", "u", 1), ("b", "u", 1)], "id string, u string, r int"), "id", unit="u", repetition="r"),
        lambda: cohort(parts, parts={"m": Part(frame([("zz", 1.0)], "id string, a double"), "matrix", ["a"])}), lambda: cohort(parts, parts={"m": Part(frame([("s0", 1.0), ("s0", 2.0)], "id string, a double"), "matrix", ["a"])}),
        lambda: cohort(parts, parts={"m": Part(own["nir"].df, "matrix", ["a", "b"], axis=[1.0, 1.0])}), lambda: cohort(parts, parts={"m": Part(own["nir"].df, "cube", ["a"])}),
        lambda: cohort(parts, parts={"s": Part(frame([("s0", 1, 1.0), ("s0", 1, 2.0)], "id string, t int, v double"), "series", ["v"], "t")}), lambda: cohort(parts, parts={"s": Part(frame([("s0", 1, float("nan"))], "id string, t int, v double"), "series", ["v"], "t")}),
    ):
        with pytest.raises((DataError, JoinError, SpecError)):
            bad()
    assert Cohort(rows, "id", {}, origin="org", partition="part", fold="fold").envelope()["relations"]["origin"] == "org"


def test_made_cohorts(spark, parts):
    def make(seed, params, context):
        nir = spark.createDataFrame([(f"s{i}", float(seed * i), params.get("k", 0) * 1.0) for i in range(6)], "id string, a double, b double")
        return cohort(parts, parts=parts[1] | {"nir": Part(nir, "matrix", ["a", "b"])})

    provider = Provider(make, cohort(parts), ("nir",))
    point = provider.checkpoint(3, {"k": 2}, after=4)
    made, after = provider.restore(point)
    assert after == 4 and made.fingerprint() == point["fingerprint"]
    with pytest.raises(DataError, match="not what"):
        provider.restore(point | {"seed": 4})
    with pytest.raises(DataError, match="may not be replaced"):
        Provider(make, cohort(parts)).materialize(1)


def test_files_of_several_kinds(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id;part\ns1;train\ns2;test\n")
    (tmp_path / "n.csv").write_text("id;1000;1005\ns2;1;2\ns1;3;4\n")
    (tmp_path / "t.csv").write_text("id;time;v\ns1;1;.5\ns1;0;.25\ns2;0;1\n")
    (tmp_path / "i.csv").write_text("id;file\ns1;a.png\n")
    (tmp_path / "a.png").write_bytes(b"\x89PNG123")
    (tmp_path / "g.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\trs1\tA\tT\t.\t.\t.\tGT\t0/1\t1|1\n1\t9\t.\tA\tT\t.\t.\t.\tGT:DP\t./.:3\t0/0:1\n")
    c = import_files(spark, {"id": "id", "cohort": "c.csv", "partition": "part", "sources": {"nir": {"kind": "numeric", "file": "n.csv"}, "ts": {"kind": "series", "file": "t.csv", "time": "time"}, "img": {"kind": "image", "file": "i.csv"}, "snp": {"kind": "vcf", "file": "g.vcf"}}}, str(tmp_path))
    assert {r.id: (r["1_9"], r.rs1) for r in c.aligned("snp").collect()} == {"s1": (None, 1.0), "s2": (0.0, 2.0)}
    assert {r.id: r.n_bytes for r in c.aligned("img").collect()} == {"s1": 7, "s2": None}
    assert {r.id: len(r.points) for r in c.aligned("ts").collect()} == {"s1": 2, "s2": 1} and [r.x for r in c.dense("nir").orderBy("id").collect()] == [[3.0, 4.0], [1.0, 2.0]]
