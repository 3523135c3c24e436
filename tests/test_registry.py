import pytest
from pyspark.sql import functions as F

from cavitas.functions import checks, labels
from cavitas.functions.checks import ArgumentError
from cavitas.operators import registry as R

ATOMS = "system_id string, structure_index int, atom_index int, atom_id int, atom_name string, group_name string, group_id int, chain_id string"


@pytest.fixture()
def atoms(spark):
    rows = [("x", 0, i, i + 1, f"N{i % 3}", "PRO", 7 + i // 3, "A") for i in range(50)]
    return spark.createDataFrame(rows, ATOMS)


def test_taxonomy(spark):
    rows = {r.feature_type: (r.shape_type, r.dimensionality) for r in R.taxonomy(spark).collect()}
    assert len(rows) == 43 and rows["ridge"] == ("convexity", 2) and rows["mouth"] == ("boundary", 1) and rows["pit"] == ("point", 0)
    assert R.type_name("Feature_1D") == "feature1d" and R.type_name("POCKET") == "pocket"
    with pytest.raises(ArgumentError):
        R.type_name("cave")


def test_empty_then_one_pocket(spark):
    empty = R.Registry(spark)
    assert len(empty) == 0 and empty.get("type", "pocket").count() == 0 and empty.next_id("pocket") == "POC-1"
    assert {(r.kind, r.name, r.n) for r in empty.info().collect()} == {("total", "total", 0), *(("shape", s, 0) for s in R.DIMENSIONS), *(("dimensionality", str(d), 0) for d in range(3))}
    one = empty.add_new("pocket", atom_indices=[1, 2, 3])
    row = one["POC-1"]
    assert (row.dimensionality, row.shape_type, row.atom_indices, row.source, row.source_id) == (2, "concavity", [1, 2, 3], R.SOURCE, "POC-1")
    assert (row.atom_label_format, row.atom_labels, row.sa_area, row.corner_points_count) == (labels.DEFAULT_FORMAT, None, None, None)
    for by, value, n in (("type", "pocket", 1), ("dimensionality", 2, 1), ("shape", "concavity", 1), ("shape", "convexity", 0), ("type", "cave", 0), ("id", ["POC-1", "no"], 1), ("id", "no", 0)):
        assert one.get(by, value).count() == n
    assert one.next_id("pocket") == "POC-2" and one.next_id("void") == "VOI-1" and one.next_id("dome") == "DOM-1"
    assert list(one) == ["POC-1"] and "POC-1" in one and "x" not in one and repr(one) == "<Registry pocket=1>"
    with pytest.raises(KeyError):
        one["POC-9"]
    for bad in (("colour", 1), ("type", ["pocket"])):
        with pytest.raises(ValueError):
            one.get(*bad)
    with pytest.raises(ValueError):
        one.get(grouped_by="id")


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("attached", [True, False])
def test_construction_with_labels(spark, atoms, given, attached):
    reg = R.Registry(spark, atoms=atoms if attached else None)
    fid = "mine" if given else None
    for template, names in ((None, ["N1-26/PRO-15/A-A", "N0-34/PRO-18/A-A"]), ("{atom_id}/{group_id}/{chain_id}", ["26/15/A", "34/18/A"])):
        made = reg.add_new("pocket", fid, atom_labels=names, atom_label_format=template, colour="red")
        row = made["mine" if given else "POC-1"]
        assert row.atom_indices == ([25, 33] if attached else None) and row.atom_labels == names and row.extra == {"colour": "red"}
        if not attached:
            assert made.with_atoms(atoms)[row.feature_id].atom_indices == [25, 33]


def test_duplicates_and_bulk(spark):
    reg = R.Registry(spark).add_new("pocket", "a", sa_area=1.0)
    again = spark.createDataFrame([("a", "void"), ("b", "mouth")], "feature_id string, feature_type string")
    assert reg.add(again)["a"].feature_type == "void" and len(reg.add(again)) == 2
    assert reg.add(again, "skip")["a"].feature_type == "pocket" and "b" in reg.add(again, "skip")
    with pytest.raises(ArgumentError):
        reg.add(again, "error")
    bulk = spark.createDataFrame([("pocket", i) for i in range(12)], "feature_type string, seq long")
    ids = [r.feature_id for r in R.natural_order(reg.add(bulk).features).collect()]
    assert ids == [*(f"POC-{i}" for i in range(2, 14)), "a"]
    with pytest.raises(Exception, match="unknown feature type"):
        R.with_taxonomy(spark.createDataFrame([("cave",)], "feature_type string")).collect()


def test_generated_ids_skip_those_in_use(spark):
    reg = R.Registry(spark).add_new_pocket("POC-2").add_new("pocket")
    assert sorted(reg) == ["POC-2", "POC-3"] and reg.next_id("pocket") == "POC-4"
    some = R.Registry(spark).add(spark.createDataFrame([(f"POC-{k}", "pocket") for k in (2, 5, 6, 9)], "feature_id string, feature_type string"))
    assert some.next_id("pocket") == "POC-7"
    more = some.add(spark.createDataFrame([("pocket", k) for k in range(4)] + [("void", 9)], "feature_type string, seq long"))
    assert sorted(more) == sorted(["POC-2", "POC-5", "POC-6", "POC-9", "POC-7", "POC-8", "POC-10", "POC-11", "VOI-1"])


def test_duplicates_within_a_batch(spark):
    twice = spark.createDataFrame([("POC-9", "pocket", 1), ("POC-9", "void", 2), ("x", "mouth", 3)], "feature_id string, feature_type string, seq long")
    reg = R.Registry(spark)
    assert len(reg.add(twice)) == 2 and reg.add(twice)["POC-9"].feature_type == "void"
    assert len(reg.add(twice, "skip")) == 2 and reg.add(twice, "skip")["POC-9"].feature_type == "pocket"
    with pytest.raises(ArgumentError):
        reg.add(twice, "error")


def test_mapping_and_numbers(spark):
    reg = R.Registry(spark).add(spark.createDataFrame([("p", "pocket"), ("m", "mouth"), ("t", "pit")], "feature_id string, feature_type string"))
    assert list(reg.keys()) == ["p", "m", "t"] == [k for k, _ in reg.items()] == [r.feature_id for r in reg.values()]
    assert reg.find("m").feature_type == "mouth" and reg.find("no", 7) == 7 and list(reg.copy()) == list(reg)
    joined = reg.connect_surfaces("m", "p").connect_points("p", "t")
    assert {r.child_id for r in joined.children_of("p").collect()} == {"m", "t"}
    rules = {(r.feature_type, r.shape_type) for r in R.applies_to(spark).collect()}
    assert ("mouth", "concavity") in rules and ("mouth", "convexity") not in rules and ("base_rim", "convexity") in rules and ("pit", "mixed") in rules
    rows = spark.createDataFrame([(k % 3, k * 7 % 100) for k in range(100)], "g int, x int")
    got = R.numbered(rows, ["g"], ["x"], "n").collect()
    for g in range(3):
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.x)] == list(range(1, sum(r.g == g for r in got) + 1))


def test_relations(spark):
    reg = R.Registry(spark).add(spark.createDataFrame([("p", "pocket"), ("d", "dome"), ("m", "mouth"), ("b", "base_rim"), ("t", "pit")], "feature_id string, feature_type string"))
    good = reg.connect("m", "p").connect("t", "p").connect("b", "d").connect("m", "p")
    assert {r.child_id for r in good.children_of("p").collect()} == {"m", "t"} and [r.parent_id for r in good.parents_of("b").collect()] == ["d"]
    rows = {r.feature_id: (r.boundaries, r.points, r.surfaces) for r in R.related_ids(good.features, good.relations).collect()}
    assert rows["p"] == (["m"], ["t"], []) and rows["m"] == ([], [], ["p"])
    for child, parent, rule in (("m", "d", "mouth_needs_concavity"), ("b", "p", "base_rim_needs_convexity"), ("p", "d", "child_not_0d_1d"), ("m", "b", "parent_not_2d"), ("m", "no", "unknown")):
        with pytest.raises(ArgumentError, match=rule):
            reg.connect(child, parent)
    with pytest.raises(KeyError):
        good.children_of("zz")


def test_labels(spark):
    row = spark.range(1).select(labels.parse(F.lit("N-26/PRO-7/A-A"), labels.DEFAULT_FORMAT).alias("f")).first().f
    assert row.asDict() == {"atom_name": "N", "atom_id": "26", "group_name": "PRO", "group_id": "7", "chain_name": "A", "chain_id": "A"}
    many = spark.range(1).select(labels.parse_many(F.array(F.lit("1.a"), F.lit("2.b")), "{n}.{c}").alias("s")).select(labels.by_field(F.col("s"), "{n}.{c}").alias("d")).first().d
    assert (many.n, many.c) == (["1", "2"], ["a", "b"])
    assert spark.range(1).select(labels.parse(F.lit("zz"), "{a}/{b}", strict=False).alias("f")).first().f is None
    with pytest.raises(Exception, match="no label of the format"):
        spark.range(1).select(labels.parse(F.lit("zz"), "{a}/{b}")).collect()
    ids = spark.createDataFrame([(x,) for x in ["VOI-3", "POC-10", "POC-2", "POC", "12", None]], "id string")
    assert [r.id for r in ids.orderBy(*labels.natural_key(F.col("id"))).collect()] == ["POC-2", "POC-10", "POC", "VOI-3", "12", None]
    assert labels.fields("{a}-{ b }") == ["a", "b"]


def test_points_and_radii():
    assert checks.points((1, 2, 3)) == [[1, 2, 3]] and checks.points([[1, 2, 3], (4, 5, 6)], "nm") == [[10, 20, 30], [40, 50, 60]]
    assert checks.radii(None) is None and checks.radii([1, "0.2 nm", (3, "angstroms")]) == [1, 2, 3]
    for bad in (lambda: checks.points([1, 2]), lambda: checks.points("x"), lambda: checks.radii([[1.0]]), lambda: checks.radii(3)):
        with pytest.raises(ArgumentError):
            bad()


def test_checks(spark):
    assert checks.length("3.0 angstroms") == 3 and checks.length("0.3 nm") == pytest.approx(3) and checks.length((2, "nm")) == 20 and checks.length(1.5) == 1.5
    for bad in ("3 parsecs", "x", True, None, [1]):
        with pytest.raises(ArgumentError):
            checks.length(bad)
    assert checks.indices("all") is None and checks.indices(3) == [3] and checks.indices((1, 2)) == [1, 2]
    with pytest.raises(ArgumentError):
        checks.indices("some")
    with pytest.raises(ArgumentError):
        checks.whole_number(2.5, "n")
    assert checks.is_next("NEXT") and checks.is_all(None) and checks.is_iterable_of_pairs([(1, 2)]) and checks.is_iterable_of_iterables([[1], (2,)])
    assert not checks.is_iterable_of_integers([1.5]) and checks.is_iterable_of_integers(range(2))
    with pytest.raises(ArgumentError):
        checks.existing("/no/such/file")
    assert spark.range(1).select(checks.to_unit(F.lit(100.0), "nm", 2).alias("v")).first().v == pytest.approx(1)


def test_descriptions(spark):
    rows = [("BAS-1", "base_rim", "boundary"), ("F-1", "feature1d", "boundary"), (None, "pocket", "concavity"), ("X", None, None)]
    got = R.descriptions(spark.createDataFrame(rows, "feature_id string, feature_type string, shape_type string")).collect()
    assert [r.description for r in got] == ["<BaseRim with feature_id=BAS-1>", "<Feature1D with feature_id=F-1>", "<Pocket with feature_id=None>", "<None with feature_id=X>"]


def test_feature_views_and_atoms(spark, atoms):
    other = atoms.withColumn("system_id", F.lit("y"))
    made = R.Registry(spark, atoms=atoms.unionByName(other)).add_new("pocket", atom_indices=[4, 2], extra={"system_id": "no", "depth": 2}, system_id="y")
    made = made.add_new("mouth", atom_indices=[0, 999]).add_new("void").connect("MOU-1", "POC-1")
    pocket, mouth, void = (made.feature(i) for i in ("POC-1", "MOU-1", "VOI-1"))
    assert pocket.id == pocket.feature_id == "POC-1" and repr(pocket) == "<Pocket with feature_id=POC-1>" and pocket.registry is made
    assert pocket.info() == {"feature_id": "POC-1", "feature_type": "pocket", "shape_type": "concavity", "dimensionality": 2}
    assert pocket.molecular_system is made.molecular_system is made.atoms
    assert [r.child_id for r in pocket.children().collect()] == ["MOU-1"] and [r.parent_id for r in mouth.parents().collect()] == ["POC-1"]
    assert [(r.place, r.system_id, r.atom_index) for r in pocket.atoms().orderBy("place").collect()] == [(0, "y", 4), (1, "y", 2)]
    # no system named: the atom of each; an index without an atom: nothing
    assert sorted((r.system_id, r.atom_index) for r in mouth.atoms().collect()) == [("x", 0), ("y", 0)] and void.atoms().count() == 0
    assert sorted(r.feature_id for r in made.atoms_of_features().collect()) == ["MOU-1", "MOU-1", "POC-1", "POC-1"]
    assert pocket.extra == {"system_id": "y", "depth": "2"}
    with pytest.raises(AttributeError):
        pocket.colour
    with pytest.raises(KeyError):
        made.feature("POC-9")
    alone = made.with_atoms(None)
    assert alone.feature("POC-1").atoms() is None and alone.molecular_system is None
    with pytest.raises(ArgumentError):
        alone.atoms_of_features()


def test_deep_copies_outlive_their_sources(spark, tmp_path):
    R.Registry(spark).add_new("pocket").features.write.parquet(str(tmp_path / "f"))
    stored = R.Registry(spark, spark.read.parquet(str(tmp_path / "f")))
    shallow, deep = stored.copy(), stored.copy(deep=True)
    assert shallow.features is stored.features and deep.atoms is None
    spark.range(0).write.mode("overwrite").parquet(str(tmp_path / "f"))
    assert list(deep) == ["POC-1"] and "parquet" not in deep.features._jdf.queryExecution().toString()
