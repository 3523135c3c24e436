import io
import logging
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from cavitas import logs
from cavitas.functions.checks import ArgumentError
from cavitas.operators import selection as S
from cavitas.plans.pockets import find_pockets
from cavitas.sources import castp, fpocket, pdb

POC = """ATOM     50  CB  ALA A  10      17.256  35.392  66.847  1.00 17.46   2  POC
ATOM     51  O   ALA A  10      17.256  35.392  66.847  1.00 17.46   2  POC

ATOM     50  CB  ALA A  10      17.256  35.392  66.847  1.00 17.46   2  POC
ATOM     60  N   GLY B  11      17.256  35.392  66.847  1.00 17.46   1  POC
"""
POC_INFO = """POC: Molecule ID N_mth Area_sa Area_ms Vol_sa Vol_ms Lenth cnr
POC: x.pdb 1 0 1.5 2.5 3.5 4.5 5.5 6
POC: x.pdb 2 1 10 20 30 40 50 60 7, 8,
"""
MOUTH = POC.replace("POC", "M4P").split("\n")[0] + "\n"
MOUTH_INFO = "MTH: Molecule ID N_mth Area_sa Area_ms Len_sa Len_ms Ntri\nMTH: x.pdb 2 1 1 2 3 4 5\nMTH: x.pdb 2 1 9 8 7 6 5\n"
PDB = """HEADER    X
MODEL        1
ATOM     26  N   PRO A   7      16.007  28.881  75.705  1.00 23.70           N
ATOM     27  H   PRO A   7      16.007  28.881  75.705  1.00 23.70           H
HETATM   28  O   HOH A 201       1.000   2.000   3.000  1.00  1.00           O
HETATM   29 ZN    ZN A 202       1.000   2.000   3.000  1.00  1.00          ZN
HETATM   30  C1  LIG A 203       1.000   2.000   3.000  1.00  1.00           C
MODEL        2
ATOM     26  N   PRO A   7      17.007  28.881  75.705  1.00 23.70           N
"""


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"x.poc": POC, "x.pocInfo": POC_INFO, "x.mouth": MOUTH, "x.mouthInfo": MOUTH_INFO, "x.pdb": PDB, "y.poc": "", "z.POC": ""}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_castp(spark, folder, tmp_path):
    assert {k: v.split("/")[-1] for k, v in castp.discover(spark, str(folder)).items()} == {".poc": "x.poc", ".pocInfo": "x.pocInfo", ".mouth": "x.mouth", ".mouthInfo": "x.mouthInfo", ".pdb": "x.pdb"}
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for f in folder.glob("x.*"):
            z.write(f, f"deep/{f.name}")
    for reg in (castp.load(spark, str(folder)), castp.load(spark, zip_file=str(tmp_path / "all.zip"))):
        two, one, mouth = reg["POC-2"], reg["POC-1"], reg["MOU-2"]
        assert two.atom_labels == ["50-CB/ALA/A", "51-O/ALA/A"] and two.sa_area == 10 and two.corner_points_count == 60 and two.source == "CASTp" and two.source_id == "2"
        assert one.ms_volume == 4.5 and (mouth.sa_area, mouth.n_triangles, mouth.dimensionality) == (9, 5, 1)
        assert [(r.child_id, r.parent_id) for r in reg.relations.collect()] == [("MOU-2", "POC-2")]
    info = {r.site_id: r for r in castp.parse_pocket_info(pdb.lines(spark, str(folder / "x.pocInfo"))).collect()}
    assert info[2].mouth_ids == [7, 8] and info[1].mouth_ids == [] and info[2].n_mouths == 1
    assert len(castp.load(spark, poc=str(folder / "x.poc"))) == 2 and len(castp.load(spark)) == 0


def test_castp_several_systems(spark, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    for name, text in {"q.poc": POC, "q.pocInfo": POC_INFO, "q.mouth": MOUTH, "q.mouthInfo": MOUTH_INFO, "q.pdb": PDB}.items():
        (other / name).write_text(text)
    one, both = castp.load(spark, str(folder)), castp.load(spark, [str(folder), str(other)])
    ids = [f for f in both]
    assert len(ids) == len(set(ids)) == 2 * len(one) and "x/POC-2" in both and "q/MOU-2" in both
    assert {(r.child_id, r.parent_id) for r in both.relations.collect()} == {("x/MOU-2", "x/POC-2"), ("q/MOU-2", "q/POC-2")}
    with pytest.raises(ValueError):
        castp.load(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("bad", ["ATOM 50 CB ALA A 10 1 2 3 1 2 25", "ATOM 50 CB ALA A 10 1 2 3 1 2 25 XXX"])
def test_castp_malformed(spark, bad):
    rows = spark.createDataFrame([("s", 0, bad)], "system_id string, line_no int, value string")
    with pytest.raises(Exception, match="no pocket line"):
        castp.parse_site_atoms(rows, "pocket").collect()
    assert castp.parse_site_atoms(rows, "pocket", strict=False).count() == 0


def test_pdb_and_selection(spark, folder):
    atoms = pdb.read_pdb(spark, str(folder / "x.pdb"))
    rows = atoms.orderBy("structure_index", "atom_index").collect()
    assert len(rows) == 6 and [r.structure_index for r in rows] == [0] * 5 + [1]
    first = rows[0]
    assert (first.system_id, first.atom_id, first.atom_name, first.group_name, first.group_id, first.chain_id, first.atom_type, first.x, first.b_factor) == ("x", 26, "N", "PRO", 7, "A", "N", 16.007, 23.7)
    heavy = S.without_hydrogens(S.without_types(atoms))
    assert heavy.count() == 2 and S.select_structures(heavy, 1).count() == 1 and S.select_structures(heavy).count() == 2
    assert tuple(S.removal_summary(atoms).first())[1:] == (1, 1, 1)
    assert S.select_atoms(atoms, "group_name = 'PRO'", F.col("atom_type") != "H").count() == 2 and S.select_atoms(atoms, [0]).count() == 2 and S.select_atoms(atoms, "all").count() == 6
    assert {r.radius for r in S.element_radii(heavy).collect()} == {1.55}
    assert S.as_points(heavy).columns == ["system_id", "structure_index", "point_index", "x", "y", "z"]


def test_pocket_folder(spark, tmp_path):
    out = tmp_path / "s_out"
    (out / "pockets").mkdir(parents=True)
    for k in (0, 10):
        (out / "pockets" / f"pocket{k}_atm.pdb").write_text(f"HEADER 0  - Pocket Score                      : {k}.5\nHEADER 1  - Kind : big\nATOM     7  N   PRO A   7\nATOM     3  C   PRO A   7\n")
    (out / "pockets" / "pocket0_vert.pqr").write_text("ATOM   4031  POL STP     1      28.000  35.000 116.000    0.00     3.70\nATOM   4032  POL STP     1      30.000  37.000 118.000    0.00     4.00\n")
    (out / "s_info.txt").write_text("Pocket 1 :\n\tScore :\t0.5\n\tName: a : b\nPocket 2 :\n\tScore :\tnone\n")
    got = {r.pocket_id: r for r in fpocket.read_output(spark, str(out)).collect()}
    assert got[0].atom_serials == [7, 3] and got[0].score == 0.5 and got[0].raw["Kind"] == "big" and tuple(got[0].center) == (29, 36, 117) and got[0].volume_mc is None
    assert got[10].center is None
    info = [(r.block, r.title, r.key, r.value, r.number) for r in fpocket.read_info(spark, str(out / "s_info.txt")).orderBy("block", "key").collect()]
    assert info == [(1, "Pocket 1 ", "Name", "a : b", None), (1, "Pocket 1 ", "Score", "0.5", 0.5), (2, "Pocket 2 ", "Score", "none", None)]
    reg = fpocket.registry_of(spark, str(out))
    assert reg["POC-10"].atom_indices == [6, 2] and reg["POC-0"].extra["Kind"] == "big" and reg["POC-0"].source == "fpocket"
    assert '"pocket_id":0' in fpocket.as_json(fpocket.read_output(spark, str(out))).orderBy("pocket_id").first().json
    assert fpocket.read_output(spark, str(tmp_path)).count() == 0


def test_process(tmp_path):
    (tmp_path / "a.pdb").write_text("")
    with pytest.raises(fpocket.ProcessError):
        fpocket.run(str(tmp_path / "a.pdb"), "no-such-program")
    with pytest.raises(fpocket.ProcessError):
        fpocket.run(str(tmp_path / "a.pdb"), "false")
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nmkdir ${2%.pdb}_out\n")
    tool.chmod(0o755)
    assert fpocket.run(str(tmp_path / "a.pdb"), str(tool)).endswith("a_out")


def test_keys(spark, tmp_path):
    (tmp_path / "k").write_text("ATOM 5 CA 2 POC\nATOM 3 CA 2 POC\nATOM 9 CA 1 POC\n")
    assert {r.pocket_id: r.atom_indices for r in fpocket.read_keys(spark, str(tmp_path / "k")).collect()} == {1: [4, 2], 0: [8]}


POCKET = "HEADER 0 - Pocket Score : 1.5\nHEADER 1 - Kind : %s\nATOM      7  N   PRO A   7      16.007  28.881  75.705  1.00 23.70           N\n"
VERTEX = "ATOM      1  POL STP     1      %8.3f%8.3f%8.3f    0.00     3.70\n"


def output_folder(at, kinds):
    (at / "pockets").mkdir(parents=True)
    for k, kind in enumerate(kinds):
        (at / "pockets" / f"pocket{k}_atm.pdb").write_text(POCKET % kind)
        (at / "pockets" / f"pocket{k}_vert.pqr").write_text(VERTEX % (k, 1, 2) + VERTEX % (k + 2, 1, 2))


def test_output_folders_of_many_systems(spark, tmp_path):
    output_folder(tmp_path / "one a+b_out", ["x", "y"])
    output_folder(tmp_path / "two_out", ["z"])
    (tmp_path / "bare_out" / "pockets").mkdir(parents=True)
    want = {("one a+b", 0, "x", 1.0), ("one a+b", 1, "y", 2.0), ("two", 0, "z", 1.0)}
    folders = [str(tmp_path / f"{n}_out") for n in ("one a+b", "two", "bare", "absent")]
    for where in (folders, f"{tmp_path}/*_out"):
        out = fpocket.read_outputs(spark, where)
        assert {(r.system_id, r.pocket_id, r.raw["Kind"], r.center.x) for r in out.collect()} == want
    assert fpocket.read_outputs(spark, folders[2:]).count() == 0 and fpocket.read_output(spark, folders[1]).columns[0] == "pocket_id"


def test_program_over_many_structures(spark, tmp_path):
    """A stub program: one structure makes it fail, one has no pockets, two have some."""
    tool = tmp_path / "tool"
    tool.write_text("""#!/bin/sh
grep -q BROKEN "$2" && { echo "no atoms" >&2; exit 3; }
out="${2%.pdb}_out"; mkdir -p "$out/pockets"
grep -q EMPTY "$2" || cp "$2" "$out/pockets/pocket1_atm.pdb"
""")
    tool.chmod(0o755)
    for name, text in (("a", POCKET % "a"), ("b", POCKET % "b"), ("c", "BROKEN"), ("d", "EMPTY")):
        (tmp_path / f"{name}.pdb").write_text(text)
    reg, failed = fpocket.registry_of_run(fpocket.structures(spark, f"{tmp_path}/*.pdb"), str(tool))
    assert {r.feature_id: (r.atom_indices, r.extra["Kind"]) for r in reg.features.collect()} == {"a/POC-1": ([6], "a"), "b/POC-1": ([6], "b")}
    assert [(r.system_id, "no atoms" in r.error) for r in failed.collect()] == [("c", True)]
    slow = tmp_path / "slow"
    slow.write_text("#!/bin/sh\nexec sleep 30\n")
    slow.chmod(0o755)
    assert "over 1 s" in fpocket.failures(fpocket.run_all(fpocket.structures(spark, f"{tmp_path}/a.pdb"), str(slow), seconds=1)).first().error
    assert "can't be run" in fpocket.failures(fpocket.run_all(fpocket.structures(spark, f"{tmp_path}/a.pdb"), "no-such-program")).first().error


def test_selection_text(spark):
    rows = [("s", 0, k, *r) for k, r in enumerate([("ATOM  ", "ALA", "N"), ("ATOM  ", "ALA", "H"), ("HETATM", "HOH", "O"), ("HETATM", "NA", "NA"), ("HETATM", "LIG", None), ("ATOM  ", "x[1]", "C")])]
    atoms = spark.createDataFrame(rows, "system_id string, structure_index int, atom_index int, record string, group_name string, atom_type string")
    chosen = lambda text: {r.atom_index for r in S.select_atoms(atoms, text).collect()}
    removed = chosen("group_type in ['water', 'ion', 'small molecule']")
    assert removed == {2, 3, 4} and {r.atom_index for r in S.without_types(atoms).collect()} == {0, 1, 5}
    assert chosen('atom_type not in ["H"]') == {r.atom_index for r in S.without_hydrogens(atoms).collect()} == {0, 2, 3, 4, 5}
    assert chosen("not (atom_type in ['N', 'H'] or group_type == 'ion') and atom_index != 2") == {4, 5}
    assert chosen("atom_index in [0, 4]") == {0, 4} and chosen("atom_index in []") == set() and len(chosen("atom_index NOT IN [ ]")) == 6
    assert chosen("group_name in ['x[1]', 'no']") == {5} and chosen("group_name = 'x[1]'") == {5} and len(chosen("all")) == 6
    assert S.select_atoms(atoms, "group_type == 'ion'").columns == atoms.columns
    for bad in ("no_such in ['a']", "atom_type in ['a'", "atom_type like"):
        with pytest.raises(ValueError):
            S.select_atoms(atoms, bad)


def test_molecular_systems(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.pdb").write_text(PDB)
    whole = pdb.read_pdb(spark, str(tmp_path / "*.pdb"))
    assert pdb.atoms_of(whole) is whole
    for given, systems in (
        (str(tmp_path / "one.pdb"), {"one"}), (tmp_path / "one.pdb", {"one"}), (str(tmp_path / "*.pdb"), {"one", "two"}),
        ([tmp_path / "one.pdb", str(tmp_path / "two.pdb")], {"one", "two"}),
    ):
        got = pdb.atoms_of(given, spark)
        assert {r.system_id for r in got.select("system_id").distinct().collect()} == systems and got.count() == 6 * len(systems)
    for bad in (None, 7, [], [""], "", [1], whole.drop("x")):
        with pytest.raises(ArgumentError):
            pdb.atoms_of(bad, spark)


def test_pockets_of_paths(spark, tmp_path):
    grid = [(a * 3.5, b * 3.5, c * 3.5) for a in range(4) for b in range(4) for c in range(4) if (a, b, c) != (1, 1, 1)]
    line = "ATOM  {0:5d}  C   ALA A{0:4d}    {1:8.3f}{2:8.3f}{3:8.3f}  1.00  1.00           C\n"
    (tmp_path / "grid.pdb").write_text("".join(line.format(i + 1, x + 0.01 * (i % 7), y + 0.01 * (i % 5), z + 0.01 * (i % 3)) for i, (x, y, z) in enumerate(grid)))
    parameters = {"min_radius": 2.0, "max_radius": 6.0, "cut_distance": 3.0, "min_spheres": 1}
    by_path = find_pockets(tmp_path / "grid.pdb", "linkage", **parameters).select("pocket_id", "sphere_id").collect()
    by_table = find_pockets(pdb.read_pdb(spark, str(tmp_path / "grid.pdb")), "linkage", **parameters).select("pocket_id", "sphere_id").collect()
    assert by_path and sorted(by_path) == sorted(by_table)


def test_log(monkeypatch):
    log, other, out = logging.getLogger(logs.NAME), logging.getLogger("py.warnings"), io.StringIO()
    monkeypatch.setattr(log, "handlers", [])
    monkeypatch.setattr(other, "handlers", [])
    monkeypatch.setattr(warnings, "formatwarning", warnings.formatwarning)
    try:
        assert logs.start_log("info", out) is log and log.level == logging.INFO
        log.info("read")
        log.debug("not shown")
        with warnings.catch_warnings():
            warnings.simplefilter("always")
            logging.captureWarnings(True)
            warnings.warn("no is_apolar", UserWarning, stacklevel=1)
        logs.start_log("no such level")
        log.info("not shown either")
        assert log.level == logging.WARNING and len(log.handlers) == len(other.handlers) == 1
        assert out.getvalue().rstrip().split("\n") == ["CAVITAS INFO | read", "CAVITAS WARNING | UserWarning: no is_apolar"]
    finally:
        logging.captureWarnings(False)
        for one in (log, other):
            one.propagate = True
            one.setLevel(logging.NOTSET)
