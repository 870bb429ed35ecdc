import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotamera import constants as K
from rotamera.sources import logs, protocols, reference, state, xyz

# formaldehyde, two modes and two states, numbers of our own
GAUSSIAN_OPT = """ Input orientation:
 ------------------------------------------------
 Center  Atomic  Atomic        Coordinates (Angstroms)
 Number  Number   Type         X          Y          Z
 ------------------------------------------------
   1       6       0       0.000000  -0.000000   -.529842
   2       8       0       0.000000   0.000000   0.677591
   3       1       0       0.000000   0.936207  -1.123846
   4       1       0       0.000000  -0.936207  -1.123846
 ------------------------------------------------
 SCF Done:  E(RwB97XD) =  -114.41250000     A.U. after    7 cycles
 SCF Done:  E(RwB97XD) =  -114.49817326     A.U. after    6 cycles
 Rotational constants (GHZ):    284.9712300    38.9024100    34.2295600
 Dipole moment (field-independent basis, Debye):
    X=    0.0000    Y=    -.0125    Z=   -2.3871    Tot=    2.3871
 Quadrupole moment
 Harmonic frequencies (cm**-1), IR intensities (KM/Mole), Raman scattering
 Frequencies --   1207.4113   1269.8872
 IR Inten    --      4.8816     13.0429
 Rot. str.   --      .0213     -0.4075



 Excited states from <AA,BB:AA,BB> singles matrix:
 <0|del|b> * <b|rxdel|0> + <0|del|b> * <b|delr+rdel|0>
     state        XX        YY        ZZ    R(velocity)
       1       0.4127   -1.0862    0.7735       2.6841
       2      -3.0019    0.2207    2.7812      -0.9318
 1/2[<0|r|b>*<b|rxdel|0> + (<0|rxdel|b>*<b|r|0>)*]
 Excitation energies and oscillator strengths:

 Excited State   1:      Singlet-A2     4.0216 eV  308.30 nm  f=0.0003  <S**2>=0.000
 Excited State   2:      Singlet-B2     7.3894 eV  167.79 nm  f=0.0871  <S**2>=0.000
 ***
 Optimization completed.
 Normal termination of Gaussian
"""


def parse(spark, text, dialect):
    return logs.parse_logs(spark.createDataFrame([(text,)], "text string"), dialect).first()


def test_gaussian_fragments(spark):
    r = parse(spark, GAUSSIAN_OPT, "gaussian")
    assert r.e == -114.49817326 and len(r.geom) == 4
    assert r.geom[0] == [0.0, 0.0, -.529842] and r.geom[3] == [0.0, -.936207, -1.123846]
    assert r.b_vec == pytest.approx([x / 29.979 for x in (284.97123, 38.90241, 34.22956)], rel=1e-4)
    assert r.m_vec == [0.0, -.0125, -2.3871] and r.freq == [1207.4113, 1269.8872]
    assert [tuple(x) for x in r.ir] == [(1207.4113, 4.8816), (1269.8872, 13.0429)]
    assert [tuple(x) for x in r.vcd] == [(1207.4113, .0213), (1269.8872, -.4075)]
    assert [tuple(x) for x in r.uv] == [(4.0216, .0003), (7.3894, .0871)]
    assert [tuple(x) for x in r.ecd] == [(4.0216, 2.6841), (7.3894, -.9318)]
    assert r.terminated and r.converged


@pytest.mark.parametrize("dialect", ["orca", "gaussian"])
def test_missing_sections(spark, dialect):
    r = parse(spark, "nothing of interest\n", dialect)
    assert r.e is None and r.freq == [] and r.b_vec == [1.0, 0.0, 0.0] and r.m_vec == [1.0, 0.0, 0.0]
    assert all([tuple(x) for x in r[c]] == [(0.0, 0.0)] for c in ("ir", "vcd", "uv", "ecd"))
    assert not r.terminated and not r.converged and not r.geom


def test_orca_counts_markers_exactly_once(spark):
    once, twice = "ORCA TERMINATED NORMALLY\n", "ORCA TERMINATED NORMALLY\n" * 2
    assert parse(spark, once, "orca").terminated and not parse(spark, twice, "orca").terminated
    r = parse(spark, "FINAL SINGLE POINT ENERGY      -1.5\nFINAL SINGLE POINT ENERGY (From external)     -2.5\n", "orca")
    assert r.e == -2.5


def test_dialect_registry(spark):
    logs.register_dialect("Plain", lambda t: {"e": F.trim(t).cast("double")})
    try:
        assert parse(spark, " -7.5 ", "plain").e == -7.5
    finally:
        del logs.DIALECTS["plain"]
    with pytest.raises(ValueError):
        parse(spark, "", "plain")


XYZ = "3\nE=-76.40931\nO 0.0 0.0 0.12\nH 0.0 0.76 -0.47\nH 0.0 -0.76 -0.47\n"


def test_xyz_frames(spark, tmp_path):
    f = tmp_path / "two.xyz"
    f.write_text(XYZ + XYZ.replace("E=-76.40931", "frame 2  -7.65e1") + "3\npartial\nO 0 0 0\n")
    got = xyz.read_xyz(spark, str(f), with_energy=True).orderBy("conf_id").collect()
    assert [(r.conf_id, r.e) for r in got] == [(1, -76.40931), (2, -76.5)]
    assert got[0].atoms == ["O", "H", "H"] and got[0].geom[1] == [0.0, .76, -.47]
    with pytest.raises(ValueError):
        xyz.read_xyz(spark, str(tmp_path / "two.mol"))


def test_xyz_file_in_many_splits(spark, tmp_path):
    f = tmp_path / "long.xyz"
    f.write_text("".join(f"2\nframe {i}\nC {i}.0 0.0 0.0\nH 0.0 {i}.5 0.0\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = xyz.read_xyz(spark, str(f))
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 4
        got = df.orderBy("conf_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.comment for r in got] == [f"frame {i}" for i in range(400)]
    assert all(r.conf_id == i + 1 and r.geom == [[float(i), 0.0, 0.0], [0.0, i + .5, 0.0]] for i, r in enumerate(got))


def test_xyz_written_active_only_in_energy_order(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, ["C"], [[0.0, 0.0, 0.0]], -1.0, None, True),
                                ("m", 2, ["C"], [[1.0, 0.0, 0.0]], -2.0, None, True),
                                ("m", 3, ["C"], [[2.0, 0.0, 0.0]], -3.0, None, False)],
                               "ensemble_id string, conf_id long, atoms array<string>, geom array<array<double>>, "
                               "e double, g double, active boolean").coalesce(1)
    out = str(tmp_path / "out.xyz")
    xyz.write_xyz(df, out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.xyz" / "ensemble_id=m").glob("part-*")))
    assert text == ("1\nCONFORMER 2  -2.000000\nC        1.000000        0.000000        0.000000\n"
                    "1\nCONFORMER 1  -1.000000\nC        0.000000        0.000000        0.000000\n")
    assert xyz.read_xyz(spark, out, True).count() == 2


def test_reference_file(spark, tmp_path):
    (tmp_path / "ir_ref.dat").write_text("# header\n1100 0.8\n 1000\t0.5  # tail\n\n")
    (tmp_path / "ECD_ref.dat").write_text("250.0 -3e-1\n")
    got = {(r.graph_type, r.x, r.y) for r in reference.read_reference(spark, str(tmp_path)).collect()}
    assert got == {("IR", 1100.0, .8), ("IR", 1000.0, .5), ("ECD", 250.0, -.3)}


def test_spectrum_text_sink_keeps_grid_order(spark, tmp_path):
    df = spark.createDataFrame([("a", p, "IR", i, float(i), float(i * p)) for p in (1, 2) for i in range(50)],
                               "ensemble_id string, protocol int, graph_type string, i int, x double, y double")
    reference.write_spectrum(df.orderBy(F.rand(1)), str(tmp_path / "s"), text=True)
    part = tmp_path / "s" / "graph_type=IR" / "protocol=2" / "ensemble_id=a"
    lines = "".join(p.read_text() for p in sorted(part.glob("part-*"))).split("\n")[:-1]
    assert lines == [f"{float(i)} {float(2 * i)}" for i in range(50)]


def test_state_json(spark, tmp_path):
    doc = {"1": {"number": 1, "atoms": ["C", "O"], "last_geometry": [[0, 0, 0], [1.2, 0, 0]], "active": True,
                 "cluster": None, "color": "#fff",
                 "energies": {"data": {"0": {"E": -100.0, "G": float("nan"), "B": 10.0, "B_vec": [1, 2, 3], "Freq": []},
                                       "2": {"E": -100.5, "G": -100.1, "Pop": 50.0, "G_E": .4, "time": 1.0}}}}}
    (tmp_path / "mol.json").write_text(json.dumps(doc, indent=4))
    confs, recs = state.read_state_json(spark, str(tmp_path / "mol.json"))
    c = confs.first()
    assert (c.ensemble_id, c.conf_id, c.atoms, c.geom, c.active) == ("mol", 1, ["C", "O"], [[0.0, 0.0, 0.0], [1.2, 0.0, 0.0]], True)
    r = {x.protocol: x for x in recs.collect()}
    assert r[0].e == -100.0 and r[0].g is None and r[0].b_vec == [1.0, 2.0, 3.0] and r[2]["pop"] == 50.0
    back = json.loads(state.state_json(confs, recs).first().value)
    assert back["energies"]["data"]["2"]["E"] == -100.5 and back["number"] == 1


def test_state_documents_keep_line_lists(spark, tmp_path):
    doc = {"7": {"number": 7, "atoms": ["H"], "last_geometry": [[0, 0, 0]], "active": True, "cluster": None,
                 "energies": {"data": {"0": {"E": -1.0}}},
                 "graphs_data": {"data": {"0": {"IR": {"X": [100.0, 200.0], "Y": [1.0, 2.0]}, "UV": {"X": [], "Y": []}},
                                          "3": {"ECD": {"X": [4.5, 4.6], "Y": [-0.5]}}}}},
           "8": {"number": 8, "atoms": ["H"], "last_geometry": [[0, 0, 0]], "active": True, "energies": {"data": {}}}}
    (tmp_path / "mol.json").write_text(json.dumps(doc))
    path = str(tmp_path / "mol.json")
    peaks = state.read_state_peaks(spark, path)
    want = [("mol", 7, 0, "IR", 0, 100.0, 1.0), ("mol", 7, 0, "IR", 1, 200.0, 2.0), ("mol", 7, 3, "ECD", 0, 4.5, -0.5)]
    assert sorted(map(tuple, peaks.collect())) == want
    confs, recs = state.read_state_json(spark, path)
    again = {r.conf_id: json.loads(r.value) for r in state.state_json(confs, recs, peaks=peaks).collect()}
    assert again[7]["graphs_data"]["data"] == {"0": {"IR": {"X": [100.0, 200.0], "Y": [1.0, 2.0]}},
                                               "3": {"ECD": {"X": [4.5], "Y": [-0.5]}}}
    assert again[8]["graphs_data"] == {"data": {}}
    assert "graphs_data" not in json.loads(state.state_json(confs, recs).first().value)


def test_curves_in_folders_of_parts(spark, tmp_path):
    spark.createDataFrame([(f"{i} {2 * i}  # c",) for i in range(5)] + [("",), ("# none",)], "value string").write.text(
        str(tmp_path / "vcd_ref.dat"))
    (tmp_path / "other.dat").write_text("1 2\n")
    got = reference.read_reference(spark, str(tmp_path / "*_ref.dat")).collect()
    assert sorted(map(tuple, got)) == [("VCD", float(i), float(2 * i)) for i in range(5)]


def test_state_is_replaced_by_step_and_missing_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, p, float(p)) for p in (0, 1)], "ensemble_id string, conf_id long, protocol int, e double")
    path = str(tmp_path / "state")
    state.save_state(df, path)
    state.save_state(df.where("protocol = 1").withColumn("e", F.lit(9.0)), path)
    assert {(r.protocol, r.e) for r in state.load_state(spark, path).collect()} == {(0, 0.0), (1, 9.0)}
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, str(tmp_path / "nowhere"))


def test_default_and_custom_protocols(spark, tmp_path):
    got = protocols.read_protocols(spark).collect()
    assert [(r.protocol, r.level, r.basis, r.thr_gmax) for r in got] == [
        (0, "SP", "def2-mTZVP", 6.0), (1, "OPT+FREQ", "def2-mTZVPP", 3.5), (2, "SP", "def2-qzvpp", 6.0)]
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"10": {"functional": "GFN2-xTB", "basis": "x", "cluster": True, "thrG": 1},
                             "9": {"functional": "B3LYP", "basis": "6-31G*", "cluster": 5, "opt": True, "add_input": "a 'b'",
                                   "solvent": {"solvent": "water", "smd": True}, "monitor_internals": [[0, 1]]}}))
    nine, ten = protocols.read_protocols(spark, str(f)).collect()
    assert (nine.protocol, nine.n_clusters, nine.clustering, nine.level, nine.add_input) == (9, 5, True, "OPT", 'a "b"')
    assert nine.solvent.smd and nine.monitor_internals == [[0, 1]]
    assert (ten.basis, ten.clustering, ten.n_clusters, ten.thr_g, ten.thr_b) == ("", True, None, 1.0, 1e-5)
    f.write_text(json.dumps({"0": {"functional": "B3LYP", "mult": 0}}))
    with pytest.raises(Exception, match="multiplicity"):
        protocols.read_protocols(spark, str(f)).collect()


def test_nm_constant():
    assert K.NM_EV == pytest.approx(1239.8419843320026)
    assert np.isclose(K.LIGHT_SPEED_CM, 2.99792458e10)


def test_outputs_one_to_a_file_in_a_folder_per_ensemble(spark, tmp_path):
    rows = [(e, i, f"text {e} {i}\nä\n") for e in (1, -2, None) for i in [*range(20), None]]
    rows += [(7, 3, "one"), (7, 3, "two"), (7, 4, None)]
    df = spark.createDataFrame(rows, "ensemble_id long, conf_id long, text string").repartition(3, "conf_id")
    got = {}
    for way, path in (("files", f"file://{tmp_path}/a b/files"), ("folders", f"{tmp_path}/folders")):
        logs.write_logs(df, path)
        back = logs.read_written_logs(spark, path, "orca").select("ensemble_id", "conf_id", "text").collect()
        got[way] = {(r[0], r[1]): sorted(r[2].split("\n")) for r in back}
        assert len(got[way]) == len(back)
    assert got["files"] == got["folders"] and len(got["files"]) == 65
    assert got["files"]["-2", "3"] == sorted("text -2 3\nä\n\n".split("\n")) and got["files"][None, None]
    made = [p for p in (tmp_path / "a b" / "files").rglob("*")]
    assert sum(p.is_dir() for p in made) == 4 and sum(p.is_file() for p in made) == 65


def test_mounted_outputs_are_read_by_as_many_tasks_as_partitions(spark, tmp_path, monkeypatch):
    """Spark's reader had a task for each 32 files or so. Names and texts are those that it gives."""
    rows = [(None if i == 3 else i % 3 - 1, i, f"text {i}\nä\r\n\n" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "ensemble_id long, conf_id long, text string").repartition(3)
    path = f"file:{tmp_path}/a b%c#+é/files"
    logs.write_logs(df, path)
    for hidden in ("ensemble_id=0/.conf_id=1.0.5", "ensemble_id=0/_SUCCESS", ".ensemble_id=7/conf_id=1.0.out"):
        (tmp_path / "a b%c#+é/files" / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / "a b%c#+é/files" / hidden).write_text("cut sh")
    want = sorted(map(tuple, logs.read_logs(spark, path, "orca").select("file", "text").collect()))
    for files, size in ((256, 4 << 20), (256, 1), (1, 4 << 20)):
        monkeypatch.setattr(logs, "FILES_AT_ONCE", files)
        monkeypatch.setattr(logs, "BYTES_AT_ONCE", size)
        back = logs.read_written_logs(spark, path, "orca")
        assert back.rdd.getNumPartitions() <= 4
        assert sorted(map(tuple, back.select("file", "text").collect())) == want and len(want) == 200
    keys = {(r.ensemble_id, r.conf_id) for r in back.select("ensemble_id", "conf_id").collect()}
    assert keys == {(None if e is None else str(e), str(c)) for e, c, _ in rows}
    with pytest.raises(ValueError):
        logs.read_written_logs(spark, path, "unknown")
    (tmp_path / "none").mkdir()
    assert logs.read_written_logs(spark, f"file:{tmp_path}/none", "orca").count() == 0
