from rotamera.sources import logs
from rotamera.streaming.records import named, stream_records

TEXT = "Program Version 6.0\nFINAL SINGLE POINT ENERGY   {e}\nORCA TERMINATED NORMALLY\n"


def test_resume_and_no_repeats(spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    folder = tmp_path / "in" / "mol"
    folder.mkdir(parents=True)
    (folder / "1_p0.out").write_text(TEXT.format(e=-1.5))
    stream_records(spark, inbox, out, ckpt).awaitTermination()
    (folder / "2_p0.out").write_text(TEXT.format(e=-2.5))
    (folder / "1_p0_again.out").write_text(TEXT.format(e=-9.5))
    (folder / "notes.out").write_text("not a calculation")
    stream_records(spark, inbox, out, ckpt).awaitTermination()
    stream_records(spark, inbox, out, ckpt).awaitTermination()
    rows = {(r.ensemble_id, r.conf_id, r.protocol): r.e for r in spark.read.parquet(out).collect()}
    assert rows == {("mol", 1, 0): -1.5, ("mol", 2, 0): -2.5}
    # a fresh checkpoint replays all files and still adds nothing
    stream_records(spark, inbox, out, str(tmp_path / "ckpt2")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    batch = logs.parse_logs(named(logs.read_logs(spark, str(folder), "orca")), "orca")
    keys = {(r.ensemble_id, r.conf_id, r.protocol) for r in batch.where("conf_id IS NOT NULL").collect()}
    assert keys == set(rows)
