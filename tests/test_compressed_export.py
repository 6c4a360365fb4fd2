import glob
import os

from helpers import windows

from fleetpulse.sources import files
from fleetpulse.sources.files import read_feature_windows, write_jsonl


def test_compressed_export_holds_the_same_rows_in_far_fewer_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 150)
    table = windows(spark, [{"n": i, "cpu_pct_mean": float(i % 7)} for i in range(400)]).coalesce(1)
    sizes = {}
    for name, compression in (("plain", None), ("short", "gzip")):
        write_jsonl(table, f"{tmp_path}/{name}", compression=compression)
        parts = glob.glob(f"{tmp_path}/{name}/part-*")
        sizes[name] = sum(os.path.getsize(p) for p in parts)
    assert len(parts) == 3 and all(p.endswith(".json.gz") for p in parts)
    assert sizes["short"] * 5 < sizes["plain"]
    back = read_feature_windows(spark, f"{tmp_path}/short")
    assert back.count() == 400 and back.exceptAll(table).count() == 0
