import hashlib
import os
import subprocess
import sys

import pytest

from dataprobe import jobs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_options():
    options = jobs.parse(["inds", "--path", "x", "--cores", "2", "--shuffle-partitions", "5"])
    assert (options.path, options.cores, options.shuffle_partitions) == ("x", 2, 5)
    with pytest.raises(SystemExit):
        jobs.parse(["inds"])


def test_report_of_a_folder(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("k\n1\n2\n3\n")
    jobs.main(["inds", "--path", str(tmp_path), "--master", "local[4]"])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "a.k < b.k" and out[1].startswith("inds took ") and len(out) == 2


def test_other_jobs(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("a;b\n1;1\n1;2\n2;1\n")
    jobs.main(["keys", "--path", str(tmp_path / "t.csv"), "--master", "local[4]"])
    assert capsys.readouterr().out.splitlines()[0] == "a, b"
    jobs.main(["primes", "--low", "5", "--high", "11", "--out", str(tmp_path / "primes")])
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "primes")).collect()) == [5, 7, 11]


def test_starts_from_another_folder(tmp_path):
    """As a script, with Python functions in the tasks of the audit; the package is sent along."""
    (tmp_path / "r.csv").write_text(f"id;name;chars;length;token;hint\n1;x;ABC;2;{sha('BC')};{sha('CB')}\n")
    script = os.path.join(os.path.dirname(jobs.__file__), "jobs.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, script, "audit", "--path", str(tmp_path / "r.csv"), "--out", str(tmp_path / "out"), "--master", "local[2]"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    import pyarrow.dataset as ds

    assert ds.dataset(str(tmp_path / "out")).to_table()["value"].to_pylist() == ["BC"]
    done = subprocess.run(
        [sys.executable, script, "primes", "--high", "10", "--out", str(tmp_path / "primes"), "--master", "local[2]"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
