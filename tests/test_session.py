"""The session helpers."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)


def test_local_fallback_folder_without_a_setting(tmp_path):
    """A local session without spark.checkpoint.dir gets one folder of its own and keeps it."""
    code = (
        "from urlguard.session import local_session, new_folder, work_folder\n"
        "spark = local_session(1, 1)\n"
        "path = new_folder(spark, 'x')\n"
        "spark.range(3).write.parquet(path)\n"
        "assert spark.read.parquet(path).count() == 3\n"
        "assert work_folder(spark) == work_folder(spark) and path.startswith(work_folder(spark))\n"
        "spark.stop()\n"
    )
    env = os.environ | {"PYTHONPATH": REPO, "SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [p for p in tmp_path.iterdir() if p.name.startswith("urlguard-")]
