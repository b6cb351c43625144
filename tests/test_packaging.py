import subprocess
import sys

from pyspark import cloudpickle

import candor
from candor.operators import blocks, images


def test_task_functions_load_without_the_package(tmp_path):
    assert candor.__doc__
    path = tmp_path / "functions.pkl"
    path.write_bytes(cloudpickle.dumps([blocks.pair_kernel, blocks.cluster_kernel(1), blocks._group_matches, images._repetition]))
    code = f"import pickle; fs = pickle.load(open({str(path)!r}, 'rb')); import sys; assert 'candor' not in sys.modules; print(len(fs))"
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd="/", capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "4", done.stderr
