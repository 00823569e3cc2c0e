"""Python stages of every query on workers that do not have the package on their path."""

import subprocess
import sys
import textwrap

SCRIPT = """
    import os, sys
    repo, sf_dir = sys.argv[1:]
    os.environ.pop("PYTHONPATH", None)
    sys.path.insert(0, repo)                                  # the driver's path alone: workers get what is sent
    from shoplens.session import build_session
    from shoplens.plans.registry import entries
    spark = build_session("local[2]", 2)
    import shoplens
    def where(_):
        import shoplens
        return [shoplens.__file__]
    rows = entries()["vec_quantile"].build(spark, sf_dir).count()
    print("rows", rows, [f for f in spark.sparkContext.parallelize([0], 1).mapPartitions(where).collect()][0])
    spark.stop()
"""


def test_the_package_is_sent_with_every_query(sf_dir, tmp_path):
    import os
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(SCRIPT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), repo, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    line = [x for x in done.stdout.splitlines() if x.startswith("rows")][0]
    assert int(line.split()[1]) > 0
    assert line.split()[2].endswith(".zip/shoplens/__init__.py")         # not the driver's folder
