"""The command line and model configuration."""

import numpy as np
import pytest

from tidefold import cli, models
from tidefold.errors import ConfigError


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    path = tmp_path_factory.mktemp("cli") / "data.csv"
    path.write_text("a,kind,b,y\n" + "".join(f"{a},{'uv'[int(b > 0.5)]},{b},{3 * a - b}\n" for a, b in x))
    return path


def test_train_predict_inspect_export(spark, table, tmp_path, capsys):
    out = str(tmp_path / "m")
    assert cli.main(["train", str(table), out, "--set", "steps=5", "--set", "rate=0.3", "--set", "grace=30", "--set", "start=10"], spark) == 0
    assert cli.main(["predict", str(table), out, str(tmp_path / "p")], spark) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "p")).collect()
    assert len(got) == 300 and all(len(r.prediction.split(".")[1]) == 6 for r in got)
    assert cli.main(["inspect", out], spark) == 0 and "trees 5" in capsys.readouterr().out
    for form in ("packed", "packed16", "onnx"):
        assert cli.main(["export", out, str(tmp_path / form), "--format", form], spark) == 0
        assert (tmp_path / form).stat().st_size > 50


@pytest.mark.parametrize("name", ["rls", "hoeffding"])
def test_eval(spark, table, capsys, name):
    # a scaled row has no constant, so that a model without intercept cannot meet the mean
    assert name != "rls" or cli.main(["eval", str(table), "--model", "rls", "--scaled"], spark) == 0
    capsys.readouterr()
    data, more = (table, []) if name == "rls" else (table, ["--target", "kind"])
    assert cli.main(["eval", str(data), "--model", name, *more], spark) == 0
    said = dict(line.split() for line in capsys.readouterr().out.splitlines())
    assert float(said["r2"]) > 0.8 if name == "rls" else float(said["kappa"]) > -1


def test_configuration(tmp_path, capsys):
    for name in models.MODELS:
        assert models.build(name, 3).new() is not None or name == "krls"
    assert cli.main(["config"]) == 0
    path = tmp_path / "c.toml"
    path.write_text(capsys.readouterr().out)
    assert models.read_config(str(path))[0] == "sgbt" and cli.main(["config", "--check", str(path)]) == 0
    path.write_text('model = "sgbt"\n[settings]\nrate = 7.0\n')
    assert cli.main(["config", "--check", str(path)]) == 1
    for bad in (("nothing", {}), ("sgbt", {"steps": 0}), ("sgbt", {"loss": "odd"}), ("linear", {"oops": 1}), ("attention", {"mode": "odd"})):
        with pytest.raises(ConfigError):
            models.build(bad[0], 2, **bad[1])
