import pytest

from wavetide import cli
from wavetide.kernels import dsp
from wavetide.sources.wav import write_wav


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('wav')}/in"
    rows = [("tone", (0.5 * dsp.tone(440, sr=4000, length=12000)).tolist()), ("clicks", (0.5 * dsp.clicks([0.5, 1.0, 1.5, 2.0], sr=4000, length=12000)).tolist())]
    write_wav(spark.createDataFrame(rows, "signal_id string, y array<double>"), path, sr=4000)
    return path


@pytest.mark.parametrize("command", ["info", *cli.COMMANDS])
def test_every_command_gives_rows(spark, folder, command):
    args = cli.parser().parse_args([command, folder, "--sr", "4000", "--n-fft", "512", "--hop-length", "128", "--n-mels", "20"])
    if command == "spectral-contrast":
        args.sr = 22050.0
    got = cli.run(spark, command, folder, args)
    assert got.count() > 0


def test_output_formats(spark, folder, capsys, tmp_path):
    for kind in ("text", "json", "csv"):
        assert cli.main(["info", folder, "--format", kind]) == 0
        assert "tone.wav" in capsys.readouterr().out
    assert cli.main(["rms", folder, "--sr", "4000", "--format", "csv", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "o")).count() > 0
