"""The command line over the smallest data."""

from shardloom import cli


def test_commands(spark, data, tmp_path, capsys):
    assert cli.main(["validate", "top_pct(40) AND NOT source:x"]) == 0
    assert cli.main(["validate", "top_pct(40) AND ("]) == 1
    assert cli.main(["queries", "--grep", "dsl_"]) == 0 and "dsl_keep" in capsys.readouterr().out
    assert cli.main(["campaign", data, "keep", "--out", f"file://{tmp_path}", "--name", "k"], spark) == 0
    assert (tmp_path / "k" / "entries").is_dir()
    assert cli.main(["compare", data, "keep", "top_pct(50)"], spark) == 0
    assert cli.main(["select", data, "8", "--iteration", "2"], spark) == 0
    assert cli.main(["run", data, "source_rollup", "--rows", "3"], spark) == 0
    assert "source" in capsys.readouterr().out
