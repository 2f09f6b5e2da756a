import io
import json
import os

import pytest

from driftloom import cli
from driftloom.sources import sinks


def test_arguments():
    config, _ = cli.configured(["Example.com/Docs/API/x", "-m", "5", "--concurrency", "4", "--json"])
    assert (config.seed_url, config.max, config.max_explicit, config.per_origin, config.json) == ("https://example.com/Docs/API/x", 5, True, 4, True)
    assert config.out_dir == "captures/example-com-docs-api"
    config, _ = cli.configured(["--stdin", "-o", "out"], io.StringIO(" https://example.com/a b"))
    assert config.seed_url == "https://example.com/a" and config.out_dir == "out" and not config.max_explicit


@pytest.mark.parametrize("argv", [[], ["--stdin", "example.com"], ["example.com", "-m", "0"], ["example.com", "--nope"], ["localhost"], ["http://10.0.0.1"], ["example.com", "-m", "x"]])
def test_bad_arguments(argv):
    with pytest.raises(cli.Bad):
        cli.configured(argv, io.StringIO(""))
    out, err = io.StringIO(), io.StringIO()
    assert cli.main([*argv, "--json"], io.StringIO(""), out, err) == 1 and json.loads(out.getvalue())["status"] == "error"


SUMMARY = dict(
    status="partial", seedUrl="https://e.com/", outDir="o", dryRun=False, written=2, failed=1, lowQuality=1, max=2, maxAppliesTo="all", maxReached=True, discovered=3, deduped=0, elapsedMs=1500.0, pagesPerSecond=1.33,
    bySource={}, byFailureKind={"http": 1}, errors=[], rootHash="r", renderedFiles=2, renderedBytes=9,
)


def test_results():
    config, _ = cli.configured(["example.com", "--fail-on-low-quality"])
    result = cli.json_result(SUMMARY, config)
    assert not result["ok"] and result["paths"]["manifest"].endswith("manifest.jsonl") and cli.run_ok(SUMMARY | {"lowQuality": 0}, config)
    text = cli.report(SUMMARY)
    assert "2 pages" in text and "http=1" in text and "limit of 2" in text


def test_clean_guard(tmp_path):
    home = tmp_path / "home"
    work = home / "work" / "deep"
    work.mkdir(parents=True)
    for bad in ("/", str(home), str(work), str(home / "work"), str(home / "Documents")):
        with pytest.raises(ValueError):
            sinks.check_cleanable(bad, str(work), str(home))
    sinks.check_cleanable(str(work / "out"), str(work), str(home))


def test_whole_files(tmp_path):
    sinks.write_whole(str(tmp_path), "a/b.md", "x\r\n")
    assert (tmp_path / "a/b.md").read_bytes() == b"x\r\n" and len(os.listdir(tmp_path / "a")) == 1
    for bad in ("../x", "/etc/x", "a/../../y"):
        with pytest.raises(ValueError):
            sinks.write_whole(str(tmp_path / "a"), bad, "x")


def test_agent_files(tmp_path):
    (tmp_path / "AGENTS.md").write_text("# Notes\n")
    (tmp_path / "CLAUDE.md").symlink_to(tmp_path / "AGENTS.md")
    assert sinks.install_agent_files({"seedUrl": "https://b.com/", "outDir": "c/b"}, str(tmp_path)) == ["AGENTS.md"]
    sinks.install_agent_files({"seedUrl": "https://a.com/", "outDir": "c/a"}, str(tmp_path))
    sinks.install_agent_files({"seedUrl": "https://b.com/", "outDir": "c/new"}, str(tmp_path))
    text = (tmp_path / "AGENTS.md").read_text()
    assert text.startswith("# Notes\n\n<!--") and text.count("- https://b.com/ -> c/new/") == 1 and "c/b/" not in text and text.index("a.com") < text.index("b.com")
