"""Command line: capture one site with live HTTP or from an archive table."""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import replace

from .config import CONCURRENCY, PER_ORIGIN, Config
from .functions.address import refusal
from .functions.weburl import parse
from .operators import render

VERSION = "0.1.0"


class Bad(Exception):
    """A wrong command line."""


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Bad(f"{message}\n\n{self.format_usage()}")


def _positive(text: str) -> int:
    value = int(text) if re.fullmatch(r"\d+", text) else 0
    if value < 1:
        raise argparse.ArgumentTypeError("a positive integer is required")
    return value


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="driftloom", allow_abbrev=False)
    p.add_argument("url", nargs="?")
    p.add_argument("-o", "--out", help="output directory")
    p.add_argument("-m", "--max", type=_positive, help="most pages")
    p.add_argument("--concurrency", type=_positive, default=CONCURRENCY)
    p.add_argument("--user-agent")
    p.add_argument("--archive", help="Parquet archive (url, status, headers, set_cookies, body) to read instead of the network")
    for flag in ("clean", "dry-run", "page", "agent-files", "json", "quiet", "stdin", "ignore-robots", "fail-on-low-quality"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    return p


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")


def default_out(url: str) -> str:
    place = parse(url)
    parts = [slug(place.host.removeprefix("www.")), *(slug(p) for p in [x for x in place.path.split("/") if x][:2])]
    return "captures/" + ("-".join(p for p in parts if p) or "site")


def configured(argv: list[str], stdin=None) -> tuple[Config, argparse.Namespace]:
    args = parser().parse_args(argv)
    if args.stdin:
        if args.url:
            raise Bad("--stdin cannot be used with a URL argument")
        args.url = next(iter((stdin.read() if stdin else "").split()), None)
        if not args.url:
            raise Bad("no URL received on stdin")
    if not args.url:
        raise Bad("missing URL")
    url = parse(args.url if re.match("https?://", args.url, re.IGNORECASE) else f"https://{args.url}")
    if url is None:
        raise Bad(f"invalid URL: {args.url}")
    if unsafe := refusal(url.href):
        raise Bad(f"unsafe URL: {unsafe}")
    config = Config(
        seed_url=url.href, out_dir=args.out or default_out(url.href), max=args.max or 50, max_explicit=args.max is not None, concurrency=args.concurrency, per_origin=min(args.concurrency, PER_ORIGIN),
        clean=args.clean, dry_run=args.dry_run, agent_files=args.agent_files, page_only=args.page, ignore_robots=args.ignore_robots, fail_on_low_quality=args.fail_on_low_quality, json=args.json, quiet=args.quiet,
    )
    return (replace(config, user_agent=args.user_agent) if args.user_agent else config), args


def run_ok(summary: dict, config: Config) -> bool:
    return summary["written"] > 0 and (not config.fail_on_low_quality or summary["lowQuality"] == 0)


def json_result(summary: dict, config: Config) -> dict:
    names = {"summary": render.SUMMARY, "manifest": render.MANIFEST, "agentReadme": render.HANDOFF, "tree": render.TREE}
    keys = "status seedUrl outDir dryRun".split()
    rest = "written failed lowQuality max maxAppliesTo maxReached discovered deduped elapsedMs pagesPerSecond bySource byFailureKind errors rootHash renderedFiles renderedBytes".split()
    paths = {} if config.dry_run else {"paths": {k: f"{config.out_dir}/{v}" for k, v in names.items()}}
    return {"ok": run_ok(summary, config)} | {k: summary[k] for k in keys} | paths | {k: summary[k] for k in rest}


def report(summary: dict) -> str:
    """A run in a few lines, for people."""
    issues = ", ".join(f"{k}={n}" for k, n in summary["byFailureKind"].items())
    lines = [f"driftloom: {summary['status']}, {summary['written']} pages in {summary['elapsedMs'] / 1000:.1f} s to {summary['outDir']}"]
    if summary["failed"] or summary["lowQuality"]:
        lines.append(f"driftloom: {summary['failed']} failed{f' ({issues})' if issues else ''}, {summary['lowQuality']} of low quality")
    if summary["maxReached"]:
        lines.append(f"driftloom: stopped at the limit of {summary['max']} pages")
    return "\n".join(lines)


def main(argv: list[str] | None = None, stdin=None, out=None, err=None) -> int:
    argv, out, err = sys.argv[1:] if argv is None else argv, out or sys.stdout, err or sys.stderr
    try:
        config, args = configured(argv, stdin or sys.stdin)
        from pyspark.sql import SparkSession

        from .plans.pipeline import archive_fetch, run_site
        from .sources.http import Fetcher, PinnedTransport

        spark = SparkSession.builder.appName("driftloom").getOrCreate()
        if args.archive:
            fetch = archive_fetch(spark.read.parquet(args.archive), config)
        else:
            live = Fetcher(PinnedTransport(config.max_bytes, config.timeout_ms / 1000), config.user_agent, config.max_bytes, config.retry_http)
            fetch = lambda url: live.fetch(url)[0]
        note = (lambda m: None) if config.quiet or config.json else (lambda m: print(f"driftloom: {m}", file=err))
        result = run_site(spark, config, fetch, note)
        if config.json:
            print(json.dumps(json_result(result.summary, config)), file=out)
        elif not config.quiet:
            print(report(result.summary), file=err)
        return 0 if run_ok(result.summary, config) else 1
    except SystemExit as stop:
        return int(stop.code or 0)
    except Exception as error:  # noqa: BLE001  every fault becomes a message and an exit status
        if "--json" in argv:
            print(json.dumps({"ok": False, "status": "error", "error": str(error)}), file=out)
        else:
            print(error, file=err)
        return 1


if __name__ == "__main__":
    sys.exit(main())
