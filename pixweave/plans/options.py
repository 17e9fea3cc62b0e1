"""Options of a run, and their command-line form."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from ..functions import urls


VERSION = "0.2"
USAGE = """usage: python -m pixweave.plans.options [flags] URL
  --output-dir DIR    where files go, below folders of host and page
  --workers N         images that are fetched at a time (4)
  --limit-size N      only images whose longer side has N pixels
  --all-pages         follow links to next pages
  --max-pages N       pages at most
  --resolve-landings  look for originals on the pages that images lead to
  --verbose, -v       a line for every slot"""


class UsageError(ValueError):
    """Arguments that can't be meant; a command line ends with status 2."""


@dataclass(frozen=True)
class CrawlOptions:
    """A run over one page, or over a chain of pages where ``all_pages`` or ``max_pages`` above 1 asks for it."""

    url: str
    output_dir: str = ""
    workers: int = 4
    limit_size: int = 0
    all_pages: bool = False
    max_pages: int = 0
    resolve_landings: bool = False
    verbose: bool = False

    def __post_init__(self):
        parsed = urls.parse(self.url)
        if not self.url or parsed is None or parsed.scheme not in ("http", "https") or not parsed.host:
            raise UsageError("a page URL with http or https is needed")
        if self.workers <= 0:
            raise UsageError("workers must be above 0")
        if self.limit_size < 0 or self.max_pages < 0:
            raise UsageError("sizes and page counts can't be below 0")

    @property
    def paginates(self) -> bool:
        return self.all_pages or self.max_pages > 1


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise UsageError(message)


def parse_args(args: list[str]) -> CrawlOptions:
    """Options from arguments; flags may stand before and after the URL, with one dash or two."""
    parser = _Parser(add_help=False, allow_abbrev=False)
    parser.add_argument("url")
    for name, kind in (("output-dir", str), ("workers", int), ("limit-size", int), ("max-pages", int)):
        parser.add_argument(f"--{name}", f"-{name}", type=kind)
    for name in ("all-pages", "resolve-landings"):
        parser.add_argument(f"--{name}", f"-{name}", action="store_true", default=None)
    parser.add_argument("--verbose", "-verbose", "-v", action="store_true", default=None)
    found = vars(parser.parse_intermixed_args(args))
    return CrawlOptions(**{k: v for k, v in found.items() if v is not None})


def main(args: list[str], run=None) -> int:
    """The command line: 0 after a run, and for --help and --version; 1 where a run breaks off; 2 for wrong usage.

    ``run`` takes the options; without it the run goes over the network, with a session of its own.
    """
    if any(a.lstrip("-") in ("help", "h") and a.startswith("-") for a in args):
        print(USAGE)
        return 0
    if any(a.lstrip("-") == "version" and a.startswith("-") for a in args):
        print(f"pixweave {VERSION}")
        return 0
    try:
        options = parse_args(args)
    except UsageError as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 2
    try:
        (run or _live)(options)
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _live(options: CrawlOptions) -> None:
    from pyspark.sql import SparkSession

    from . import live

    live.run(SparkSession.builder.getOrCreate(), options)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
