"""What the jobs share: their options and their log."""

from __future__ import annotations

import argparse
import json
import logging


def options(defaults: dict, given: dict) -> dict:
    """``defaults`` with what was given; a key that is not known, or one left at ``...``, is an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    found = {**defaults, **given}
    missing = sorted(k for k, v in found.items() if v is ...)
    if missing:
        raise ValueError(f"options without a value: {', '.join(missing)}")
    return found


def command_line(argv: list[str], defaults: dict, about: str) -> dict:
    """Options from ``--config FILE`` (JSON) and from ``--NAME VALUE``, which wins."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", help="a JSON file of options")
    for name, value in defaults.items():
        kind = type(value) if value is not None and value is not ... else str
        p.add_argument(f"--{name.replace('_', '-')}", type=kind, help="needed" if value is ... else f"default: {value}")
    given = vars(p.parse_args(argv))
    config = given.pop("config")
    found = {}
    if config:
        with open(config, encoding="utf-8") as f:
            found = json.load(f)
    return options(defaults, found | {k: v for k, v in given.items() if v is not None})


def logger(name: str) -> logging.Logger:
    """A log that the command line sends to standard error."""
    return logging.getLogger(name)


def log_to_stderr() -> None:
    """For command lines: times and messages."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
