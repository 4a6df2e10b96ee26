"""Log events of runs, by Python's logging: one logger, set up once, to stdout, stderr or a file."""

from __future__ import annotations

import logging
import sys

LEVELS = {"trace": logging.DEBUG, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
log = logging.getLogger("loomtext")


def init(level: str = "info", output: str = "stderr", path: str | None = None) -> logging.Logger:
    """ValueError for an unknown level or output, or a file without a path."""
    if level.lower() not in LEVELS or output not in ("stdout", "stderr", "file"):
        raise ValueError(f"unknown level {level!r} or output {output!r}")
    if output == "file" and not path:
        raise ValueError("a log file needs a path")
    handler = logging.FileHandler(path) if output == "file" else logging.StreamHandler(getattr(sys, output))
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(LEVELS[level.lower()])
    log.propagate = False
    return log


def event(kind: str, level: str = "info", **values) -> None:
    """One line: the kind and its values, in the order given."""
    log.log(LEVELS[level], "%s %s", kind, " ".join(f"{k}={v!r}" for k, v in values.items()))
