"""Logging: everything to the console, what matters to a file a day that is cut at a size and kept for some days."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from logging.handlers import RotatingFileHandler
from pathlib import Path

LOG = logging.getLogger("folioflow")


def set_up(folder: str | Path | None = None, max_bytes: int = 10_000_000, days: int = 7) -> logging.Logger:
    """Handlers for the library's logger: the console from DEBUG, and with ``folder`` files from INFO. Calling it again replaces them."""
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    LOG.setLevel(logging.DEBUG)
    console = logging.StreamHandler()
    console.setFormatter(logging.Formatter("%(levelname)-8s | %(name)s:%(funcName)s - %(message)s"))
    LOG.addHandler(console)
    if folder is not None:
        at = Path(folder)
        at.mkdir(parents=True, exist_ok=True)
        for old in at.glob("*.log*"):
            if time.time() - old.stat().st_mtime > days * 86_400:
                old.unlink(missing_ok=True)
        file = RotatingFileHandler(at / time.strftime("%Y-%m-%d.log"), maxBytes=max_bytes, backupCount=1000, encoding="utf-8")
        file.setLevel(logging.INFO)
        file.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s:%(funcName)s - %(message)s"))
        LOG.addHandler(file)
    return LOG


@contextmanager
def timed(seconds: dict[str, float], stage: str) -> Iterator[None]:
    """Adds the wall-clock seconds of a stage to ``seconds``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        seconds[stage] = seconds.get(stage, 0.0) + time.perf_counter() - began
        LOG.info("%s took %.1f s", stage, seconds[stage])
