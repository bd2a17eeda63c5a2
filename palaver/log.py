"""Rotating logs of the driver: application, user activity and errors, and a timer."""

from __future__ import annotations

import logging
import os
import time
from logging.handlers import RotatingFileHandler

FOLDER = os.environ.get("PALAVER_LOG_DIR", "")
MAX_BYTES, BACKUPS = 5_000_000, 5


def get_logger(name: str = "palaver", file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console, and to a rotating file where a folder is set."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(level)
        log.addHandler(logging.StreamHandler())
        if FOLDER and file:
            os.makedirs(FOLDER, exist_ok=True)
            log.addHandler(RotatingFileHandler(os.path.join(FOLDER, file), maxBytes=MAX_BYTES, backupCount=BACKUPS, encoding="utf-8"))
    return log


def _joined(*parts, **more) -> str:
    return " | ".join([str(p) for p in parts if p not in (None, "")] + [f"{k}={v}" for k, v in more.items()])


def log_user_activity(action: str, details: str | None = None, user_id: str | None = None) -> None:
    get_logger("palaver.activity", "user_activity.log").info(_joined(action, details, **({"user": user_id} if user_id else {})))


def log_error(error: Exception, context: str | None = None, **more) -> None:
    get_logger("palaver.errors", "errors.log").error(_joined(type(error).__name__, error, context, **more))


def log_performance(operation: str, seconds: float, **more) -> None:
    """The seconds of an operation that was timed elsewhere."""
    get_logger().info(_joined(operation, f"{seconds:.3f}s", **more))


class LogPerformance:
    """with LogPerformance("step"): ... writes the seconds and whether it ended well; errors pass through."""

    def __init__(self, operation: str, **more):
        self.operation, self.more, self.seconds = operation, more, None

    def __enter__(self):
        self._t = time.perf_counter()
        return self

    def __exit__(self, kind, error, trace):
        self.seconds = time.perf_counter() - self._t
        get_logger().info(_joined(self.operation, f"{self.seconds:.3f}s", "ok" if kind is None else "failed", **self.more))
        return False
