"""Compiled patterns by their text; the cache is bounded, patterns made from data are not looked up here."""

from __future__ import annotations

import functools

import regex


@functools.lru_cache(maxsize=512)
def pat(pattern: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(pattern, flags)
