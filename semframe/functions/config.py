"""Settings from an INI file."""

from __future__ import annotations

from configparser import ConfigParser


def get_config(path: str) -> ConfigParser:
    """Sections and values of a file; an unreadable file raises."""
    out = ConfigParser()
    with open(path, encoding="utf-8") as f:
        out.read_file(f)
    return out
