"""Names: headers matched to columns, tables turned into file names."""

from __future__ import annotations

import re

# What is ignored when names are compared, what a file name may hold.
IGNORED_IN_NAMES = r"[\s_-]"
UNSAFE_IN_FILES = r"[^a-zA-Z0-9._-]"
FALLBACK_FILE_NAME = "database"


def comparable(name: str) -> str:
    return re.sub(IGNORED_IN_NAMES, "", name.lower())


def auto_map(headers: list[str], columns: list[str]) -> dict[str, str]:
    """Headers whose name equals a column name but for case, spaces, ``_`` and ``-``."""
    by_name = {comparable(column): column for column in columns}
    return {h: by_name[comparable(h)] for h in headers if comparable(h) in by_name}


def effective_mapping(mapping: dict[str, str]) -> dict[str, str]:
    """Column -> header: blank targets are skipped, a later duplicate target wins."""
    return {column: header for header, column in mapping.items() if column}


def safe_file_name(name: str) -> str:
    safe = re.sub(r"_+", "_", re.sub(UNSAFE_IN_FILES, "_", name.strip())).strip("_.")
    return safe or FALLBACK_FILE_NAME


def unique_file_names(names: list[str], suffix: str) -> list[str]:
    """One safe name per input, repeats numbered from two."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = safe_file_name(name)
        candidate, number = base + suffix, 2
        while candidate in taken:
            candidate, number = f"{base}_{number}{suffix}", number + 1
        taken.add(candidate)
        result.append(candidate)
    return result
