"""Where a scan looks: home and environment in paths, examples from documents, and a parent folder to fall back to.

These look at the driver's file system, where a user types paths; addresses
with a scheme pass unchanged.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from wavelake.operators import datasets

#: How documents write a path that is none; the name that begins an out-of-tree module's folder; a scan's options file.
PLACEHOLDER = re.compile("^/?path/to/", re.IGNORECASE)
MODULE, OPTIONS = "gr-", ".wavelake.toml"


def expanded(path: str) -> str:
    """A path with ~ and environment variables put in."""
    return os.path.expandvars(os.path.expanduser(path))


def is_placeholder(path: str) -> bool:
    return bool(PLACEHOLDER.search(path))


def home(start: str | None = None) -> Path:
    """The nearest folder from start upwards with an options file or a pyproject.toml; start itself if there is none."""
    here = Path(start or os.getcwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / OPTIONS).is_file() or (p / "pyproject.toml").is_file()), here)


def has_modules(folder: Path) -> bool:
    try:
        return any(c.is_dir() and c.name.startswith(MODULE) for c in folder.iterdir())
    except OSError:
        return False


def inferred(start: str | None = None) -> str | None:
    """The options' scan root, else the parent of the home folder, whichever first has modules in it."""
    root = home(start)
    named = []
    if (root / OPTIONS).is_file():
        told = datasets.options((root / OPTIONS).read_text(encoding="utf-8"))["root"]
        named = [Path(root, expanded(told))] if told else []
    return next((str(p.resolve()) for p in [*named, root.parent] if has_modules(p)), None)


def scan_root(path: str | None, start: str | None = None) -> str:
    """The folder to scan: an existing one that path names, seen from the working folder, the home folder or its parent.

    No path, or one from a document's example, stands for the inferred folder;
    a ValueError says what could not be found.
    """
    if path and "://" in path:
        return path
    if not path or is_placeholder(expanded(path)):
        if (found := inferred(start)) is not None:
            return found
        raise ValueError(f"{path!r} is an example from a document; name the folder that holds your modules" if path else "no folder to scan was given and none could be inferred")
    root = home(start)
    for base in (Path(start or os.getcwd()), root, root.parent):
        if (at := base / expanded(path)).is_dir():
            return str(at.resolve())
    raise ValueError(f"path does not exist: {expanded(path)}")
