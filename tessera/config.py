"""Settings from a .tessera file: YAML in the working folder, else in the home folder."""

from __future__ import annotations

from pathlib import Path

from .errors import ConfigError

NAME = ".tessera"
LISTS = ("rulepath", "langs", "contexts")


def load(folders: list[Path] | None = None) -> dict:
    """The first file's settings, {} without one. rulepath, langs and contexts become lists; a rulepath has to be there."""
    import yaml

    for folder in folders or [Path.cwd(), Path.home()]:
        file = folder / NAME
        if not file.is_file():
            continue
        try:
            found = yaml.safe_load(file.read_text("utf8")) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{file}: {e}") from e
        if not isinstance(found, dict):
            raise ConfigError(f"{file}: no settings by name")
        for k in LISTS:
            if isinstance(found.get(k), str):
                found[k] = [x.strip() for x in found[k].split(",") if x.strip()]
        missing = [p for p in found.get("rulepath", []) if not Path(p).exists()]
        if missing:
            raise ConfigError(f"{file}: no such rules: {', '.join(missing)}")
        return found
    return {}
