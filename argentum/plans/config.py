"""Settings of a home folder, and which library a command works on."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

HOME_VARIABLE, FILE = "ARGENTUM_HOME", "config.toml"


@dataclass(frozen=True)
class Config:
    default_library: str | None = None
    default_path: str | None = None
    default_model: str | None = None
    min_read_rate_mb_s: int | None = None


def load_config(home: str) -> Config:
    """The home's settings; none without a file, an error for one that doesn't parse or has values of other kinds."""
    path = os.path.join(home, FILE)
    try:
        with open(path, "rb") as f:
            table = tomllib.load(f)
    except FileNotFoundError:
        return Config()
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path} is not valid TOML: {e}") from e
    known = {f.name: table[f.name] for f in fields(Config) if f.name in table}
    for name, value in known.items():
        if name == "min_read_rate_mb_s":
            if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                raise ValueError(f"{path}: {name} must be a whole number above 0")
        elif not isinstance(value, str) or not value:
            raise ValueError(f"{path}: {name} must be a text")
    return Config(**known)


def resolve_home(environment: dict | None = None) -> tuple[str, bool]:
    """(home folder, whether the environment names it)."""
    named = (os.environ if environment is None else environment).get(HOME_VARIABLE)
    return (named, True) if named else (os.path.expanduser("~/.argentum"), False)


def resolve_library(explicit: str | None = None, environment: dict | None = None) -> tuple[str, str | None]:
    """(library folder, configured folder that was passed over): explicit, else the environment's home, else the configured one, else the home."""
    if explicit:
        return explicit, None
    home, named = resolve_home(environment)
    configured = load_config(home).default_library
    if named:
        return home, configured if configured != home else None
    return configured or home, None
