"""Settings from the environment or a `.env` file; the environment wins."""

from __future__ import annotations

import os
import re

#: Variable: default.
KNOWN = {"TIDEMILL_SEP": ",", "TIDEMILL_REGION": "PA"}


def read_env(path: str) -> dict[str, str]:
    """KEY=value lines; `export`, quotes and ` # comments` are understood."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
            if m:
                value = m[2]
                if value[:1] in "'\"" and value[:1] and value[0] in value[1:]:
                    value = value[1 : value.index(value[0], 1)]
                else:
                    value = re.split(r"\s#", value)[0].strip()
                out[m[1]] = value
    return out


def setting(name: str, env_file: str | None = ".env") -> str:
    if name in os.environ:
        return os.environ[name]
    held = read_env(env_file) if env_file and os.path.exists(env_file) else {}
    return held.get(name, KNOWN[name])
