"""Modules in git repositories: parsed addresses and a cache of shallow clones."""

from __future__ import annotations

import hashlib
import subprocess
from pathlib import Path


def parse(address: str) -> tuple[str, str | None, str | None]:
    """(url, folder, ref) of ``url[#folder][@ref]``."""
    url, framed, rest = address.partition("#")
    if framed:
        folder, at, ref = rest.rpartition("@") if "@" in rest else (rest, "", "")
        return url, folder or None, ref or None
    scheme = url.find("://") + 3 if "://" in url else 0
    head, _, ref = url[scheme:].partition("@")
    return url[:scheme] + head, None, ref or None


def cache_folder(url: str, ref: str | None, home: Path | None = None) -> Path:
    key = hashlib.sha256(f"{url}#{ref or 'HEAD'}".encode()).hexdigest()[:16]
    return (home or Path.home()) / ".quillmill" / "cache" / key


def module_folder(address: str, home: Path | None = None) -> Path:
    """The module's folder in a clone, made where there is none."""
    url, folder, ref = parse(address)
    at = cache_folder(url, ref, home)
    if not at.exists():
        at.parent.mkdir(parents=True, exist_ok=True)
        done = subprocess.run(["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, str(at)], capture_output=True, text=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git clone of {url} failed: {done.stderr.strip()}")
    out = at / folder if folder else at
    if not out.exists():
        raise FileNotFoundError(f"{folder} is not in {url}")
    return out
