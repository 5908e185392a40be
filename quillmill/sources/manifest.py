"""Manifests of modules and projects: YAML on the driver, checked, with defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml

# fixed values: what the manifests allow
STRATEGIES, SOURCES, REFRESH = ("heading", "fixed", "definition"), ("markdown", "pdf", "pptx", "docx", "url"), ("daily", "weekly", "monthly")
CONFIG, META, CACHE = ".context/config.yaml", ".context/.build-meta.json", ".context/.contextualize-cache.json"


class ManifestError(ValueError):
    pass


def _among(value, allowed: tuple[str, ...], what: str):
    if value is not None and value not in allowed:
        raise ManifestError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass
class Override:
    pattern: str
    strategy: str | None = None
    max_tokens: int | None = None
    overlap_tokens: int | None = None
    heading_level: int | None = None

    def __post_init__(self):
        _among(self.strategy, STRATEGIES, "strategy")


@dataclass
class Chunking:
    strategy: str = "heading"
    max_tokens: int = 500
    overlap_tokens: int = 50
    heading_level: int = 2
    overrides: list[Override] = field(default_factory=list)
    contextualize: bool = False
    contextualize_model: str = ""

    def __post_init__(self):
        _among(self.strategy, STRATEGIES, "strategy")
        self.overrides = [o if isinstance(o, Override) else Override(**o) for o in self.overrides]


@dataclass
class Source:
    type: str
    path: str | None = None
    url: str | None = None
    refresh: str | None = None

    def __post_init__(self):
        _among(self.type, SOURCES, "type")
        _among(self.refresh, REFRESH, "refresh")


@dataclass
class Module:
    name: str
    version: str = "0.1.0"
    description: str = ""
    tags: list[str] = field(default_factory=list)
    depends_on: list[str] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    chunking: Chunking = field(default_factory=Chunking)
    extraction: dict | None = None

    def __post_init__(self):
        self.sources = [s if isinstance(s, Source) else Source(**s) for s in self.sources]
        self.chunking = self.chunking if isinstance(self.chunking, Chunking) else Chunking(**self.chunking)


@dataclass
class Reference:
    path: str | None = None
    git: str | None = None
    extraction: dict | None = None

    def __post_init__(self):
        if bool(self.path) == bool(self.git):
            raise ManifestError("a module reference has either a path or a git address")


@dataclass
class Project:
    modules: list[Reference] = field(default_factory=list)
    chunk_defaults: dict = field(default_factory=dict)
    output: dict = field(default_factory=lambda: {"chunks_dir": ".context/chunks"})
    extraction: dict | None = None

    def __post_init__(self):
        self.modules = [m if isinstance(m, Reference) else Reference(**m) for m in self.modules]
        self.output = {"chunks_dir": ".context/chunks"} | self.output


def _parsed(kind, data):
    known = {f.name for f in fields(kind)}
    try:
        return kind(**{k: v for k, v in (data or {}).items() if k in known})
    except TypeError as e:
        raise ManifestError(str(e)) from e


def _plain(value) -> dict:
    """Without what is unset."""
    return {k: v for k, v in asdict(value).items() if v not in (None, [], {})}


def load_module(folder: str | Path) -> Module:
    path = Path(folder).resolve() / "module.yaml"
    if not path.exists():
        raise FileNotFoundError(f"no module.yaml in {path.parent}")
    return _parsed(Module, yaml.safe_load(path.read_text()))


def save_module(module: Module, folder: Path) -> None:
    (folder / "module.yaml").write_text(yaml.safe_dump(_plain(module), default_flow_style=False, sort_keys=False))


def issues_of(folder: str | Path) -> list[str]:
    """What is wrong with a module's folder; nothing if it can be built."""
    at = Path(folder).resolve()
    if not at.is_dir():
        return [f"not a folder: {at}"]
    if not (at / "module.yaml").exists():
        return ["module.yaml is missing"]
    try:
        load_module(at)
    except (ManifestError, yaml.YAMLError) as e:
        return [f"module.yaml is invalid: {e}"]
    if not (at / "content").exists():
        return ["content/ is missing"]
    return [] if any((at / "content").rglob("*.md")) else ["content/ holds no markdown"]


def load_project(root: str | Path) -> Project:
    path = Path(root) / CONFIG
    return _parsed(Project, yaml.safe_load(path.read_text())) if path.exists() else Project()


def save_project(project: Project, root: str | Path) -> None:
    path = Path(root) / CONFIG
    path.parent.mkdir(parents=True, exist_ok=True)
    data = {"modules": [_plain(m) for m in project.modules], "chunk_defaults": project.chunk_defaults, "output": project.output}
    path.write_text(yaml.safe_dump(data, default_flow_style=False, sort_keys=False))


def init_project(root: str | Path) -> None:
    """Config and chunk folder, where they do not exist."""
    if not (Path(root) / CONFIG).exists():
        save_project(Project(), root)
    (Path(root) / load_project(root).output["chunks_dir"]).mkdir(parents=True, exist_ok=True)


def create_module(name: str, parent: str | Path = ".") -> Path:
    at = Path(parent).resolve() / name
    (at / "content").mkdir(parents=True, exist_ok=False)
    save_module(Module(name, description=f"{name} context module"), at)
    (at / "content" / "overview.md").write_text(f"# {name}\n\nWhat this module is about.\n")
    return at


def add_reference(root: str | Path, path: str) -> bool:
    """Register a module once; false if it is there."""
    project = load_project(root)
    if any(m.path == path for m in project.modules):
        return False
    project.modules.append(Reference(path=path))
    save_project(project, root)
    return True


def resolve(ref: Reference, root: str | Path) -> Path:
    if ref.git:
        from .git import module_folder

        return module_folder(ref.git)
    path = Path(ref.path).expanduser()
    return (path if path.is_absolute() else Path(root) / path).resolve()


def read_json(path: str | Path) -> dict:
    """Nothing for a file that is missing or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def write_json(path: str | Path, data: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False))


def frontmatter_tags(text: str) -> list[str]:
    """Tags of a closed leading block, as a list."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    try:
        found = (yaml.safe_load(text[3:end]) or {}).get("tags") if end > 0 else None
    except (yaml.YAMLError, AttributeError):
        return []
    return [str(t) for t in found] if isinstance(found, list) else [str(found)] if found else []
