"""Configuration on the driver: environment files, TOML files in layers, validation and merging."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from loomtext.functions.scalars import NO_KEYS
from loomtext.operators.filters import FilterConfig

PROJECT_FILE = ".loomtext.toml"
ENV_PREFIX = "LOOMTEXT_"


class ConfigError(ValueError):
    """A configuration that can't be used."""


# -- environment ---------------------------------------------------------------------------


def env_files(folder: str | Path) -> list[Path]:
    """.env, then .env.* but examples, in order."""
    d = Path(folder)
    more = sorted(p for p in d.glob(".env.*") if not p.name.endswith(".example"))
    return [p for p in [d / ".env", *more] if p.is_file()]


def parse_env(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            v = m.group(2)
            quoted = len(v) > 1 and v[0] == v[-1] and v[0] in "\"'"
            out[m.group(1)] = v[1:-1] if quoted else re.sub(r"\s+#.*$", "", v)
    return out


def load_env(folders: list[str | Path], env: dict[str, str], override: bool = False) -> dict[str, str]:
    """env with the variables of the files; those that exist are kept unless override."""
    out = dict(env)
    for d in folders:
        for p in env_files(d):
            for k, v in parse_env(p.read_text()).items():
                if override or k not in out:
                    out[k] = v
    return out


_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)")


def expand(value: Any, env: dict[str, str]) -> Any:
    """Variables in strings, lists and dicts of any depth; unknown ones stay."""
    if isinstance(value, str):
        return _VAR.sub(lambda m: env.get(m.group(1) or m.group(2), m.group()), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def has_variables(text: str) -> bool:
    return bool(_VAR.search(text))


# -- configurations ---------------------------------------------------------------------------


@dataclass
class Provider:
    id: str = ""
    kind: str = "llm"
    url: str = ""
    api_key: str = ""
    models: list[str] = field(default_factory=list)
    rate_limit: int = 10
    max_input_chars: int = 4000
    custom_user_prompt: str | None = None
    enabled: bool = True
    extra_params: dict[str, str] = field(default_factory=dict)


@dataclass
class GlobalConfig:
    log_level: str = "info"
    providers: list[Provider] = field(default_factory=list)

    def validate(self) -> "GlobalConfig":
        """Providers that can't work are dropped; ConfigError for a repeated id, a prompt without
        {text}, or if none is left of those that are enabled."""
        if self.log_level.lower() not in ("trace", "debug", "info", "warn", "error"):
            raise ConfigError(f"unknown log level {self.log_level!r}")
        seen = set()
        for p in self.providers:
            if p.id in seen:
                raise ConfigError(f"repeated provider {p.id!r}")
            seen.add(p.id)
            if p.custom_user_prompt is not None and "{text}" not in p.custom_user_prompt:
                raise ConfigError(f"the prompt of {p.id!r} has no {{text}}")
        good = [p for p in self.providers if p.enabled and usable(p)]
        if any(p.enabled for p in self.providers) and not good:
            raise ConfigError("no provider can be used")
        return replace(self, providers=good)


def usable(p: Provider) -> bool:
    key = p.api_key
    fine = bool(key) and not (key.startswith("${") and key.endswith("}")) and key.lower() not in NO_KEYS
    return (fine or p.kind == "deeplx") and (p.kind != "llm" or bool(p.models))


@dataclass
class ProjectConfig:
    source_langs: list[str] = field(default_factory=list)
    target_lang: str = "en"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    use_gitignore: bool = True
    gitignore_patterns: list[str] = field(default_factory=list)
    comments: bool = True
    doc_strings: bool = True
    string_literals: bool = True
    min_bytes: int = 2
    max_bytes: int = 10_000
    max_char_count: int = 5000
    split_max_chars: int = 4000
    batch_size: int = 50
    concurrency: int = 5
    cache_mode: str = "local"
    cache_directory: str | None = None
    min_confidence: float = 0.7
    filter: FilterConfig = field(default_factory=FilterConfig)
    custom_patterns: list[dict] = field(default_factory=list)
    state_machines: list[dict] = field(default_factory=list)

    def normalized(self) -> "ProjectConfig":
        return replace(self, source_langs=[x.lower() for x in self.source_langs], target_lang=self.target_lang.lower())

    def validate(self) -> "ProjectConfig":
        self.filter.validate()
        for p in self.custom_patterns:
            try:
                re.compile(p["regex"])
            except (KeyError, re.error) as x:
                raise ConfigError(f"invalid custom pattern: {x}") from None
        if not self.target_lang:
            raise ConfigError("no target language")
        if self.batch_size < 1 or self.concurrency < 1:
            raise ConfigError("batch size and concurrency must be positive")
        if self.cache_mode not in ("local", "global"):
            raise ConfigError(f"unknown cache mode {self.cache_mode!r}")
        return self


def merged(base, other):
    """base with the fields of other that aren't empty and not the default; switches always count."""
    fresh = type(other)()
    changes = {}
    for f in fields(other):
        v = getattr(other, f.name)
        if is_dataclass(v):
            changes[f.name] = merged(getattr(base, f.name), v)
        elif isinstance(v, bool) or (v not in (None, "", [], {}) and v != getattr(fresh, f.name)):
            changes[f.name] = v
    return replace(base, **changes)


def _made(kind, data: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = set(data) - set(known)
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = dict(data)
    if kind is ProjectConfig and isinstance(out.get("filter"), dict):
        out["filter"] = _made(FilterConfig, out["filter"])
    if kind is GlobalConfig and "providers" in out:
        out["providers"] = [_made(Provider, p) for p in out["providers"]]
    return kind(**out)


def read(kind, path: str | Path, env: dict[str, str] | None = None):
    """A configuration of a TOML file, its variables expanded."""
    try:
        return _made(kind, expand(tomllib.loads(Path(path).read_text()), env or {}))
    except (OSError, tomllib.TOMLDecodeError, TypeError) as x:
        raise ConfigError(f"{path}: {x}") from None


def find_project_file(start: str | Path) -> Path | None:
    """The project file of a folder or its two parents."""
    d = Path(start).resolve()
    return next((p / PROJECT_FILE for p in [d, *d.parents][:3] if (p / PROJECT_FILE).is_file()), None)


def with_env(cfg: GlobalConfig, env: dict[str, str]) -> GlobalConfig:
    """Variables with the prefix win over files."""
    level = env.get(ENV_PREFIX + "LOG_LEVEL")
    keys = {p.id: env.get(f"{ENV_PREFIX}{re.sub('[^A-Za-z0-9]', '_', p.id).upper()}_API_KEY") for p in cfg.providers}
    return replace(cfg, log_level=level or cfg.log_level, providers=[replace(p, api_key=keys[p.id] or p.api_key) for p in cfg.providers])


def load(start: str | Path = ".", global_files: list[str | Path] = (), project_file: str | Path | None = None, env: dict[str, str] | None = None) -> tuple[GlobalConfig, ProjectConfig]:
    """(global, project): environment files, global files in order, the environment, the project
    file or defaults."""
    env = load_env([start], dict(os.environ) if env is None else env)
    g = GlobalConfig()
    for f in global_files:
        if Path(f).is_file():
            g = merged(g, read(GlobalConfig, f, env))
    path = Path(project_file) if project_file else find_project_file(start)
    p = read(ProjectConfig, path, env) if path else ProjectConfig()
    return with_env(g, env).validate(), p.normalized().validate()


def _toml(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k} = {_toml(x)}" for k, x in v.items() if x is not None) + "}"
    return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def save(cfg, path: str | Path) -> None:
    """A configuration as TOML; read() gives it back."""
    plain = lambda v: {f.name: plain(getattr(v, f.name)) for f in fields(v)} if is_dataclass(v) else [plain(x) for x in v] if isinstance(v, list) else v
    lines = [f"{k} = {_toml(v)}" for k, v in plain(cfg).items() if v is not None]
    Path(path).write_text("\n".join(lines) + "\n")
