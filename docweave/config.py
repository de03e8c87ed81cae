"""Parameters of a site and their validation, on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace


class ConfigError(ValueError):
    """A configuration that must not be used."""


@dataclass(frozen=True)
class Config:
    """Folders are below project_root unless resolved() has made them absolute."""

    content_dir: str = "content"
    output_dir: str = "public"
    asset_dir: str = "assets"
    rag_dir: str = "rag-archive"
    template: str = "templates/layout.html"
    project_root: str = "."
    site_name: str = "Site"
    siteurl: str = ""
    default_description: str = ""
    port: int = 8080
    max_asset_size_bytes: int = 5 << 20
    check_asset_health: bool = False
    graph_explorer: bool = True

    @property
    def base_path(self) -> str:
        """The path part of the site's URL, without a closing slash."""
        return re.sub(r"^https?://[^/]*", "", self.siteurl).rstrip("/")

    def resolved(self, root: str | None = None, **flags) -> Config:
        """Absolute folders; flags go before the file's values, these before the root's defaults."""
        c = replace(self, **{k: v for k, v in flags.items() if v is not None})
        root = os.path.abspath(root or c.project_root)
        folder = lambda p: p if os.path.isabs(p) else os.path.join(root, p)
        return replace(c, project_root=root, **{k: folder(getattr(c, k)) for k in ("content_dir", "output_dir", "asset_dir", "rag_dir", "template")})

    def validated(self, absolute: bool = False) -> Config:
        if not 1 <= self.port <= 65535:
            raise ConfigError(f"port {self.port} is not between 1 and 65535")
        if self.siteurl and not (re.fullmatch(r"https?://[^/?#@\s]+(/[^?#\s]*)?", self.siteurl) and not re.search(r"/\.{1,2}(/|$)", self.siteurl)):
            raise ConfigError(f"siteurl {self.siteurl!r} is not a plain http(s) address")
        for name in ("content_dir", "output_dir", "template", "asset_dir", "rag_dir", "project_root"):
            path = getattr(self, name)
            if not path:
                raise ConfigError(f"{name} is empty")
            if not absolute and (os.path.isabs(path) or os.path.normpath(path).split(os.sep)[0] == ".."):
                raise ConfigError(f"{name} {path!r} is not a local path")
        self._isolated()
        return self

    def _isolated(self) -> None:
        """The output, which a build replaces, neither holds nor lies in an input. The folder of bundles may
        lie in the output; a folder that is the project root itself is only compared."""
        real = lambda p: os.path.realpath(os.path.abspath(p))
        inside = lambda base, p: p != base and os.path.commonpath([base, p]) == base
        out, root = real(self.output_dir), real(self.project_root)
        if out == root or inside(out, root):
            raise ConfigError("the output holds the project root")
        for name, path in (("content_dir", self.content_dir), ("asset_dir", self.asset_dir), ("template", os.path.dirname(self.template) or "."), ("rag_dir", self.rag_dir)):
            p = real(path)
            if p == root:
                continue
            if p == out or inside(out, p) and name != "rag_dir":
                raise ConfigError(f"{name} lies in the output")
            if inside(p, out):
                raise ConfigError(f"the output lies in {name}")


def load(path: str) -> Config:
    """A missing file means defaults; a broken one is an error, never part of the defaults."""
    import yaml

    if not os.path.exists(path):
        return Config()
    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{path}: not a mapping")
    kinds = {f.name: type(f.default) for f in fields(Config)}
    raw.setdefault("siteurl", raw.pop("site_url", ""))
    for name, value in raw.items():
        if name in kinds and type(value) is not kinds[name]:
            raise ConfigError(f"{path}: {name} is not a {kinds[name].__name__}")
    return Config(**{k: v for k, v in raw.items() if k in kinds})
