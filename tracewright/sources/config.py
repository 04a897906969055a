"""Settings of a pipeline run; plain dictionaries on the driver."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from functools import reduce


@dataclass(frozen=True)
class Mode:
    """A way to generate descriptions (Q19: commits are always in)."""

    name: str
    slug: str
    use_cmg: bool = True
    include_file_summaries: bool = True
    description: str = ""

    @classmethod
    def of(cls, given: Mapping) -> Mode | None:
        """A mode out of settings; None without a name."""
        name = str(given.get("name") or "").strip()
        flags = {k: bool(given[k]) for k in ("use_cmg", "include_file_summaries") if k in given}
        return cls(name, given.get("slug") or slugify(name), description=given.get("description") or "", **flags) if name else None


#: The modes where none is set.
DEFAULT_MODES = (Mode("raw", "raw", False, False), Mode("cmg_only", "cmg-only", True, False), Mode("file_summaries_only", "file-summaries-only", False, True), Mode("full", "full", True, True))


def deep_merge(*layers: Mapping) -> dict:
    """Mappings are merged key by key, of anything else the later layer's value stands."""

    def both(left: object, right: object) -> object:
        if not (isinstance(left, Mapping) and isinstance(right, Mapping)):
            return copy.deepcopy(right)
        return {k: both(left[k], right[k]) if k in left and k in right else copy.deepcopy((right if k in right else left)[k]) for k in dict.fromkeys([*left, *right])}

    return reduce(both, layers, {})


def slugify(text: str) -> str:
    """T8 on the driver."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "mode"


def normalize_modes(modes: Iterable[Mapping]) -> list[dict]:
    """Nameless modes go, of equal slugs the first stays; the default modes if none is left."""
    named = [m for given in modes if (m := Mode.of(given)) is not None]
    by_slug = {m.slug: m for m in reversed(named)}  # the first of a slug is set last
    return [asdict(m) for m in named if by_slug[m.slug] is m] or [asdict(m) for m in DEFAULT_MODES]


def active_modes(modes: list[dict], wanted: Iterable[str]) -> list[dict]:
    """The wanted modes by name or slug, whatever case and blanks around them; all if none is wanted or known."""
    names = {str(w).strip().lower() for w in wanted} - {""}
    return [m for m in modes if names & {m["name"].lower(), m["slug"].lower()}] or modes


def load_config(path: str | None, defaults: Mapping) -> dict:
    """YAML over defaults, where a YAML reader is installed; else JSON."""
    if path is None:
        return deep_merge(defaults, {})
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ModuleNotFoundError:
        import json

        given = json.loads(text)
    return deep_merge(defaults, given)
