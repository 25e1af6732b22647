"""Configuration: defaults, environment placeholders, deep merge."""

from __future__ import annotations

import copy
import os
import re

DEFAULTS = {
    "indexing": {"chunk_size": {"min_tokens": 400, "max_tokens": 800}, "overlap": 0.1, "file_parallelism": 2, "segment": False},
    "embedding": {"batch_size": 24, "dimension": 64},
    "summary": {"mode": "batch"},
    "search": {"default_top_k": 10, "fusion": {"method": "rrf", "k": 60}, "file_boost": 0.35},
}
LIMITS = (("indexing.file_parallelism", 1, 8), ("embedding.batch_size", 1, 64), ("search.default_top_k", 1, None), ("indexing.chunk_size.min_tokens", 1, None), ("indexing.chunk_size.max_tokens", 1, None))


def merge(base: dict, patch: dict) -> dict:
    """A copy of base with the patch: None deletes, dictionaries go deeper, everything else replaces."""
    out = copy.deepcopy(base)
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        elif isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def substitute(value, env: dict[str, str] | None = None):
    """``${NAME}`` in strings, however deep; an unknown name is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def name(m):
        if m[1] not in env:
            raise KeyError(f"the environment has no {m[1]}")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", name, value)


def resolve(own: dict | None = None, env: dict[str, str] | None = None) -> dict:
    """Defaults under the given settings, checked."""
    out = merge(DEFAULTS, substitute(own or {}, env))
    for path, least, most in LIMITS:
        at = out
        for part in path.split("."):
            at = at[part]
        if not isinstance(at, int) or isinstance(at, bool) or at < least or (most is not None and at > most):
            raise ValueError(f"{path} must be a whole number from {least}" + (f" to {most}" if most else ""))
    sizes = out["indexing"]["chunk_size"]
    if sizes["min_tokens"] > sizes["max_tokens"]:
        raise ValueError("min_tokens must not be over max_tokens")
    if out["search"]["fusion"]["method"] != "rrf":
        raise ValueError("the fusion method must be rrf")
    if out["summary"]["mode"] not in ("batch", "skip"):
        raise ValueError("the summary mode must be batch or skip")
    return out


def plugin_options(raw: dict | None) -> dict:
    """Converters' options: either spelling of a name is taken, numbers have floors, what is not usable gets the default."""
    raw = raw if isinstance(raw, dict) else {}

    def first(source: dict, names: tuple, ok) -> object | None:
        return next((source[n] for n in names if n in source and ok(source[n])), None)

    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")
    text = lambda v: isinstance(v, str) and v.strip() != ""
    record = lambda v: isinstance(v, dict)
    out: dict = {}
    pages = first(raw, ("text_extraction", "textExtraction"), record)
    if pages is not None:
        out["text_extraction"] = {k: v for k, v in pages.items() if k not in ("min_text_chars_per_page", "minTextCharsPerPage")}
        least = first(pages, ("minTextCharsPerPage", "min_text_chars_per_page"), number)
        if least is not None:
            out["text_extraction"]["min_text_chars_per_page"] = max(0, int(least // 1))
    layout = first(raw, ("layout", "minerU"), record)
    if layout is not None:
        url = first(layout, ("serverUrl", "server_url", "apiHost", "api_host"), text)
        counts = {name: first(layout, names, lambda v: number(v) and v >= 1) or default for name, names, default in (("max_concurrency", ("max_concurrency", "maxConcurrency"), 4), ("page_concurrency", ("page_concurrency", "pageConcurrency"), 2))}
        image = first(layout, ("crop_image_format", "cropImageFormat"), lambda v: v in ("jpeg", "png")) or "png"
        out["layout"] = ({"server_url": url} if url else {}) | counts | {"crop_image_format": image}
    converter = first(raw, ("converter",), record)
    return out | ({"converter": converter} if converter is not None else {})


def project_path(path: str, bases: list[str], exists=os.path.isdir) -> str:
    """An absolute path: itself, or the path below the first of the bases where it exists, else below the first base."""
    if os.path.isabs(path):
        return os.path.normpath(path)
    tried = [os.path.normpath(os.path.join(b, path)) for b in bases if b]
    return next((p for p in tried if exists(p)), tried[0] if tried else os.path.abspath(path))


def archive_path(root: str, dir_path: str, folder: str = ".index") -> str:
    """Where a directory's archive lies below an index's root."""
    inner = "" if dir_path in ("", ".") else dir_path.strip("/") + "/"
    return f"{root.rstrip('/')}/{inner}{folder}"
