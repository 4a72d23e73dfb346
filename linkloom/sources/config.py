"""Configurations and manifests. They are few and small, so the driver reads them; what they list becomes tables."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Folders that are never entered.
SKIPPED = frozenset("node_modules dist build .git .claude .codex .next .turbo coverage .cache".split())
CONFIG = re.compile(r"^tsconfig(\.[^/]+)?\.json$")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
LOCKFILES = {"pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm", "bun.lockb": "bun", "bun.lock": "bun"}


def relaxed_json(text: str):
    """JSON with comments and trailing commas."""
    out, k = [], 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|//[^\n]*|/\*.*?\*/", text, re.S):
        out.append(text[k : m.start()])
        out.append(m[0] if m[0].startswith('"') else " ")
        k = m.end()
    out.append(text[k:])
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)) or "{}")


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return relaxed_json(f.read())


def walk(root: str, ignored: frozenset[str] = frozenset()) -> Iterator[tuple[str, list[str]]]:
    """(folder, file names), breadth first; skips fixed names, ignored folders and nested checkouts."""
    queue = [root]
    for folder in queue:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        yield folder, [e.name for e in entries if e.is_file()]
        for e in entries:
            if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED and e.path not in ignored and not os.path.exists(f"{e.path}/.git"):
                queue.append(e.path)


@dataclass
class Config:
    path: str
    options: dict = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    files: list[str] | None = None
    references: list[str] = field(default_factory=list)

    @property
    def aliases(self) -> list[tuple[str, str]]:
        """(alias, target) in their order; the first target of each counts."""
        base = os.path.normpath(os.path.join(os.path.dirname(self.path), self.options.get("baseUrl", ".")))
        return [(a, os.path.normpath(os.path.join(base, t[0]))) for a, t in self.options.get("paths", {}).items() if t]

    @property
    def solution(self) -> bool:
        """It only refers to others."""
        return bool(self.references) and self.files == []


def load_config(path: str, seen: tuple[str, ...] = ()) -> Config:
    """Own entries win over those of the configurations it extends; a cycle of these ends where it began."""
    raw = read_json(path)
    out = Config(path, include=["**/*"], exclude=["node_modules"])
    bases = raw.get("extends", [])
    for base in [bases] if isinstance(bases, str) else bases:
        at = os.path.normpath(os.path.join(os.path.dirname(path), base))
        at = next((x for x in (at, at + ".json", f"{at}/tsconfig.json") if os.path.isfile(x)), None)
        if at and at not in (*seen, path):
            up = load_config(at, (*seen, path))
            if "paths" in up.options and "baseUrl" not in up.options:
                up.options["baseUrl"] = os.path.dirname(up.path)
            out.options |= up.options
            out.include, out.exclude, out.files = up.include, up.exclude, up.files
    own = dict(raw.get("compilerOptions", {}))
    if "baseUrl" in own:
        own["baseUrl"] = os.path.normpath(os.path.join(os.path.dirname(path), own["baseUrl"]))
    elif "paths" in own:
        own["baseUrl"] = os.path.dirname(path)
    out.options |= own
    out.include, out.exclude, out.files = raw.get("include", out.include), raw.get("exclude", out.exclude), raw.get("files", out.files)
    out.references = [os.path.normpath(os.path.join(os.path.dirname(path), r["path"])) for r in raw.get("references", [])]
    return out


def glob_regex(glob: str) -> re.Pattern:
    if not re.search(r"[*?]", glob):
        return re.compile("^" + re.escape(glob.rstrip("/")) + "(/.*)?$")
    out = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(glob.rstrip("/")))
    out = out.replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(f"^{out}(/.*)?$" if not re.search(r"\.[A-Za-z]+$", glob) else f"^{out}$")


def config_files(config: Config, extensions=(".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".vue")) -> list[str]:
    home = os.path.dirname(config.path)
    named = [os.path.normpath(os.path.join(home, f)) for f in config.files or []]
    if config.files is not None and config.include == ["**/*"]:
        return named
    take, leave = [glob_regex(g.removeprefix("./")) for g in config.include], [glob_regex(g.removeprefix("./")) for g in config.exclude]
    if not config.options.get("allowJs"):
        extensions = tuple(e for e in extensions if "js" not in e)
    for folder, names in walk(home):
        for n in names:
            path = os.path.join(folder, n)
            short = os.path.relpath(path, home)
            if n.endswith(extensions) and any(p.match(short) for p in take) and not any(p.match(short) for p in leave):
                named.append(path)
    return list(dict.fromkeys(named))


def discover(root: str) -> list[Config]:
    return [load_config(os.path.join(folder, n)) for folder, names in walk(root) for n in names if CONFIG.match(n)]


def config_tables(spark: SparkSession, configs: list[Config]) -> dict[str, DataFrame]:
    """configs(config, seq), listed(config, file), aliases(config, alias, target, pos)."""
    return {
        "configs": spark.createDataFrame([(c.path, k) for k, c in enumerate(configs)], "config string, seq bigint"),
        "listed": spark.createDataFrame([(c.path, f) for c in configs for f in config_files(c)], "config string, file string"),
        "aliases": spark.createDataFrame([(c.path, a, t, k) for c in configs for k, (a, t) in enumerate(c.aliases)], "config string, alias string, target string, pos int"),
    }


# -- workspaces


def workspace_root(start: str) -> tuple[str, list[str]] | None:
    """(root, globs of packages), upward from a folder."""
    folder = os.path.abspath(start)
    while True:
        pnpm = f"{folder}/pnpm-workspace.yaml"
        if os.path.isfile(pnpm):
            with open(pnpm) as f:
                return folder, re.findall(r"^\s*-\s*[\"']?([^\"'\n#]+?)[\"']?\s*$", f.read(), re.M)
        if os.path.isfile(f"{folder}/package.json") and (w := read_json(f"{folder}/package.json").get("workspaces")):
            return folder, w.get("packages", []) if isinstance(w, dict) else w
        up = os.path.dirname(folder)
        if up == folder:
            return None
        folder = up


def manager(root: str) -> str:
    """From packageManager, else the only lockfile, else npm; several lockfiles tell nothing."""
    manifest = f"{root}/package.json"
    named = read_json(manifest).get("packageManager", "") if os.path.isfile(manifest) else ""
    if named:
        return named.split("@")[0]
    found = {kind for f, kind in LOCKFILES.items() if os.path.isfile(f"{root}/{f}")}
    return found.pop() if len(found) == 1 else "unknown" if found else "npm"


def packages(root: str, globs: list[str]) -> list[dict]:
    """Manifests of a workspace with their folders, by name."""
    take = [glob_regex(g) for g in globs if not g.startswith("!")]
    leave = [glob_regex(g[1:]) for g in globs if g.startswith("!")]
    out = []
    for folder, names in walk(root):
        short = os.path.relpath(folder, root)
        if "package.json" in names and any(re.fullmatch(p.pattern.replace("(/.*)?$", "$"), short) for p in take) and not any(p.match(short) for p in leave):
            m = read_json(f"{folder}/package.json")
            if m.get("name"):
                out.append({"name": m["name"], "path": folder, "manifest": m})
    return sorted(out, key=lambda p: p["name"])


def expand_exports(exports, key: str = ".") -> list[tuple[str, str]]:
    """(sub-path, target) of a manifest's exports; conditions in their order, the first target of each sub-path first."""
    if isinstance(exports, str):
        return [(key, exports)]
    if isinstance(exports, list):
        return [x for e in exports for x in expand_exports(e, key)]
    if isinstance(exports, dict):
        return [x for k, v in exports.items() for x in expand_exports(v, k if k.startswith(".") else key)]
    return []


def entrypoints(manifest: dict) -> list[tuple[str, str, str]]:
    """(kind, key, target) of main, module, types, exports and bin."""
    out = [(k, ".", manifest[k]) for k in ("main", "module", "types", "typings") if isinstance(manifest.get(k), str)]
    out += [("exports", k, t) for k, t in expand_exports(manifest.get("exports"))]
    bins = manifest.get("bin")
    return out + [("bin", k, t) for k, t in ({manifest.get("name", ""): bins} if isinstance(bins, str) else bins or {}).items()]


def package_tables(spark: SparkSession, found: list[dict]) -> dict[str, DataFrame]:
    """packages(name, path), dependencies(consumer, provider, section, specifier), entrypoints(package, kind, key, target), policies(...)."""
    deps = [(p["name"], d, s, str(v)) for p in found for s in SECTIONS for d, v in (p["manifest"].get(s) or {}).items()]
    policies = [(p["name"], d, x.get("section", "dependencies"), x.get("specifier"), bool(x.get("includeClosure")), k) for p in found for k, (d, x) in enumerate((p["manifest"].get("dependencyPolicy") or {}).items())]
    return {
        "packages": spark.createDataFrame([(p["name"], p["path"]) for p in found], "name string, path string"),
        "dependencies": spark.createDataFrame(deps, "consumer string, provider string, section string, specifier string"),
        "entrypoints": spark.createDataFrame([(p["name"], *e) for p in found for e in entrypoints(p["manifest"])], "package string, kind string, key string, target string"),
        "policies": spark.createDataFrame(policies, "package string, dep string, section string, specifier string, include_closure boolean, seq bigint"),
    }


def write_manifest(manifest: dict) -> str:
    """As JSON with the dependency sections sorted by name and empty ones dropped."""
    out = {k: dict(sorted(v.items())) if k in SECTIONS else v for k, v in manifest.items() if k not in SECTIONS or v}
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def task_graph(path: str) -> list[tuple[str, str]] | None:
    """(task, what it waits for) of a build configuration; None where it isn't one."""
    try:
        raw = read_json(path)
    except (OSError, ValueError):
        return None
    tasks = raw.get("tasks", raw.get("pipeline")) if isinstance(raw, dict) else None
    if not isinstance(tasks, dict):
        return None
    return [(t, d) for t, v in tasks.items() if isinstance(v, dict) for d in v.get("dependsOn", [])]


def tool_config(start: str, name: str) -> dict:
    """The nearest configuration upward: options of all commands and of each."""
    folder = os.path.abspath(start)
    while True:
        if os.path.isfile(f"{folder}/{name}"):
            return read_json(f"{folder}/{name}")
        up = os.path.dirname(folder)
        if up == folder:
            return {}
        folder = up


def option(name: str, given: dict, command: dict, shared: dict, default=None):
    """What is given beats the command's setting, that the shared one, and that the default."""
    return next((x[name] for x in (given, command, shared) if x.get(name) is not None), default)


def ignored_by_git(root: str, paths: list[str]) -> list[str] | None:
    """The paths that git ignores, from one call; None if that can't be told."""
    try:
        done = subprocess.run(["git", "-C", root, "check-ignore", "--stdin", "-z"], input="\0".join(paths).encode(), capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [p for p in done.stdout.decode().split("\0") if p] if done.returncode in (0, 1) else None
