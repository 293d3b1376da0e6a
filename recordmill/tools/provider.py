"""Providers: Python files of tools, pinned by digest, checked before they are installed, loaded in workers.

A provider's code runs with the user's rights; what protects a job is that workers run exactly the bytes
whose SHA-256 was recorded. The bytes travel with the program, so executors need no copy of the file.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
import subprocess
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from recordmill.tools.contract import NAME, ToolContract, contract_of

MAX_BYTES = 512 * 1024
IMPORT_SECONDS = 30


class ProviderError(Exception):
    """A provider that can't be trusted to be what it says."""


@dataclass(frozen=True)
class Descriptor:
    """What crosses to workers: where a tool comes from, never the function."""

    provider_id: str
    tool_name: str
    digest: str
    source: bytes


_LOADED: dict[tuple[str, str], dict[str, Callable]] = {}


def functions_of(source: bytes, provider_id: str, digest: str) -> dict[str, Callable]:
    """The tools in these bytes, after the digest is checked; run once a process."""
    if hashlib.sha256(source).hexdigest() != digest:
        raise ProviderError(f"provider {provider_id!r} isn't the file that was installed: the digest differs")
    if (provider_id, digest) not in _LOADED:
        space: dict[str, Any] = {"__name__": f"recordmill_provider_{provider_id}", "__file__": f"<provider {provider_id}>"}
        exec(compile(source, space["__file__"], "exec"), space)  # noqa: S102
        _LOADED[provider_id, digest] = {contract_of(f).name: f for f in space.values() if callable(f) and hasattr(f, "__tool_contract__")}
    return _LOADED[provider_id, digest]


def load(d: Descriptor) -> Callable:
    found = functions_of(d.source, d.provider_id, d.digest)
    if d.tool_name not in found:
        raise ProviderError(f"provider {d.provider_id!r} has no tool {d.tool_name!r}")
    return found[d.tool_name]


def check_statically(path: str | Path) -> tuple[bytes, list[str]]:
    """The bytes of a provider file and the names its decorators declare, without running it."""
    path = Path(path)
    if not path.is_file() or path.is_symlink():
        raise ProviderError(f"{path} isn't a regular file")
    if path.stat().st_size > MAX_BYTES:
        raise ProviderError(f"{path} is larger than {MAX_BYTES} bytes")
    source = path.read_bytes()
    try:
        tree = ast.parse(source.decode("utf-8"))
    except (UnicodeDecodeError, SyntaxError) as e:
        raise ProviderError(f"{path} isn't UTF-8 Python: {e}") from None
    names = []
    for f in (n for n in tree.body if isinstance(n, ast.FunctionDef)):
        for d in f.decorator_list:
            called = d.func if isinstance(d, ast.Call) else d
            if (called.attr if isinstance(called, ast.Attribute) else getattr(called, "id", "")) == "tool":
                given = [k.value for k in getattr(d, "keywords", []) if k.arg == "name"] + list(getattr(d, "args", []))[:1]
                names.append(given[0].value if given and isinstance(given[0], ast.Constant) else f.name)
    if not names:
        raise ProviderError(f"{path} declares no tool")
    for n in names:
        if not isinstance(n, str) or not NAME.match(n):
            raise ProviderError(f"not a tool name: {n!r}")
    if len(set(names)) < len(names):
        raise ProviderError("a tool name is declared twice")
    return source, names


_PROBE = """
import json, sys
from recordmill.tools.provider import functions_of, run_examples
import hashlib
source = sys.stdin.buffer.read()
found = functions_of(source, "probe", hashlib.sha256(source).hexdigest())
out = [f.__tool_contract__.to_json() for f in found.values()]
print("\\n" + json.dumps({"tools": out, "failed": run_examples(found)}))
"""


_SPAWNED = """
import json, sys
from recordmill.tools.provider import Descriptor, load
import hashlib
source = sys.stdin.buffer.read()
names = json.loads(sys.argv[1])
for n in names:
    load(Descriptor("probe", n, hashlib.sha256(source).hexdigest(), source))
print("\\n" + json.dumps(names))
"""
#: What a provider's process sees of the environment.
KEPT = ("PATH", "HOME", "LANG", "LC_ALL", "TMPDIR", "LD_LIBRARY_PATH", "VIRTUAL_ENV")


def _alone(program: str, source: bytes, path: str | Path, *arguments: str) -> Any:
    """What a program says last, as JSON, in a process of its own that gets the bytes and little of the environment."""
    root = str(Path(__file__).parents[2])
    env = {k: os.environ[k] for k in KEPT if k in os.environ} | {"PYTHONPATH": os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH")))), "PYTHONDONTWRITEBYTECODE": "1"}
    try:
        done = subprocess.run([sys.executable, "-c", program, *arguments], input=source, capture_output=True, timeout=IMPORT_SECONDS, cwd=root, env=env)
    except subprocess.TimeoutExpired:
        raise ProviderError(f"{path} took more than {IMPORT_SECONDS} s to import") from None
    if done.returncode:
        raise ProviderError(f"{path} can't be imported: {done.stderr.decode(errors='replace').strip().splitlines()[-1:]}")
    return json.loads(done.stdout.decode().strip().splitlines()[-1])


def run_examples(found: dict[str, Callable]) -> list[str]:
    """What is wrong with the examples of each tool; equality tells a bool from an int."""
    wrong = []
    for name, f in found.items():
        c = contract_of(f)
        for k, e in enumerate(c.examples):
            try:
                if not c.input.matches(e.input):
                    wrong.append(f"{name}, example {k}: the input isn't {c.input}")
                    continue
                got = f(json.loads(json.dumps(e.input)), **e.arguments)
                if not c.output.matches(got):
                    wrong.append(f"{name}, example {k}: the output isn't {c.output}")
                elif json.dumps(got, sort_keys=True) != json.dumps(e.output, sort_keys=True):
                    wrong.append(f"{name}, example {k}: {got!r}, not {e.output!r}")
            except Exception as error:  # a tool may raise anything
                wrong.append(f"{name}, example {k}: {type(error).__name__}: {error}")
    return wrong


def check(path: str | Path) -> tuple[bytes, list[ToolContract]]:
    """All checks: statically, by import and examples in a process of its own, one against the other, and by loading as workers do."""
    source, declared = check_statically(path)
    said = _alone(_PROBE, source, path)
    if missing := set(declared) - {t["name"] for t in said["tools"]}:
        raise ProviderError(f"declared but not there when imported: {sorted(missing)}")
    if said["failed"]:
        raise ProviderError("; ".join(said["failed"]))
    # A worker loads tools by name from the bytes, in a fresh process: so does this.
    names = [t["name"] for t in said["tools"]]
    if _alone(_SPAWNED, source, path, json.dumps(names)) != names:
        raise ProviderError(f"{path} gives other tools when it is loaded again")
    return source, [ToolContract.from_json(t) for t in said["tools"]]
