"""Installed providers: a JSON file that is changed under a lock and replaced whole."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import tempfile
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from recordmill.functions.builtins import BUILTINS
from recordmill.tools.contract import NAME, ToolContract, contract_of
from recordmill.tools.provider import Descriptor, ProviderError, check


@dataclass(frozen=True)
class Installed:
    provider_id: str
    alias: str
    digest: str
    path: str
    editable: bool
    tools: tuple[ToolContract, ...]

    def descriptor(self, tool_name: str) -> Descriptor:
        try:
            source = Path(self.path).read_bytes()
        except OSError as e:
            raise ProviderError(f"the file of provider {self.provider_id!r} can't be read: {e}") from None
        return Descriptor(self.provider_id, tool_name, self.digest, source)


@dataclass(frozen=True)
class Resolved:
    """A name in an expression: its contract, and the function (built in) or descriptor (provider)."""

    provider_id: str
    contract: ToolContract
    function: Callable | None = None
    installed: Installed | None = None
    pinned: Descriptor | None = None

    @property
    def descriptor(self) -> Descriptor | None:
        """Where workers get the tool from; a provider's file is read only now, when the tool is asked for."""
        return self.pinned or (self.installed.descriptor(self.contract.name) if self.installed else None)


def default_home() -> Path:
    return Path(os.environ.get("RECORDMILL_HOME") or Path.home() / ".local/share/recordmill")


class Registry:
    def __init__(self, home: str | Path | None = None) -> None:
        self.home = Path(home or default_home())
        self.file = self.home / "registry.json"

    @contextlib.contextmanager
    def _locked(self) -> Iterator[dict[str, Any]]:
        """The entries, written back if the block ends well."""
        self.home.mkdir(parents=True, exist_ok=True)
        with open(self.home / "lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            entries = self._read()
            yield entries
            fd, name = tempfile.mkstemp(dir=self.home)
            with os.fdopen(fd, "w") as f:
                json.dump({"providers": entries}, f, indent=1)
            os.replace(name, self.file)

    def _read(self) -> dict[str, Any]:
        if not self.file.exists():
            return {}
        try:
            return dict(json.loads(self.file.read_text())["providers"])
        except (ValueError, KeyError, TypeError):
            warnings.warn(f"{self.file} can't be read and counts as empty", stacklevel=2)
            return {}

    def providers(self) -> list[Installed]:
        return [
            Installed(k, v["alias"], v["digest"], v["path"], v["editable"], tuple(ToolContract.from_json(t) for t in v["tools"])) for k, v in sorted(self._read().items())
        ]

    def install(self, path: str | Path, *, provider_id: str | None = None, alias: str | None = None, editable: bool = False, force: bool = False, confirm: Callable[[str], bool] | None = None) -> Installed:
        """Checks a file and enters it; a copy unless ``editable``. ``confirm`` is asked last."""
        path = Path(path).absolute()
        provider_id = provider_id or path.stem
        alias = alias or provider_id
        for n in (provider_id, alias):
            if not NAME.match(n):
                raise ProviderError(f"not a provider name: {n!r}")
        source, tools = check(path)
        digest = hashlib.sha256(source).hexdigest()
        if confirm and not confirm(f"install {provider_id} ({', '.join(t.name for t in tools)}) with digest {digest[:12]}? Its code will run with your rights."):
            raise ProviderError("not confirmed")
        place, was_there, before = path, True, None
        try:
            with self._locked() as entries:
                before = entries.get(provider_id)
                if before and not force:
                    raise ProviderError(f"provider {provider_id!r} is installed already")
                if any(k != provider_id and v["alias"] == alias for k, v in entries.items()):
                    raise ProviderError(f"alias {alias!r} is taken")
                if not editable:
                    place = self.home / "providers" / provider_id / f"{digest[:16]}.py"
                    was_there = place.exists()
                    place.parent.mkdir(parents=True, exist_ok=True)
                    fd, name = tempfile.mkstemp(dir=place.parent)
                    with os.fdopen(fd, "wb") as f:
                        f.write(source)
                    os.replace(name, place)
                entries[provider_id] = {"alias": alias, "digest": digest, "path": str(place), "editable": editable, "tools": [t.to_json() for t in tools]}
        except BaseException:  # the copy that was there before stays, and so does its entry
            if not was_there:
                place.unlink(missing_ok=True)
            raise
        if before and not before["editable"] and before["path"] != str(place):
            Path(before["path"]).unlink(missing_ok=True)
        return next(p for p in self.providers() if p.provider_id == provider_id)

    def remove(self, provider_id: str) -> None:
        with self._locked() as entries:
            if provider_id not in entries:
                raise ProviderError(f"provider {provider_id!r} isn't installed")
            if not entries.pop(provider_id)["editable"]:
                shutil.rmtree(self.home / "providers" / provider_id, ignore_errors=True)

    def names(self) -> dict[str, Resolved]:
        """Every name an expression may use: built-ins, ``alias.tool``, and ``tool`` where one provider has it."""
        out = {f"{p.alias}.{t.name}": (p, t) for p in self.providers() for t in p.tools}
        plain: dict[str, list[tuple[Installed, ToolContract]]] = {}
        for p, t in out.values():
            plain.setdefault(t.name, []).append((p, t))
        out |= {n: x[0] for n, x in plain.items() if len(x) == 1 and n not in BUILTINS}
        return {n: Resolved(p.provider_id, t, installed=p) for n, (p, t) in out.items()} | {n: Resolved("builtin", contract_of(f), function=f) for n, f in BUILTINS.items()}
