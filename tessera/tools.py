"""The engine's operations as named tools with JSON results, and a JSON-RPC server for them on standard streams."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame

from tessera.engine import Engine

PROTOCOL = "2024-11-05"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


class Tools:
    """Reads raise their errors; what changes or inspects the index answers {"ok": false, "error": ...} instead.

    Changing the index through a tool needs allow_reindex and not read_only in the settings.
    """

    def __init__(self, engine: Engine):
        self.engine = engine

    def _guarded(self, f: Callable[[], dict]) -> dict:
        try:
            return f()
        except Exception as e:  # noqa: BLE001  the caller gets every error as a result
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}

    def _update(self, **options) -> dict:
        s = self.engine.settings
        if s.read_only or not s.allow_reindex:
            return {"ok": False, "error": "changing the index is not allowed by the settings"}
        return self._guarded(lambda: self.engine.reindex(**options))

    def code_search(self, query: str, top_k: int | None = None, mode: str = "auto", path_prefix: str | None = None, include_text: bool = False) -> dict:
        return {"results": self.engine.search(query, top_k=top_k, mode=mode, prefix=path_prefix, include_text=include_text)}

    def document_search(self, query: str, top_k: int | None = None, mode: str = "hybrid", path_prefix: str | None = None, include_text: bool = False) -> dict:
        return {"results": _rows(self.engine.document_search(query, top_k, mode, path_prefix, include_text))}

    def document_outline(self, path_or_doc_id: str, limit: int = 500) -> dict:
        return {"outline": self.engine.document_outline(path_or_doc_id, limit)}

    def document_fetch(self, resource_uri: str | None = None, chunk_id: str | None = None, context_chunks: int = 1) -> dict:
        return self.engine.fetch(resource_uri or f"rag://#chunk={chunk_id}", context_chunks)

    def code_find_symbol(self, name: str, kind: str | None = None, path_prefix: str | None = None, limit: int | None = None) -> dict:
        return {"symbols": _rows(self.engine.find_symbol(name, kind, path_prefix, limit))}

    def code_references(self, symbol: str, path_prefix: str | None = None, limit: int | None = None) -> dict:
        found = _rows(self.engine.references(symbol, path_prefix, limit))
        return {"references": found} if found else {"references": [], "mentions": _rows(self.engine.mentions(symbol, path_prefix, limit))}

    def code_neighbors(self, symbol: str, limit: int = 40) -> dict:
        return {k: _rows(v) for k, v in self.engine.neighbors(symbol, limit).items()}

    def code_repo_map(self, path_prefix: str | None = None, limit: int | None = None) -> dict:
        return {"files": _rows(self.engine.repo_map(path_prefix, limit))}

    def code_fetch(self, resource_uri: str | None = None, chunk_id: str | None = None, symbol_id: str | None = None) -> dict:
        return self.engine.fetch(resource_uri or (f"symbol://{symbol_id}" if symbol_id else f"rag://#chunk={chunk_id}"))

    def document_update_index(self, paths: list[str]) -> dict:
        return self._update(paths=paths)

    def code_update_index(self, paths: list[str]) -> dict:
        return self._update(paths=paths)

    rag_search, rag_fetch = code_search, code_fetch

    def rag_status(self) -> dict:
        return self._guarded(self.engine.status)

    def rag_doctor(self) -> dict:
        return self._guarded(self.engine.doctor)

    def rag_warmup(self) -> dict:
        """Opens the current snapshot and reads its counts."""
        return self._guarded(lambda: {"ok": True, "version": self.engine.store.check(), "chunks": self.engine._tables()["chunks"].count()})

    def rag_reindex(self, force: bool = False, paths: list[str] | None = None) -> dict:
        return self._update(force=force, paths=paths)

    def names(self) -> list[str]:
        return sorted(n for n, f in inspect.getmembers(type(self), inspect.isfunction) if not n.startswith("_") and n not in ("names", "describe", "call"))

    def describe(self) -> list[dict]:
        kinds = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}
        out = []
        for name in self.names():
            params = list(inspect.signature(getattr(self, name)).parameters.values())
            props = {p.name: {"type": kinds[str(p.annotation).split(" |")[0]]} for p in params}
            out.append({"name": name, "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in params if p.default is p.empty]}})
        return out

    def call(self, name: str, arguments: dict) -> dict:
        if name not in self.names():
            raise KeyError(f"no tool {name}")
        return getattr(self, name)(**arguments)


def serve(engine: Engine, requests: IO[str], answers: IO[str]) -> int:
    """One JSON-RPC message a line, until the input ends."""
    tools = Tools(engine)
    for line in requests:
        if not line.strip():
            continue
        message = json.loads(line)
        method, params = message.get("method"), message.get("params") or {}
        if "id" not in message:
            continue  # a notification
        try:
            if method == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}
            elif method == "tools/list":
                result = {"tools": tools.describe()}
            elif method == "tools/call":
                result = {"content": [{"type": "text", "text": json.dumps(tools.call(params["name"], params.get("arguments") or {}), default=str, ensure_ascii=False)}]}
            else:
                raise KeyError(f"no method {method}")
            answer = {"result": result}
        except Exception as e:  # noqa: BLE001  told to the caller
            answer = {"error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:500]}}
        answers.write(json.dumps({"jsonrpc": "2.0", "id": message["id"]} | answer, ensure_ascii=False) + "\n")
        answers.flush()
    return 0
