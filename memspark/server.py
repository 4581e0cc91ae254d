"""A tool server over standard input and output: one JSON-RPC request a line, one answer a line.

    python -m memspark.server --path /data/memory --agent coder
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from typing import TextIO

from .adapters import ToolServer
from .schemas import MEMORY_TYPES, SCOPES

#: Fixed value: the revision of the protocol that is spoken.
PROTOCOL = "2024-11-05"


def _field(kind: str, about: str, **more) -> dict:
    return {"type": kind, "description": about, **more}


_AGENT = _field("string", "the agent whose memory it is")
_TYPES = _field("array", "the stores asked", items={"type": "string", "enum": list(MEMORY_TYPES)})
#: Arguments by tool; those named in REQUIRED must be given.
ARGUMENTS = {
    "remember": {"content": _field("string", "what is to be found again"), "agent_id": _AGENT, "importance": _field("number", "0 to 1", minimum=0, maximum=1), "scope": _field("string", "who may see it", enum=list(SCOPES)), "metadata": _field("object", "kept beside the text")},
    "recall": {"query": _field("string", "what is looked for"), "agent_id": _AGENT, "token_budget": _field("integer", "tokens of the answer at most", minimum=1), "memory_types": _TYPES, "max_results": _field("integer", "episodic rows considered", minimum=1)},
    "learn": {"subject": _field("string", "whom the fact is about"), "predicate": _field("string", "the relation"), "object": _field("string", "what it holds of"), "agent_id": _AGENT, "confidence": _field("number", "0 to 1", minimum=0, maximum=1)},
    "learn_procedure": {"name": _field("string", "a short name"), "description": _field("string", "what it is for"), "steps": _field("array", "in order", items={"type": "object", "properties": {"action": {"type": "string"}, "tool": {"type": "string"}}, "required": ["action"]}), "agent_id": _AGENT, "applicable_contexts": _field("array", "where it helps", items={"type": "string"})},
    "get_context": {"task_hint": _field("string", "the task at hand"), "agent_id": _AGENT, "level": _field("integer", "tiers, 0 to 3", minimum=0, maximum=3), "token_budget": _field("integer", "tokens of all tiers", minimum=1), "identity": _field("string", "who the agent is")},
    "forget": {"id": _field("string", "the row"), "memory_type": _field("string", "its store", enum=list(MEMORY_TYPES))},
    "query_knowledge": {"entity": _field("string", "where to begin"), "depth": _field("integer", "hops", minimum=0)},
    "stats": {"agent_id": _AGENT},
}
REQUIRED = {"remember": ["content"], "recall": ["query"], "learn": ["subject", "predicate", "object"], "learn_procedure": ["name", "steps"], "forget": ["id"], "query_knowledge": ["entity"]}
ABOUT = {
    "remember": "Keep an event or observation.", "recall": "Find what was kept, within a token budget.", "learn": "State a fact; an older one it contradicts ends.", "learn_procedure": "Keep a way of doing something, step by step.",
    "get_context": "What to know before a task, in tiers.", "forget": "Delete one row.", "query_knowledge": "Facts around an entity.", "stats": "Rows of each store.",
}


def specs() -> list[dict]:
    return [{"name": n, "description": ABOUT[n], "inputSchema": {"type": "object", "properties": a, "required": REQUIRED.get(n, [])}} for n, a in ARGUMENTS.items()]


def answer(server: ToolServer, request: dict) -> dict | None:
    """The reply to a request; none to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return {**reply, "result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "memspark", "version": "1"}}}
    if method == "ping":
        return {**reply, "result": {}}
    if method == "tools/list":
        return {**reply, "result": {"tools": specs()}}
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments") or {}
        missing = [k for k in REQUIRED.get(name, []) if k not in arguments]
        text = json.dumps({"error": f"missing arguments: {', '.join(missing)}"}) if missing else server.dispatch(name, arguments)
        return {**reply, "result": {"content": [{"type": "text", "text": text}], "isError": "error" in json.loads(text)}}
    return {**reply, "error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(server: ToolServer, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if line.strip():
            try:
                reply = answer(server, json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--path", required=True)
    p.add_argument("--agent", default="default")
    p.add_argument("--master")
    a = p.parse_args()
    from .api import MemoryDB
    from .session import get_session

    db = MemoryDB(get_session(master=a.master), a.path, a.agent)
    try:
        serve(ToolServer(db), sys.stdin, sys.stdout)
    finally:
        db.close()


if __name__ == "__main__":
    main()
