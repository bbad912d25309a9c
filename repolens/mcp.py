"""The tools over the Model Context Protocol: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json

from repolens.api import TOOLS, Lens

#: Versions of the protocol that are spoken here, the newest first (fixed values).
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")

_TEXT, _WHOLE = {"type": "string"}, {"type": "integer", "minimum": 0}


def _with(schema: dict, description: str, default: object = None) -> dict:
    return schema | {"description": description} | ({} if default is None else {"default": default})


#: For each tool what it does, its arguments, and those that must be there.
SCHEMAS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "add_code_to_graph": (
        "Index a directory, or bring its index up to date.",
        {"path": _with(_TEXT, "The directory."), "is_dependency": _with({"type": "boolean"}, "Leave out sources and variables.", False)}, ("path",),
    ),
    "find_code": ("Find functions, classes and variables by words of their names.", {"query": _with(_TEXT, "Words, or a part of a name."), "limit": _with(_WHOLE, "Most results.", 20)}, ("query",)),
    "semantic_search": ("Find code by what its description means.", {"query": _with(_TEXT, "What to look for."), "limit": _with(_WHOLE, "Most results.", 10)}, ("query",)),
    "analyze_code_relationships": (
        "Callers, callees, call chains, hierarchies, dead code, importers, dependencies or complexity.",
        {
            "query_type": _with({"type": "string", "enum": ["find_callers", "find_callees", "class_hierarchy", "call_chain", "dead_code", "find_importers", "module_deps", "find_complexity"]}, "The question."),
            "target": _with(_TEXT, "The name that it is about; not for dead_code."), "limit": _with(_WHOLE, "Most results.", 20), "depth": _with(_WHOLE, "Most steps of a chain.", 5),
        }, ("query_type",),
    ),
    "execute_cypher_query": ("Run a reading graph query.", {"query": _with(_TEXT, "A query of the Cypher subset."), "params": _with({"type": "object"}, "Values of $names.")}, ("query",)),
    "watch_directory": ("Keep the index of a directory current.", {"path": _with(_TEXT, "The directory.")}, ("path",)),
    "unwatch_directory": ("Stop watching a directory.", {"path": _with(_TEXT, "The directory.")}, ("path",)),
    "list_watched_paths": ("The watched directories.", {}, ()),
    "calculate_cyclomatic_complexity": ("The complexity of functions of a name.", {"function_name": _with(_TEXT, "The exact name."), "path": _with(_TEXT, "Only in this file.")}, ("function_name",)),
    "find_most_complex_functions": ("The functions with the highest complexity.", {"limit": _with(_WHOLE, "Most results.", 10), "repo_path": _with(_TEXT, "Only in this repository.")}, ()),
    "find_dead_code": ("Functions that nothing calls.", {"limit": _with(_WHOLE, "Most results.", 50), "repo_path": _with(_TEXT, "Only in this repository.")}, ()),
    "ask_codebase": (
        "Answer a question from the indexed code, with sources.",
        {"question": _with(_TEXT, "The question."), "limit": _with(_WHOLE, "Most sources.", 12), "repo_path": _with(_TEXT, "Only this repository.")}, ("question",),
    ),
    "list_indexed_repositories": ("The indexed repositories.", {}, ()),
    "delete_repository": ("Remove a repository, or all of them, from the index.", {"path": _with(_TEXT, "The repository."), "all": _with({"type": "boolean"}, "Remove every one.", False)}, ()),
    "check_job_status": ("The state of one indexing job, or of all.", {"job_id": _with(_TEXT, "The job.")}, ()),
}


def tools() -> list[dict]:
    """The tools as a client sees them."""
    out = []
    for name in TOOLS:
        description, properties, required = SCHEMAS[name]
        schema = {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": list(required)} if required else {})
        out.append({"name": name, "description": description, "inputSchema": schema})
    return out


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def _checked(name: str, arguments: object) -> dict:
    """The arguments of a call, if the tool is known and they fit its schema as far as names go."""
    if name not in SCHEMAS:
        raise RpcError(-32602, f"unknown tool: {name}")
    arguments = {} if arguments is None else arguments
    _, properties, required = SCHEMAS[name]
    if not isinstance(arguments, dict) or set(arguments) - set(properties):
        raise RpcError(-32602, f"unknown arguments of {name}")
    if missing := [k for k in required if k not in arguments]:
        raise RpcError(-32602, f"{name} needs {', '.join(missing)}")
    return arguments


def _result(graph: Lens, method: str, params: dict) -> dict:
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "repolens", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tools()}
    if method == "tools/call":
        text = graph.call(params.get("name", ""), _checked(params.get("name", ""), params.get("arguments")))
        made = json.loads(text)
        return {"content": [{"type": "text", "text": text}], "isError": isinstance(made, dict) and set(made) == {"error"}}
    raise RpcError(-32601, f"unknown method: {method}")


def handle(graph: Lens, message: object) -> dict | None:
    """The answer to one message; None for a notification, which has no id."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise RpcError(-32602, "params is an object")
        return head | {"result": _result(graph, message["method"], params)}
    except RpcError as e:
        return head | {"error": {"code": e.code, "message": str(e)}}
