"""The service's operations by name and what arguments each takes."""

from __future__ import annotations

#: operation: argument -> (type, whether it must be given, values it may have)
OPERATIONS: dict[str, dict[str, tuple[type | tuple[type, ...], bool, tuple | None]]] = {
    "ingest_triples": {"triples": (list, True, None), "namespace": (str, False, None)},
    "ingest_file": {"path": (str, True, None), "namespace": (str, False, None)},
    "ingest_text": {"uri": (str, True, None), "content": (str, True, None), "namespace": (str, False, None)},
    "ingest_url": {"url": (str, True, None), "namespace": (str, False, None)},
    "sparql_query": {"query": (str, True, None), "namespace": (str, False, None)},
    "hybrid_search": {"query": (str, True, None), "namespace": (str, False, None), "vector_k": (int, False, None), "graph_depth": (int, False, None), "limit": (int, False, None)},
    "apply_reasoning": {"namespace": (str, False, None), "strategy": (str, False, ("rdfs", "owlrl", "none")), "materialize": (bool, False, None)},
    "get_neighbors": {"uri": (str, True, None), "namespace": (str, False, None), "direction": (str, False, ("outgoing", "incoming", "both"))},
    "list_triples": {"namespace": (str, False, None), "limit": (int, False, None)},
    "delete_namespace": {"namespace": (str, True, None)},
    "compact_vectors": {"namespace": (str, False, None)},
    "vector_stats": {"namespace": (str, False, None)},
    "disambiguate": {"namespace": (str, False, None), "threshold": ((int, float), False, None)},
    "get_node_degree": {"uri": (str, True, None), "namespace": (str, False, None)},
    "install_ontology": {"url": (str, True, None), "name": (str, True, None), "namespace": (str, False, None)},
    "list_scenarios": {},
    "install_scenario": {"name": (str, True, None), "namespace": (str, False, None)},
}
INVALID_PARAMS = -32602
METHOD_NOT_FOUND = -32601


class InvalidArguments(ValueError):
    def __init__(self, code: int, problems: list[str]):
        super().__init__("; ".join(problems))
        self.code, self.problems = code, problems


def problems(operation: str, arguments: dict | None) -> list[str]:
    """What is wrong with the arguments of a known operation; arguments that it does not know are let through."""
    given, out = arguments or {}, []
    if not isinstance(given, dict):
        return ["arguments must be an object"]
    for name, (kind, needed, values) in OPERATIONS[operation].items():
        if name not in given:
            if needed:
                out.append(f"{name} is missing")
            continue
        value = given[name]
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            out.append(f"{name} has the wrong type")
        elif values and value not in values:
            out.append(f"{name} must be one of {', '.join(values)}")
    if operation == "ingest_triples" and isinstance(given.get("triples"), list):
        for k, row in enumerate(given["triples"]):
            if not isinstance(row, dict) or any(not isinstance(row.get(c), str) for c in ("subject", "predicate", "object")):
                out.append(f"triples[{k}] needs texts subject, predicate and object")
    return out


def check(operation: str, arguments: dict | None) -> None:
    if operation not in OPERATIONS:
        raise InvalidArguments(METHOD_NOT_FOUND, [f"no operation {operation!r}"])
    found = problems(operation, arguments)
    if found:
        raise InvalidArguments(INVALID_PARAMS, found)
