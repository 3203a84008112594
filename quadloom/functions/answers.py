"""What tools returned, as text that an answer can be written from."""

from __future__ import annotations

import json

FACTS, WORDS, REST = 10, 200, 500


def evidence(results: list) -> str:
    """A paragraph per result that holds something: inferred facts and the rules behind them, search hits, graph rows, or the result as JSON.

    Results with an error are left out. Long ones are cut: FACTS facts, WORDS characters a hit, REST characters of the rest.
    """
    return "\n\n".join(x for x in map(_paragraph, results) if x)


def _paragraph(result) -> str | None:
    if isinstance(result, (list, tuple)):
        return f"Graph rows:\n{str(list(result))[:REST]}"
    if not isinstance(result, dict) or "error" in result:
        return None
    if "inferred_triples" in result:
        facts = ["(" + ", ".join(map(str, f)) + ")" for f in result["inferred_triples"][:FACTS]]
        return f"Inferred:\n- {', '.join(facts)}\n- by {json.dumps(result.get('rules_applied', {}), sort_keys=True)}" if facts else None
    if "results" in result:
        hits = [str(h.get("description") or h.get("content") or h)[:WORDS] for h in result["results"] if isinstance(h, dict)]
        return "Found:\n" + "\n".join(f"- {h}" for h in hits) if result["results"] else None
    return f"Returned:\n{json.dumps(result, default=str, sort_keys=True)[:REST]}"
