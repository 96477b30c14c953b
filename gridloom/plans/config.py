"""The configuration language and its tree of sections, variables and datasets.

    [h1: Ecosystem]          a section
    [h2: Gross Production]   a variable
    variable = "gpp"
    [Dataset]                a dataset under the last heading
    source = "path"

Values are strings, quotes come off, ``#`` begins a comment, ``#! key = value`` gives a run option. Levels deepen by one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Keys that a dataset takes over from its variable unless it has its own.
INHERITED = ("variable", "derived", "cmap", "weight", "ctype", "table_unit", "plot_unit", "space_mean", "mass_weighting", "skip_rmse", "skip_iav", "relationships", "scale_factor")
FLAGS = ("skip_rmse", "skip_iav", "skip_cycle", "space_mean", "mass_weighting")


@dataclass
class Node:
    name: str
    depth: int
    values: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    weight: float = 1.0
    normal: float = 1.0
    overall: float = 1.0

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


def _value(text: str) -> str:
    return text.strip().strip("\"'")


def parse_options(text: str) -> dict[str, str]:
    """Run options: lines ``#! key = value``."""
    return {m[1].strip(): _value(m[2]) for m in re.finditer(r"^\s*#!\s*([\w.-]+)\s*=\s*(.*)$", text, re.M)}


def parse(text: str) -> Node:
    """The tree with types, weights and inherited values filled in."""
    root = Node("", 0)
    at = [root]
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"#.*$", "", raw).strip()
        if not line:
            continue
        if heading := re.fullmatch(r"\[\s*h(\d+)\s*:\s*(.*?)\s*\]", line):
            depth = int(heading[1])
            if depth > len(at):
                raise ValueError(f"line {number}: h{depth} does not follow h{depth - 1}")
            at = at[:depth]
            at[-1].children.append(node := Node(heading[2], depth))
            at.append(node)
        elif dataset := re.fullmatch(r"\[\s*(.*?)\s*\]", line):
            holder = next(n for n in reversed(at) if n.depth >= 0 and not n.values.get("_leaf"))
            holder.children.append(node := Node(dataset[1], holder.depth + 1, {"_leaf": "1"}))
            at = [n for n in at if not n.values.get("_leaf")] + [node]
        elif "=" in line:
            key, _, value = line.partition("=")
            at[-1].values[key.strip()] = _value(value)
        else:
            raise ValueError(f"line {number}: {line!r}")
    return _finish(root)


def _finish(root: Node) -> Node:
    for node in list(root.walk()):
        expanded = []
        for child in node.children:
            depths = [d for d in re.split(r"[,\s]+", child.values.get("depths", "")) if d]
            expanded += [Node(f"{child.name} {d}m", child.depth, child.values | {"depth": d}, [Node(c.name, c.depth, dict(c.values)) for c in child.children]) for d in depths] or [child]
        node.children = expanded
    for node in root.walk():
        for child in node.children:
            if child.values.get("_leaf"):
                for key in INHERITED:
                    if key in node.values and key not in child.values and key != "weight":
                        child.values[key] = node.values[key]
                if "alternate_vars" in node.values:
                    child.values["alternate_vars"] = node.values["alternate_vars"]
        for child in node.children:
            child.weight = float(child.values.get("weight", 1))
        total = sum(c.weight for c in node.children)
        for child in node.children:
            child.normal = child.weight / total if total else 0.0
            child.overall = node.overall * child.normal
    return root


def flag(node: Node, key: str) -> bool:
    """A switch of a node: any text but a no counts as yes."""
    return node.values.get(key, "").lower() not in ("", "false", "0", "no", "none")


def leaves(spark: SparkSession, root: Node) -> DataFrame:
    """One row per dataset: section, variable, source, weight within its variable, weight overall."""
    rows = [(h1.name, h2.name, leaf.name, leaf.normal, h2.normal, h1.normal, leaf.overall) for h1 in root.children for h2 in h1.children for leaf in h2.children]
    return spark.createDataFrame(rows, "section string, variable string, source string, weight double, variable_weight double, section_weight double, overall_weight double")


def parse_models(text: str) -> list[tuple[str, str, float]]:
    """Name, path and shift in years of models: lines ``name, path[, shift]``; ``#`` begins a comment."""
    out = []
    for number, raw in enumerate(text.splitlines(), 1):
        parts = [p.strip() for p in raw.partition("#")[0].split(",")]
        if parts == [""]:
            continue
        if len(parts) not in (2, 3) or not all(parts):
            raise ValueError(f"line {number}: {raw!r}")
        out.append((parts[0], parts[1], float(parts[2]) if len(parts) == 3 else 0.0))
    return out


def to_json(root: Node) -> str:
    """The tree as JSON text, from which ``from_json`` makes it again."""

    def plain(node: Node) -> dict:
        return {"name": node.name, "values": {k: v for k, v in node.values.items() if k != "_leaf"}, "children": [plain(c) for c in node.children]}

    return json.dumps(plain(root), indent=1)


def from_json(text: str) -> Node:
    def lines(node: dict, depth: int):
        for child in node["children"]:
            yield f"[h{depth}: {child['name']}]" if depth < 3 else f"[{child['name']}]"
            yield from (f'{k} = "{v}"' for k, v in child["values"].items())
            yield from lines(child, depth + 1)

    return parse("\n".join(lines(json.loads(text), 1)))
