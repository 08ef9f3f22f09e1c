"""Shapes that refer to shapes, against a plain checker."""

import random

import pytest

from cairn.operators import gates
from cairn.session import bounded

TRIPLE = "s string, p string, o string, o_kind string, datatype string"


def shapes_of(spark, rows):
    names = [part.split()[0] for part in gates.SHAPES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], gates.SHAPES)


def plain(triples, shapes):
    """Violations of targets: own faults, and one for each value that fails by itself or through references."""
    classes = {(s, o) for s, p, o, *_ in triples if p == "rdf:type"}
    values = lambda s, p: [t for t in triples if t[0] == s and t[1] == p]

    def own(node, shape):
        out = []
        for row in shapes:
            if row["shape"] != shape:
                continue
            path = row.get("path")
            if path is None:
                if row.get("class") and (node, row["class"]) not in classes:
                    out.append(("class", path))
                continue
            held = values(node, path)
            if len(held) < row.get("min_count", 0):
                out.append(("min-count", path))
            if len(held) > row.get("max_count", 10**9):
                out.append(("max-count", path))
            for *_, o, kind, datatype in held:
                if row.get("class") and (o, row["class"]) not in classes:
                    out.append(("class", path))
                if row.get("min_length") and len(o) < row["min_length"]:
                    out.append(("min-length", path))
                if "min_inclusive" in row and not (o.lstrip("-").replace(".", "", 1).isdigit() and float(o) >= row["min_inclusive"]):
                    out.append(("min-inclusive", path))
        return out

    refs = lambda node, shape: {(row.get("path"), o, row["node"]) for row in shapes if row["shape"] == shape and row.get("node") for o in ([node] if row.get("path") is None else [t[2] for t in values(node, row["path"])])}
    targets = {(s, r["shape"]) for r in shapes for s, p, o, *_ in triples if r.get("target_kind") == "class" and p == "rdf:type" and o == r["target"] or r.get("target_kind") == "subjects_of" and p == r["target"]}

    def fails(node, shape):
        seen, open_ = set(), [(node, shape)]
        while open_:
            pair = open_.pop()
            if pair not in seen:
                seen.add(pair)
                if own(*pair):
                    return True
                open_ += [(o, of) for _, o, of in refs(*pair)]
        return False

    out = []
    for node, shape in targets:
        out += [(code, node, path) for code, path in own(node, shape)]
        out += [("node", node, path) for path, o, of in refs(node, shape) if fails(o, of)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_nested_and_cyclic_shapes_equal_a_plain_checker(spark, seed):
    chance = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    triples = {(n, "rdf:type", chance.choice(["A", "B", "C"]), "iri", None) for n in nodes}
    triples |= {(n, chance.choice(["knows", "has"]), chance.choice(nodes), "iri", None) for n in nodes for _ in range(2)}
    triples |= {(n, "size", chance.choice(["7", "3.5", "-1", "many"] + ["9"] * 20), "literal", None) for n in nodes}
    shapes = [
        {"shape": "a", "target_kind": "class", "target": "A", "path": "knows", "node": "b"}, {"shape": "a", "target_kind": "class", "target": "A", "path": "size", "min_count": 1, "max_count": 1},
        {"shape": "b", "path": "has", "node": "c"}, {"shape": "b", "path": "size", "min_inclusive": 0.0}, {"shape": "c", "path": "knows", "node": "b", "max_count": 2}, {"shape": "c", "node": "d"}, {"shape": "c", "path": None, "class": "B"},
        {"shape": "d", "path": "size", "min_inclusive": 3.5}, {"shape": "e", "target_kind": "subjects_of", "target": "has", "path": "has", "class": "C"},
    ]
    got = gates.check_shapes(spark.createDataFrame(sorted(triples, key=str), TRIPLE), shapes_of(spark, shapes)).collect()
    assert sorted(((r.code, r.subject, r.message) for r in got), key=str) == plain(triples, shapes)


def test_a_long_chain_fails_from_its_end(spark):
    triples = [("n0", "rdf:type", "A", "iri", None)] + [(f"n{i}", "next", f"n{i + 1}", "iri", None) for i in range(4)] + [("n4", "size", "0", "literal", None)]
    shapes = [{"shape": "a", "target_kind": "class", "target": "A", "path": "next", "node": "a"}, {"shape": "a", "target_kind": "class", "target": "A", "path": "size", "min_inclusive": 1.0}]
    found = lambda rows: [(r.code, r.subject, r.message) for r in gates.check_shapes(spark.createDataFrame(rows, TRIPLE), shapes_of(spark, shapes)).collect()]
    assert found(triples) == [("node", "n0", "next")]
    assert found([*triples[:-1], ("n4", "next", "n0", "iri", None)]) == []  # a cycle without a fault
    assert gates.check_shapes(spark.createDataFrame([], TRIPLE), shapes_of(spark, shapes)).collect() == []


def test_tables_too_large_to_broadcast_are_refused(spark):
    assert bounded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        bounded(spark.range(6), 5)
