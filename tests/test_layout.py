import ast
import os

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "cairnstat")


def imports(path):
    with open(path) as f:
        for node in ast.walk(ast.parse(f.read())):
            if isinstance(node, ast.Import):
                yield from (a.name for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                yield "." * node.level + (node.module or "") + ":" + ",".join(a.name for a in node.names)


def test_nothing_outside_imports_the_training_data_operators():
    for folder, _, files in os.walk(ROOT):
        if "/llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                assert not any("llm" in x for x in imports(os.path.join(folder, name))), name


def test_every_query_names_its_operators():
    from cairnstat.plans import catalog

    assert set(catalog.OPS) == set(catalog.QUERIES) and all(catalog.OPS.values())
    assert set(catalog.SQL) <= set(catalog.QUERIES)
