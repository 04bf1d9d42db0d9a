"""Sections and operation matches: nothing is shuffled that need not be, and every match counts."""

import re
import time

from repograin.operators import documents, inference
from repograin.rules import documents as D


def plain_sections(text):
    heads = [(i, next((n for n, p in D.SECTIONS if re.search(p, l)), None)) for i, l in enumerate(text.splitlines()) if l.startswith("#") or any(re.search(p, l) for _, p in D.SECTIONS)]
    lines, out = text.splitlines(), []
    for k, (at, name) in enumerate(heads):
        if name:
            end = len(lines) if k + 1 == len(heads) else heads[k + 1][0] + (heads[k + 1][1] is None)
            out.append((len(out) + 1, name, "\n".join(lines[at + 1 : end]).strip()))
    return [s for s in out if s[2]]


def test_sections_equal_plain_version_and_leave_no_lines_to_shuffle(make_files):
    texts = ["# Overview\na\nb\n# Other\nc\n## Usage\nd\n\n", "no header\n", "## Installation\n## Usage\nx\n# Odd\n# Odd too\ny\n", "", "# Usage\n  only  \n", "a\n# Odd\n# API\nz"]
    files = make_files([("r", f"d{i}.md", t) for i, t in enumerate(texts)])
    found = documents.sections(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r["path"], []).append((r["ord"], r["section"], r["body"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(f"d{i}.md", [])) == plain_sections(t), t


def test_a_body_of_any_length(make_files):
    took = []
    for n in (1_000, 100_000, 200_000):
        text = "# Usage\n" + "line\n" * n + "# Odd\n" * 3 + "## API\n" + "x\n" * n
        at = time.time()
        rows = documents.sections(make_files([("r", "a.md", text)])).collect()
        took.append(time.time() - at)
        assert {r["section"]: len(r["body"]) for r in rows}["Usage"] == 5 * n + 5
    assert took[2] < 3 * took[1] + 2


def hits(make_files, rows):
    files = make_files(rows)
    return {(r["name"], r["operation"]): (r["hits"], r["layers"]) for r in inference.crud_hits(inference.entities(files), inference.surroundings(files)).collect()}


def test_an_entity_beside_a_later_match_counts(make_files):
    far = "#" * 500 + "\n"
    model = ("r", "src/models/invoice_model.ts", "export interface Invoice {\n  id: number;\n}\n")
    text = "INSERT INTO other;\n" + far + "INSERT INTO invoices;\n" + far + "myinvoicetable INSERT INTO x;\n" + far + "invoice\n"
    got = hits(make_files, [model, ("r", "src/a.ts", text), ("other", "src/b.ts", "INSERT INTO invoice;\n")])
    assert got[("invoice", "create")][0] == 2


def test_windows_end_at_200_characters(make_files):
    model = ("r", "src/models/invoice_model.ts", "export interface Invoice {\n  id: number;\n}\n")
    for gap, want in ((192, 1), (194, 0)):
        text = "INSERT INTO" + "-" * gap + "invoice"
        assert (("invoice", "create") in hits(make_files, [model, ("r", "src/a.ts", text)])) == bool(want), gap


def test_many_matches_and_their_places(make_files):
    from repograin.operators.inference import operation_matches

    n = 10_000
    files = make_files([("r", "src/a.ts", "INSERT INTO invoice;\n" * n)])
    rows = operation_matches(inference.surroundings(files))
    assert "content" not in rows.columns
    got = [(r["start"], r["size"]) for r in rows.where("pattern_no = 3").collect()]
    assert sorted(got) == [(21 * i + 1, 11) for i in range(n)]
