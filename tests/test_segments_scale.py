"""Extents of nested declarations in one linear pass."""

import random
import time

from repograin.operators import segments


def plain(lines):
    """(header, start, end) by looking at all later declarations of each."""
    decls = [(i, len(l) - len(l.lstrip())) for i, l in enumerate(lines, 1) if l.lstrip().startswith(("def ", "class "))]
    out = []
    for at, indent in decls:
        start = at
        while start > 1 and lines[start - 2].lstrip().startswith("@"):
            start -= 1
        later = [n for n, d in decls if n > at and d <= indent]
        out.append((at, start, (later[0] if later else len(lines) + 1) - 1))
    return out


def test_extents_equal_plain_version(make_files):
    rnd = random.Random(3)
    rows = []
    for f in range(20):
        kinds = ["def f{}():", "class C{}:", "@wrap", "x = {}", "", "    @inner", "  @x"]
        rows.append([" " * rnd.choice([0, 2, 4, 8]) + rnd.choice(kinds).format(i) for i in range(rnd.randint(1, 60))])
    files = make_files([("r", f"f{i}.py", "\n".join(ls) + "\n") for i, ls in enumerate(rows)])
    got = {}
    for r in segments.extract(files).collect():
        got.setdefault(r["path"], []).append((r["header_line"], r["start_line"], r["end_line"]))
        assert r["content"] == "\n".join(rows[int(r["path"][1:-3])][r["start_line"] - 1 : r["end_line"]])
    for i, ls in enumerate(rows):
        assert sorted(got.get(f"f{i}.py", [])) == plain(ls)


def test_a_file_of_200_000_lines(make_files):
    """Twice the lines take about twice the time; looking at all pairs would take four times as long."""
    body = lambda n: "".join(f"def f{i}():\n    @x\n    def g():\n        return {i}\n" for i in range(n // 4))
    took = []
    for n in (1_000, 100_000, 200_000):
        files = make_files([("r", "big.py", body(n))])
        at = time.time()
        assert segments.extract(files).select("start_line", "end_line").where("end_line >= start_line").count() == n // 2
        took.append(time.time() - at)
    assert took[2] < 3 * took[1] + 2
