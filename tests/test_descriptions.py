"""Evidence is described by all it found."""

from repograin.operators import reality


def test_files_that_differ_late_stay_apart(make_files):
    same = "".join(f"test('case {i} of the shared list')\n" for i in range(5))
    rows = [("r", f"tests/{n}.test.ts", same + f"test('{n} {n}x {n}y has words of its own')\n") for n in ("apple", "pear")]
    got = reality.all_evidence(make_files(rows), make_files(rows).selectExpr("repo", "path AS manifest", "path AS name", "'1' AS version", "'dependencies' AS scope").limit(0))
    texts = {r["path"]: r["description"] for r in got.where("reality_type = 'TestingImplemented'").collect()}
    assert len(texts) == 2 and len(set(texts.values())) == 2 and all(n in texts[f"tests/{n}.test.ts"] for n in ("apple", "pear"))
