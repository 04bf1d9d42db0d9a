"""Line templates against a plain-Python version."""

from collections import defaultdict

from repograin.llm import line_templates

ROWS = [
    (1, "Order 17 was sent to Anna\nown words only here\n\nFooter of every page\nFooter of every page"),
    (2, "Order 99 was sent to Berta\nsomething else entirely now\nFooter of every page"),
    (3, "Order 3a was sent to Cilly\nFooter of every page\nOrder 17 was lost by Anna"),
    (4, None), (5, ""), (6, "   \n\t"), (7, "word " * 50_000), (8, "twice in one\ntwice in one\ntwice in one"), (None, "Footer of every page"), (None, "null line seen"), (1, "null line seen"), (9, "null line seen"),
    (9, "null line seen"),
]


def plain(rows, support=3, similarity=0.7):
    lines = []
    for k, text in rows:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            words = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split())
            if words:
                lines.append((k, i + 1, words))
    docs = defaultdict(set)
    for k, _, w in lines:
        docs[w].add(k)
    places = defaultdict(int)
    for w, d in docs.items():
        for i, x in enumerate(w):
            places[len(w), w[:3], i, x] += len(d)
    template, seen = {}, defaultdict(set)
    for w, d in docs.items():
        t = [x if x != "<*>" and places[len(w), w[:3], i, x] >= support else "<*>" for i, x in enumerate(w)]
        if sum(x != "<*>" for x in t) >= similarity * len(t):
            template[w] = " ".join(t)
            seen[template[w]] |= d
    return sorted(((k, n, template[w], len(seen[template[w]])) for k, n, w in lines if w in template and len(seen[template[w]]) >= support), key=str)


def test_equals_plain_version(docs):
    from pyspark.sql import functions as F

    df = docs(ROWS).withColumn("line", F.lit(1)).withColumn("words", F.lit("clash")).withColumn("key", F.lit(2)).withColumn("template", F.lit("t"))
    got = sorted((tuple(r) for r in line_templates.line_templates(df, similarity=0.5).collect()), key=str)
    assert got == plain(ROWS, similarity=0.5) and any("<*>" in t for _, _, t, _ in got)
    assert sorted((tuple(r) for r in line_templates.line_templates(docs(ROWS)).collect()), key=str) == plain(ROWS)


def test_lines_are_cut_out(docs):
    rows = [*ROWS[:8], (1, "other text of a repeated key")]
    out = line_templates.without_recurring(docs(rows), similarity=0.5).collect()
    assert len(out) == len(rows) and any(r.text == rows[-1][1] for r in out)
    got = {r.doc_id: r.text for r in out if r.text != rows[-1][1]}
    assert got[1] == "own words only here\n" and got[2] == "something else entirely now" and got[3] == "Order 17 was lost by Anna"
    assert got[4] is None and got[5] == "" and got[6] == "   \n\t" and got[8] == ROWS[7][1]


def test_empty_table(docs):
    assert line_templates.line_templates(docs([])).collect() == []
    assert line_templates.without_recurring(docs([])).collect() == []


def test_leaves_with_too_few_lines_are_not_looked_at(docs, monkeypatch):
    looked = {}
    kept = line_templates.saved
    monkeypatch.setattr(line_templates, "saved", lambda df, label="saved": looked.setdefault(label, kept(df, label)))
    df = docs([(1, "a pair of lines\nthree of a kind"), (2, "a pair of lines\nthree of a kind"), (3, "three of a kind")])
    assert line_templates.line_templates(df).count() == 3
    assert looked["leaves"].count() == 1 and looked["lines"].count() == 3
