"""Imports resolved to files by path suffix, and the typed edges made of them."""

from repograin.operators import graph, imports, segments


def resolved(make_files, rows):
    files = make_files(rows)
    return {(r["path"], r["spec"]): (r["target"], r["strength"]) for r in imports.resolve(files, imports.specs(files)).collect()}


def test_relative_absolute_and_package_imports(make_files):
    ts = lambda *specs: "".join(f"import x from '{s}';\n" for s in specs)
    rows = [
        ("r", "src/pages/home.tsx", ts("./card", "../lib/http", "../../top", "lib/http", "@app/lib/http", "react", "./missing", "../lib", "./card.tsx", "../../../../top")),
        ("r", "src/pages/card.tsx", ts("./home")), ("r", "src/lib/http.ts", ""), ("r", "src/lib/index.ts", ""), ("r", "top.ts", ""),
        ("r", "old/deep/lib/http.ts", ""), ("r", "app/models/user.py", "from . import base\nfrom ..util.text import a\nfrom app.models.base import b\nimport os\nfrom .order.line import c\n"),
        ("r", "app/models/base.py", ""), ("r", "app/models/__init__.py", ""), ("r", "app/util/text.py", ""), ("r", "app/models/order/line.py", ""),
        ("r", "src/main/java/com/shop/Cart.java", "import com.shop.model.Item;\nimport com.other.shop.model.Item;\nimport java.util.List;\n"), ("r", "src/main/java/com/shop/model/Item.java", ""),
        ("other", "src/lib/only.ts", ""),
    ]
    got = resolved(make_files, rows)
    home = {s: got["src/pages/home.tsx", s] for p, s in got if p == "src/pages/home.tsx"}
    assert home == {
        "./card": ("src/pages/card.tsx", 1.0), "./card.tsx": ("src/pages/card.tsx", 1.0), "../lib/http": ("src/lib/http.ts", 1.0), "../../top": ("top.ts", 1.0), "../../../../top": ("top.ts", 1.0),
        "lib/http": ("src/lib/http.ts", 1.0), "@app/lib/http": ("src/lib/http.ts", 0.666667), "react": (None, None), "./missing": (None, None), "../lib": ("src/lib/index.ts", 1.0),
    }
    user = {s: t for (p, s), (t, _) in got.items() if p == "app/models/user.py"}
    assert user == {".": "app/models/__init__.py", "..util.text": "app/util/text.py", "app.models.base": "app/models/base.py", "os": None, ".order.line": "app/models/order/line.py"}
    cart = {s: v for (p, s), v in got.items() if p.endswith("Cart.java")}
    assert cart["com.shop.model.Item"] == ("src/main/java/com/shop/model/Item.java", 1.0) and cart["com.other.shop.model.Item"] == ("src/main/java/com/shop/model/Item.java", 0.6)


def test_a_name_of_many_files_gives_one_row(make_files):
    rows = [("r", f"src/p{i}/utils.ts", "import a from 'utils';\n") for i in range(60)]
    got = resolved(make_files, rows)
    assert len(got) == 60 and {t for t, _ in got.values()} == {"src/p0/utils.ts"}


def test_typed_edges_missing_and_orphans(make_files):
    rows = [
        ("r", "src/cart.py", "from src.money import add\nimport nowhere\ndef total():\n    return wallet\n"), ("r", "src/money.py", "from .money import x\ndef add():\n    pass\n"),
        ("r", "src/wallet.py", "def empty():\n    pass\ndef fill():\n    pass\n"),
    ]
    files = make_files(rows)
    found = imports.resolve(files, imports.specs(files))
    cut = segments.extract(files)
    mentions = graph.mentions(cut)
    edges = {(r["src"], r["dst"], r["ref_type"]): (r["strength"], r["refs"]) for r in graph.edges(mentions, found, cut).collect()}
    assert edges[("cart", "money", "import")] == (1.0, 1) and edges[("money", "money", "import")] == (1.0, 1) and edges[("cart", "wallet", "mention")] == (1.0, 1)
    assert {(r["src"], r["spec"]) for r in graph.missing(found).collect()} == {("cart", "nowhere")}
    quiet = {r["segment_id"].split(":")[-1] for r in graph.orphans(cut, mentions, found).collect()}
    assert quiet == {"empty", "fill"}
