"""Purpose, product and tracker facts on small repositories with known answers."""

import json

from repograin.operators import exports, purpose

ITEMS = "repo string, kind string, item string"
COMPONENTS = "repo string, path string, name string, imports array<string>, api_calls array<struct<method:string,endpoint:string>>"


def test_domain_by_endpoints_libraries_and_files(spark):
    rows = [
        ("shop", "endpoint", "/API/Cart"), ("shop", "endpoint", "/orders/payment"), ("shop", "dependency", "stripe"), ("shop", "file", "payment.ts"),
        ("tool", "dependency", "tree-sitter"), ("tool", "file", "parser.rs"), ("none", "file", "main.c"), ("none", "endpoint", None),
        ("even", "file", "midi.py"), ("even", "file", "order.py"),
    ]
    repos = spark.createDataFrame([("shop",), ("tool",), ("none",), ("even",), ("bare",)], "repo string")
    got = {r.repo: (r.domain, r.points) for r in purpose.domain(repos, purpose.scores(spark.createDataFrame(rows, ITEMS))).collect()}
    assert got == {
        "shop": ("ecommerce", 2 + 2 + 2 + 3 + 1), "tool": ("developer_tools", 3 + 1), "none": ("general_software", 0),
        "even": ("audio_processing", 1), "bare": ("general_software", 0),
    }


def test_facts_of_a_domain(spark):
    chosen = spark.createDataFrame([("a", "audio_processing"), ("b", "general_software"), ("c", "ecommerce")], "repo string, domain string")
    rows = purpose.context(chosen).collect()
    by = lambda repo, kind: [r.text for r in sorted((r for r in rows if r.repo == repo and r.kind == kind), key=lambda r: (r.subject, r.pos))]
    assert len(by("a", "user")) == 4 and len(by("a", "scenario")) == 4 and len(by("a", "indicator")) == 5 and len(by("a", "goal")) == 6
    assert by("b", "user") == [] and by("b", "persona") == by("c", "persona") == ["Primary system user"] and len(by("c", "user")) == 3
    items = spark.createDataFrame([("b", "endpoint", "/v1/status"), ("b", "endpoint", "/v2/status"), ("b", "endpoint", "/process/x")], ITEMS)
    files = spark.createDataFrame([("b", "README.md", "An API"), ("c", "docs/README.md", "api midi")], "repo string, path string, content string")
    features = purpose.features(chosen, items, files)
    assert [r.feature for r in sorted(features.where("repo = 'b'").collect(), key=lambda r: r.pos)] == [
        "Asynchronous processing of user submissions", "Real-time job status tracking", "RESTful API for programmatic access"]
    said = {r.repo: r for r in purpose.statement(chosen, features).collect()}
    assert said["b"].value_proposition.startswith("Delivers asynchronous processing of user submissions, real-time job status tracking, restful api")
    assert said["c"].value_proposition.startswith("Provides a complete online selling") and (said["b"].confidence, said["c"].confidence) == (0.6, 0.85)


def test_product_of_controllers(spark):
    nest, call = ["@nestjs/common"], [("GET", "/auth/login"), ("POST", "/user/register")]
    rows = [("u", "src/b.controller.ts", "AuthUserController", nest, call), ("u", "src/a.controller.ts", "Plain", ["danet"], []), ("u", "src/user.service.ts", "UserService", [], [])]
    rows += [("api", f"src/c{i}.ts", f"Thing{i}Controller", nest, []) for i in range(3)] + [("few", f"src/c{i}.ts", f"Thing{i}Controller", nest, []) for i in range(2)]
    rows += [("lib", f"src/s{i}.ts", f"S{i}Service", None, None) for i in range(3)] + [("page", "src/p.tsx", "Page", [], [])]
    got = {r.repo: (r.product_type, r.confidence) for r in purpose.product(spark.createDataFrame(rows, COMPONENTS)).collect()}
    assert got == {
        "u": ("Danet User Authentication & Management Service", 0.95), "api": ("NestJS REST API Service", 0.7), "few": ("Web Application", 0.6),
        "lib": ("Generic REST API Service", 0.7), "page": ("Web Application", 0.6),
    }
    who = purpose.audience(purpose.product(spark.createDataFrame(rows, COMPONENTS)))
    assert {r.text for r in who.where("repo = 'api' and kind = 'persona'").collect()} == {"API Client", "Frontend Application", "Mobile App", "System Administrator"}


def test_tracker_bodies(spark):
    stories = spark.createDataFrame(
        [("r", "US-001", "Title", "High", "Medium", "Todo", ["one", 'say "two"'], "As a user"), ("r", "US-002", "Low one", "Medium", "Medium", "Todo", ["x"], "no")],
        "repo string, id string, title string, priority string, complexity string, status string, criteria array<string>, description string")
    tasks = spark.createDataFrame([("r", "T-1", "Fix", "Broken\nlogin", "Todo", "Small", "Critical"), ("r", "T-2", "Later", "x", "Todo", "Small", "Medium")],
                                  "repo string, id string, name string, description string, status string, effort string, priority string")
    got = {r.id: (r.kind, json.loads(r.payload)) for r in exports.tracker(stories, tasks).collect()}
    assert set(got) == {"US-001", "T-1"} and got["T-1"][0] == "ticket"
    assert got["US-001"][1] == {
        "title": "Title", "labels": ["user-story", "priority:high"],
        "body": '**User Story**: As a user\n\n## Acceptance Criteria\n\n1. one\n2. say "two"\n\n**Priority**: High\n**Complexity**: Medium\n**Status**: Todo'}
    assert got["T-1"][1]["body"] == "*Task Description*: Broken\nlogin\n\n*Priority*: Critical\n*Status*: Todo\n*Effort Estimate*: Small"
