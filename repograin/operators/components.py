"""Component table of source files, and delivery tables built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.ranking import running_number
from repograin.functions.scores import r6
from repograin.functions.text import contains_any, count_of, file_stem, lines, lookup, rx
from repograin.operators.segments import segment_files
from repograin.registry import operator
from repograin.rules import code as K

_PROP = "array<struct<name:string,type:string,required:boolean>>"


def component_type(lang: Column, content: Column, name: Column) -> Column:
    low, has = F.lower(name), content.contains
    ts = (
        F.when(low.contains("page") | has("useRouter") | has("Router"), "Page")
        .when(low.contains("layout") | has("children"), "Layout").when(low.contains("form") | has("onSubmit"), "Form")
        .when(contains_any(low, ["nav", "menu"]), "Navigation").when(contains_any(low, ["modal", "dialog"]), "Modal")
        .when(low.contains("hook") | low.startswith("use"), "Hook").when(low.contains("context") | has("createContext"), "Context")
        .when(contains_any(low, ["service", "api"]), "Service").when(has("return") & (has("jsx") | has("<")), "Display").otherwise("Utility")
    )
    py = (
        F.when(has("class") & has("View"), "Service").when(has("class") & has("Model"), "Display").when(has("def") & has("render"), "Display")
        .when(contains_any(content, ["@app.route", "@bp.route"]), "Service").when(contains_any(content, ["forms.", "Form"]), "Display").otherwise("Utility")
    )
    java = F.when(contains_any(content, ["@RestController", "@Controller", "@Service", "@Repository"]), "Service").when(has("@Entity"), "Display").otherwise("Utility")
    return F.when(lang == "typescript", ts).when(lang == "python", py).otherwise(java)


def purpose(lang: Column, content: Column, name: Column, kind: Column) -> Column:
    has, text = content.contains, lambda t: F.format_string(t, name)
    ts = None
    for k, t in K.PURPOSES.items():
        ts = F.when(kind == k, text(t)) if ts is None else ts.when(kind == k, text(t))
    py = (
        F.when(has("@app.route"), text("Flask route handler for %s")).when(has("class") & has("View"), text("Django view handling requests for %s"))
        .when(has("class") & has("Model"), text("Django model representing %s data")).when(has("forms."), text("Django form for %s data validation"))
        .when(kind == "Service", text("Service component for %s")).when(kind == "Display", text("Display component for %s")).otherwise(text("Utility module for %s"))
    )
    java = (
        F.when(has("@RestController"), text("REST controller handling HTTP requests for %s")).when(has("@Service"), text("Service layer providing business logic for %s"))
        .when(has("@Repository"), text("Data access layer for %s operations")).when(has("@Entity"), text("JPA entity representing %s data model"))
        .when(kind == "Service", text("Service component for %s")).when(kind == "Utility", text("Utility class for %s")).otherwise(text("Java class for %s"))
    )
    return F.when(lang == "typescript", ts).when(lang == "python", py).otherwise(java)


def complexity(lang: Column, content: Column) -> Column:
    out = None
    for name, tokens in K.COMPLEXITY.items():
        total = F.lit(K.COMPLEXITY_BASE).cast("bigint")
        for token, weight in tokens:
            total = total + count_of(content, token) * weight
        score = F.least(total, F.lit(100))
        out = F.when(lang == name, score) if out is None else out.when(lang == name, score)
    return out


def status(lang: Column, content: Column) -> Column:
    has, size = content.contains, F.octet_length(content)
    open_work = contains_any(content, ["TODO", "FIXME"])
    tail = lambda done, low: F.when(done, "Complete").when(size < low, "Incomplete").otherwise("Complete")
    ts = F.when(contains_any(content, ["throw new Error", "console.error"]), "InProgress").otherwise(tail(contains_any(content, ["test", "spec"]), 100))
    py = F.when(count_of(content, "pass") > 1, "Todo").when(contains_any(content, ["print(", "logging.debug"]), "InProgress").otherwise(tail(contains_any(content, ["def test_", "class Test"]), 200))
    java = F.when(has("throw new UnsupportedOperationException"), "Todo").when(contains_any(content, ["System.out.println", "logger.debug"]), "InProgress").otherwise(tail(has("@Test"), 200))
    return F.when(open_work, "Todo").when(lang == "typescript", ts).when(lang == "python", py).otherwise(java)


def imports(lang: Column, content: Column) -> Column:
    all_of = lambda p, g=1: F.regexp_extract_all(content, F.lit(p), F.lit(g))
    ts = F.filter(all_of(K.TS_IMPORT), lambda d: ~d.startswith(".") & ~d.startswith("/"))
    pairs = F.zip_with(all_of(K.PY_IMPORT, 1), all_of(K.PY_IMPORT, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    py = F.array_sort(F.array_distinct(F.filter(pairs, lambda d: ~d.startswith(".") & ~d.startswith("__"))))
    java = F.filter(all_of(K.JAVA_IMPORT), lambda d: ~d.startswith("java.lang"))
    return F.when(lang == "typescript", ts).when(lang == "python", py).otherwise(java)


def api_calls(lang: Column, content: Column) -> Column:
    all_of = lambda p, g=1: F.regexp_extract_all(content, F.lit(p), F.lit(g))
    plain = lambda p, m: F.transform(all_of(p), lambda e: F.struct(e.alias("endpoint"), F.lit(m).alias("method")))
    axios = F.zip_with(all_of(K.TS_AXIOS, 2), all_of(K.TS_AXIOS, 1), lambda e, m: F.struct(e.alias("endpoint"), F.upper(m).alias("method")))
    kind = "array<struct<endpoint:string,method:string>>"
    return (
        F.when(lang == "typescript", F.concat(plain(K.TS_FETCH, "GET").cast(kind), axios.cast(kind)))
        .when(lang == "python", F.concat(plain(K.PY_ROUTE, "HTTP"), plain(K.PY_PATH, "HTTP")).cast(kind)).otherwise(plain(K.JAVA_MAPPING, "REST").cast(kind))
    )


def props(lang: Column, content: Column) -> Column:
    all_of = lambda p, g: F.regexp_extract_all(content, F.lit(rx(p)), F.lit(g))

    def of_line(l):
        name = F.trim(F.substring_index(l, ":", 1))
        kind = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(l, "^[^:]*:", "")), ",+$", ""), ";+$", "")
        return F.struct(F.regexp_replace(name, r"\?+$", "").alias("name"), kind.alias("type"), (~name.endswith("?")).alias("required"))

    declared = F.flatten(F.transform(all_of(K.TS_PROPS, 2), lambda b: F.transform(F.filter(F.transform(lines(b), lambda l: F.trim(l)), lambda l: l.contains(":")), of_line)))
    given = F.flatten(F.transform(all_of(K.TS_ARGUMENTS, 1), lambda b: F.transform(F.split(b, ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("name"), F.lit("unknown").alias("type"), F.lit(True).alias("required")))))
    py = F.zip_with(all_of(K.PY_ARGUMENT, 1), all_of(K.PY_ARGUMENT, 2), lambda n, t: F.struct(n.alias("name"), t.alias("type"), F.lit(True).alias("required")))
    return F.when(lang == "typescript", F.concat(declared.cast(_PROP), given.cast(_PROP))).when(lang == "python", py.cast(_PROP)).otherwise(F.array().cast(_PROP))


@operator("components.table")
def table(files: DataFrame) -> DataFrame:
    """One row per source file; a single projection, no shuffle."""
    lang, c, name = F.col("language"), F.col("content"), F.col("name")
    base = segment_files(files).withColumn("name", file_stem(F.col("path"))).withColumn("component_type", component_type(lang, c, name))
    return base.select(
        "repo", "path", "language", "name", "component_type", purpose(lang, c, name, F.col("component_type")).alias("purpose"),
        imports(lang, c).alias("imports"), api_calls(lang, c).alias("api_calls"), props(lang, c).alias("props"),
        F.when(lang == "typescript", F.filter(F.array(*[F.lit(h) for h in K.HOOKS]), lambda h: F.contains(c, h))).otherwise(F.array().cast("array<string>")).alias("hooks"),
        complexity(lang, c).alias("complexity"), status(lang, c).alias("status"), F.size(lines(c)).alias("line_count"),
    )


@operator("components.endpoints")
def endpoints(components: DataFrame) -> DataFrame:
    return components.select("repo", "path", F.col("name").alias("component"), "status", F.explode("api_calls").alias("a")).select("repo", "path", "component", "status", "a.endpoint", "a.method")


@operator("components.relations")
def relations(components: DataFrame) -> DataFrame:
    """Imports that name a component of the same repository."""
    used = components.select("repo", F.col("name").alias("source"), F.explode("imports").alias("target")).distinct()
    names = components.select("repo", F.col("name").alias("target")).distinct()
    return used.join(names, ["repo", "target"], "left_semi").select("repo", "source", "target")


def rollup_status(states: Column) -> Column:
    """All complete -> Complete; any complete or in progress -> InProgress; else Todo."""
    return F.when(F.bool_and(states == "Complete"), "Complete").when(F.bool_or(states.isin("Complete", "InProgress")), "InProgress").otherwise("Todo")


@operator("components.type_status")
def type_status(components: DataFrame) -> DataFrame:
    return components.groupBy("repo", "component_type").agg(rollup_status(F.col("status")).alias("status"), F.count("*").alias("n"))


@operator("components.completion")
def completion(components: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return components.groupBy("repo").agg(
        n("Complete").alias("complete"), n("InProgress").alias("in_progress"), n("Todo").alias("todo"), n("Incomplete").alias("incomplete"),
        F.count("*").alias("total"), r6(n("Complete") * 100.0 / F.count("*")).alias("percent_complete"), F.count_if(F.col("complexity") > 80).alias("debt_items"),
    )


@operator("components.domain_decision")
def domain_decision(components: DataFrame) -> DataFrame:
    """Controller, service and middleware scores and the ordered choice of one domain."""
    low, path, raw = F.lower("name"), F.lower("path"), F.col("path")
    named = lambda w: raw.contains(f".{w}.") | low.contains(w)
    calls = lambda ws: F.size(F.filter("api_calls", lambda a: contains_any(F.lower(a["endpoint"]), ws)))

    def score(role, w, words, folder):
        return F.sum(F.when(named(role) & (contains_any(low, words) | (path.contains(folder) if folder else F.lit(False))), w).otherwise(0))

    def endpoint(words):
        return F.sum(F.when(named("controller"), calls(words) * 2).otherwise(0))

    agg = components.groupBy("repo").agg(
        (score("controller", 3, ["auth"], "/auth/") + endpoint(["auth", "login", "register"])).alias("auth_e"),
        (score("controller", 3, ["user"], "/user/") + endpoint(["user", "profile"])).alias("user_e"),
        (score("controller", 3, ["property"], "/property/") + endpoint(["property", "listing"])).alias("property_e"),
        (score("controller", 3, ["product"], "/product/") + endpoint(["product", "inventory"])).alias("product_e"),
        score("service", 2, ["auth", "jwt", "session"], "/auth/").alias("auth_s"), score("service", 2, ["user"], "/user/").alias("user_s"),
        score("middleware", 2, ["auth", "jwt", "session"], None).alias("auth_m"), F.count_if(named("controller")).alias("controllers"),
    )
    auth, user = F.col("auth_e") + F.col("auth_s") + F.col("auth_m"), F.col("user_e") + F.col("user_s")
    rules = [((auth > 3) & (user > 2), "UserManagement", auth + user), (F.col("property_e") > 3, "RealEstate", F.col("property_e")), (F.col("product_e") > 3, "Ecommerce", F.col("product_e")),
             (auth > 2, "Authentication", auth), (F.col("controllers") > 0, "API", F.col("controllers"))]
    domain, points = None, None
    for test, name, pts in rules:
        domain = F.when(test, name) if domain is None else domain.when(test, name)
        points = F.when(test, pts) if points is None else points.when(test, pts)
    return agg.select("repo", domain.alias("domain"), points.cast("bigint").alias("score"), "controllers").where(F.col("domain").isNotNull())


@operator("components.integration_points")
def integration_points(files: DataFrame) -> DataFrame:
    config = files.where(F.col("path").isin(list(K.CONFIG_FILES))).select("repo", F.lit("config").alias("kind"), F.col("path").alias("item"), lookup(F.col("path"), K.CONFIG_FILES).alias("detail"))
    http = files.where((F.col("path") == "package.json") & contains_any(F.col("content"), ['"axios"', '"fetch"'])).select("repo", F.lit("service").alias("kind"), F.lit("HTTP API").alias("item"), F.lit("REST API").alias("detail"))
    return config.unionByName(http)


def story_group(name: Column, path: Column) -> Column:
    low, p = F.lower(name), F.concat(F.lit("/"), F.lower(path))
    out = None
    for group, ws, ps in K.STORY_GROUPS:
        test = contains_any(low, ws) | (contains_any(p, ps) if ps else F.lit(False))
        out = F.when(test, group) if out is None else out.when(test, group)
    return out


def _first_story(components: DataFrame) -> DataFrame:
    """Stories of the fixed templates for TypeScript components, by groups present."""
    ts = components.where(F.col("language") == "typescript").withColumn("g", story_group(F.col("name"), F.col("path")))
    groups = [g for g, _, _ in K.STORY_GROUPS]
    has = ts.groupBy("repo").agg(
        *[F.bool_or(F.coalesce(F.col("g") == g, F.lit(False))).alias(g) for g in groups],
        *[rollup_status(F.when(F.col("g") == g, F.col("status"))).alias(f"{g}_status") for g in groups],
    )
    present = {g: F.col(g) for g in groups}
    present["Property"] = F.col("Property") & ~F.col("User")
    present["API"] = F.col("API") & ~(F.col("User") | F.col("Property") | F.col("Location") | F.col("Image"))
    rows = [
        F.when(present[g], F.struct(F.lit(i).alias("rank"), F.lit("").alias("path"), F.lit(title).alias("title"), F.lit(p).alias("priority"), F.lit(x).alias("complexity"),
                                    F.col(f"{g}_status").alias("status"), F.array(*[F.lit(t) for t in criteria]).alias("criteria"), F.lit(g).alias("story_group"),
                                    F.lit(K.STORY_SENTENCES[i]).alias("description")))
        for i, (g, title, p, x, criteria) in enumerate(K.STORIES)
    ]
    return has.select("repo", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("repo", "s.*")


def _named_stories(components: DataFrame, with_templates: DataFrame) -> DataFrame:
    """One story per service or display component, or per complex component without templates."""
    kind, lang, name, cx = F.col("component_type"), F.col("language"), F.col("name"), F.col("complexity")
    text = lambda ts: F.array(*[F.format_string(t, name) if "%s" in t else F.lit(t) for t in ts])
    service, display = (kind == "Service") & lang.isin("python", "java"), (kind == "Display") & (lang == "python")
    plain = (lang == "typescript") & (cx > 30) & F.col("bare")
    flagged = components.join(with_templates.select("repo").distinct().withColumn("t", F.lit(True)), "repo", "left").withColumn("bare", F.col("t").isNull())
    title = (
        F.when(service & (lang == "python"), F.format_string("Access %s functionality", name)).when(service, F.format_string("Use %s service", name))
        .when(display, F.format_string("View %s interface", name)).when(plain, F.format_string("Use %s", name))
    )
    sentence = (
        F.when(service & (lang == "python"), F.format_string(K.PYTHON_SERVICE_SENTENCE, name)).when(service, F.format_string(K.JAVA_SERVICE_SENTENCE, name))
        .when(display, F.format_string(K.DISPLAY_SENTENCE, name)).when(plain, F.format_string(K.PLAIN_SENTENCE, name, F.lower("purpose")))
    )
    size = F.when(service, F.when(cx > 50, "Complex").otherwise("Medium")).when(display, F.when(cx > 40, "Complex").otherwise("Simple")).otherwise(F.when(cx > 60, "Complex").otherwise("Medium"))
    return flagged.where(service | display | plain).select(
        "repo", F.lit(100).alias("rank"), "path", title.alias("title"), F.lit("Medium").alias("priority"), size.alias("complexity"), "status",
        F.when(service, text(K.SERVICE_CRITERIA)).otherwise(text(K.DISPLAY_CRITERIA)).alias("criteria"), name.alias("story_group"), sentence.alias("description"),
    )


@operator("components.stories")
def stories(components: DataFrame) -> DataFrame:
    first = _first_story(components)
    both = first.unionByName(_named_stories(components, first))
    return running_number(both, ["repo"], ["rank", "path", "title"], "n").withColumn("id", F.format_string("US-%03d", F.col("n")))


@operator("components.story_components")
def story_components(story: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, id, component): group members for templates, the component itself otherwise."""
    g = components.withColumn("g", story_group(F.col("name"), F.col("path")))
    cols = ["repo", F.col("name").alias("component"), F.col("path").alias("component_path"), "status", "complexity", "imports"]
    ts = g.where(F.col("language") == "typescript").select(F.col("g").alias("story_group"), *cols)
    own = g.select(F.col("path").alias("path"), *cols)
    left = story.select("repo", "id", "rank", "path", "story_group")
    fixed = left.where(F.col("rank") < 100).drop("path", "rank").join(ts, ["repo", "story_group"]).drop("story_group")
    single = left.where(F.col("rank") == 100).drop("story_group", "rank").join(own, ["repo", "path"]).drop("path")
    return fixed.unionByName(single)


@operator("components.tasks")
def tasks(components: DataFrame) -> DataFrame:
    todo, doing = F.col("status").isin("Todo", "Incomplete"), F.col("status") == "InProgress"
    rows = components.where(todo | doing).select(
        "repo", "path", F.when(todo, F.format_string("Implement %s", "name")).otherwise(F.format_string("Complete %s", "name")).alias("name"), "status",
        F.when(todo, F.when(F.col("complexity") > 50, "Large").otherwise("Medium")).otherwise("Small").alias("effort"), F.lit("Medium").alias("priority"),
        F.concat(F.when(todo, "Complete").otherwise("Finish"), F.lit(" implementation of "), "name", F.lit(" component")).alias("description"),
    )
    return running_number(rows, ["repo"], ["path"], "n").withColumn("id", F.format_string("T-%03d", F.col("n")))


@operator("components.features")
def features(components: DataFrame) -> DataFrame:
    names = {k: v[0] for k, v in K.FEATURES.items()}
    values = {k: v[1] for k, v in K.FEATURES.items()}
    kind = F.col("component_type")
    return components.groupBy("repo", "component_type").agg(F.count("*").alias("n")).select(
        "repo", "component_type", "n", lookup(kind, names).alias("feature"), lookup(kind, values).alias("user_value")
    )
