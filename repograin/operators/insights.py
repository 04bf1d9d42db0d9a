"""Quality insights on components and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.scores import bucket, clamp01, r6
from repograin.functions.text import contains_any, lookup
from repograin.registry import operator

# Score tables (tenths) and pattern library.
PRIORITY_VALUE = {"Critical": 10, "High": 8, "Medium": 6, "Low": 4}
COMPLEXITY_VALUE = {"Simple": 8, "Medium": 6, "Complex": 4, "Epic": 2}
STATUS_VALUE = {"Complete": 2, "InProgress": 1, "Todo": 0, "Incomplete": -1}
GRADES = [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]
PATTERNS = [
    ("business", "User Authentication", ["login", "auth", "signin"]),
    ("business", "Data Management", ["create", "update", "delete"]),
    ("business", "User Dashboard", ["dashboard", "overview", "summary"]),
    ("technical", "Repository Pattern", ["Repository", "DAO"]),
    ("technical", "Service Layer", ["Service", "Manager"]),
]
GOD_COMPLEXITY, GOD_METHODS = 90, 20

_OPEN = ["Todo", "Incomplete"]


def _rows(df: DataFrame, key: str, options: list[Column]) -> DataFrame:
    return df.select(key, F.explode(F.array_compact(F.array(*options))).alias("x")).select(key, "x.*")


@operator("insights.technical")
def technical(components: DataFrame) -> DataFrame:
    agg = components.groupBy("repo").agg(
        F.count_if(F.col("complexity") > 70).alias("complex"), F.count_if(F.size("api_calls") > 0).alias("api"), F.count_if(F.col("status").isin(_OPEN)).alias("open")
    )
    row = lambda cat, title, n, sev: F.struct(F.lit(cat).alias("category"), F.lit(title).alias("title"), n.alias("n"), sev.alias("severity"))
    sev = lambda n, k: F.when(n > k, "High").otherwise("Medium")
    a, b, c = F.col("complex"), F.col("api"), F.col("open")
    return _rows(agg, "repo", [
        F.when(a > 0, row("Maintainability", "High Complexity Components Detected", a, sev(a, 5))), F.when(b > 3, row("Architecture", "API-Heavy Architecture Detected", b, F.lit("Medium"))),
        F.when(c > 0, row("Testing", "Incomplete Implementation Risk", c, sev(c, 3))),
    ])


@operator("insights.recommendations")
def recommendations(components: DataFrame) -> DataFrame:
    service = F.col("component_type") == "Service"
    agg = components.groupBy("repo").agg(F.count_if(service).alias("s"), F.count_if(F.col("component_type") == "Context").alias("c"), F.count_if(service & (F.col("complexity") > 50)).alias("x"))
    row = lambda text, effort: F.struct(F.lit(text).alias("description"), F.lit(effort).alias("effort"))
    return _rows(agg, "repo", [
        F.when((F.col("s") > 5) & (F.col("c") > 3), row("Consider organizing components into domain-specific modules based on business capabilities", "Medium")),
        F.when(F.col("s") > 8, row("Large number of services suggests potential for microservices decomposition", "Large")),
        F.when(F.col("x") > 0, row("Complex services may benefit from caching to improve performance", "Small")),
    ])


@operator("insights.refactoring")
def refactoring(components: DataFrame) -> DataFrame:
    row = lambda kind, effort: F.struct(F.lit(kind).alias("kind"), effort.alias("effort"))
    x = F.col("complexity")
    options = F.array_compact(F.array(
        F.when(x > 80, row("very high complexity", F.lit("Medium"))), F.when(F.size("imports") > 8, row("high coupling", F.lit("Large"))),
        F.when(F.col("status").isin(_OPEN), row("not fully implemented", F.when(x > 50, "Large").otherwise("Medium"))),
    ))
    return components.select("repo", "path", F.explode(options).alias("o")).select("repo", "path", "o.kind", "o.effort")


@operator("insights.quality")
def quality(components: DataFrame, tech: DataFrame) -> DataFrame:
    agg = components.groupBy("repo").agg(F.sum("complexity").alias("cx"), F.count("*").alias("n"), F.count_if(F.col("status") == "Complete").alias("done"), F.bool_or(F.col("component_type") == "Service").alias("svc"))
    high = tech.where(F.col("severity") == "High").groupBy("repo").agg(F.count("*").alias("high"))
    j = agg.join(high, "repo", "left")
    easy = 1 - F.col("cx") / F.col("n") / 100.0
    debt = F.greatest(1 - F.coalesce("high", F.lit(0)) / F.col("n"), F.lit(0.0))
    tests = F.col("done") / F.col("n") * 0.6 + easy * 0.4
    docs = F.when(F.col("svc"), 0.6).otherwise(0.4)
    return j.select("repo", r6(easy).alias("maintainability"), r6(easy).alias("complexity"), r6(debt).alias("technical_debt"), r6(tests).alias("test_coverage"), docs.alias("documentation"), r6((easy + easy + debt + tests + docs) / 5).alias("overall"))


def story_value(priority: Column, complexity: Column, status: Column) -> Column:
    """(priority + complexity + status weight) / 2, clamped; weights in tenths."""
    return clamp01((lookup(priority, PRIORITY_VALUE) + lookup(complexity, COMPLEXITY_VALUE) + lookup(status, STATUS_VALUE)) / 20.0)


@operator("insights.story_risk")
def story_risk(stories: DataFrame, related: DataFrame) -> DataFrame:
    """Risk from the first related component; stories without one are low."""
    first = related.groupBy("repo", "id").agg(F.min(F.struct("component_path", "status", "complexity")).alias("m"))
    s = F.col("m.status")
    risk = F.when(s == "Todo", "High").when(s.isin("Incomplete", "InProgress"), "Medium").when((s == "Complete") & (F.col("m.complexity") > 70), "Medium").otherwise("Low")
    return stories.join(first, ["repo", "id"], "left").select("repo", "id", risk.alias("risk"))


@operator("insights.story_dependencies")
def story_dependencies(related: DataFrame) -> DataFrame:
    return related.select("repo", "id", F.explode("imports").alias("dependency")).where(~F.col("dependency").startswith("std") & ~F.col("dependency").startswith("java.")).distinct()


@operator("insights.acceptance_tests")
def acceptance_tests(stories: DataFrame) -> DataFrame:
    c = F.col("criterion")
    return stories.select("repo", "id", "title", F.posexplode("criteria").alias("pos", "criterion")).select(
        "repo", "id", (F.col("pos") + 1).alias("step"), F.format_string("Test %d - %s", F.col("pos") + 1, c).alias("scenario"),
        F.concat(F.lit("Given the user wants to "), F.lower("title")).alias("given"), F.concat(F.lit("When they "), F.lower(c)).alias("when_text"), F.lit("Then the system should respond appropriately").alias("then_text"),
    )


@operator("insights.business")
def business(components: DataFrame, stories: DataFrame, risks: DataFrame) -> DataFrame:
    forms = components.where(F.col("component_type") == "Form").groupBy("repo").agg(F.count("*").alias("n")).withColumn("kind", F.lit("UserExperience"))
    value = stories.where(story_value(F.col("priority"), F.col("complexity"), F.col("status")) > 0.7).groupBy("repo").agg(F.count("*").alias("n")).withColumn("kind", F.lit("FeaturePriority"))
    risk = risks.where(F.col("risk").isin("High", "Critical")).groupBy("repo").agg(F.count("*").alias("n")).withColumn("kind", F.lit("RiskAssessment"))
    return forms.unionByName(value).unionByName(risk).select("repo", "kind", "n")


@operator("insights.patterns")
def patterns(components: DataFrame) -> DataFrame:
    """Pattern library on component names, and the overgrown-component rule."""
    name, low = F.col("name"), F.lower("name")
    tests = [F.when(contains_any(low if k == "business" else name, ws), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("pattern"))) for k, n, ws in PATTERNS]
    tests.append(F.when((F.col("complexity") > GOD_COMPLEXITY) | (F.size("api_calls") > GOD_METHODS), F.struct(F.lit("anti").alias("kind"), F.lit("God Object").alias("pattern"))))
    return components.select("repo", "path", F.explode(F.array_compact(F.array(*tests))).alias("p")).select("repo", "path", "p.kind", "p.pattern")


@operator("insights.grades")
def grades(components: DataFrame, metrics: DataFrame) -> DataFrame:
    agg = components.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(_OPEN)).alias("open"), F.count_if(F.col("complexity") > 70).alias("complex"), F.count_if(F.col("status") == "Complete").alias("done"))
    pct = F.col("done") * 100 / F.col("n")
    return agg.join(metrics, "repo").select(
        "repo", bucket(F.col("overall"), GRADES, "F").alias("grade"), F.when(pct >= 90, "Excellent").when(pct >= 70, "Good").when(pct >= 50, "Fair").otherwise("Needs work").alias("completion"),
        F.when(F.col("open") == 0, "Low").when(F.col("open") <= F.floor(F.col("n") / 4), "Medium").otherwise("High").alias("implementation_risk"),
        F.when(F.col("complex") == 0, "Low").when(F.col("complex") <= 3, "Medium").otherwise("High").alias("complexity_risk"),
        bucket(F.col("maintainability"), [(0.8, "Good"), (0.6, "Fair"), (0.4, "Poor")], "Critical").alias("maintainability"),
    )


@operator("insights.roadmap")
def roadmap(components: DataFrame, stories: DataFrame, metrics: DataFrame, services: DataFrame) -> DataFrame:
    """Three phases with all their items."""
    item = lambda df, phase, kind, text: df.select("repo", F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), text.alias("item"))
    debt = item(components.where("complexity > 80"), 1, "debt", F.col("name"))
    todo = item(components.where("status = 'Todo'"), 1, "todo", F.col("name"))
    doing = item(components.where("status = 'InProgress'"), 2, "finish", F.col("name"))
    fresh = item(stories.where(F.col("priority").isin("High", "Critical")), 2, "story", F.col("title"))
    m = metrics.join(services.select("repo").distinct().withColumn("svc", F.lit(True)), "repo", "left")
    later = F.array_compact(F.array(
        F.when(F.col("technical_debt") > 0.6, "Architecture Refactoring"), F.when(F.col("test_coverage") < 0.7, "Testing Enhancement"), F.when(F.col("complexity") > 0.8, "Complexity Reduction"),
        F.when(F.col("svc").isNull(), "Integration Expansion"), F.lit("Performance Optimization"), F.lit("Documentation & Knowledge Transfer"),
    ))
    last = m.select("repo", F.explode(later).alias("t")).select("repo", F.lit(3).alias("phase"), F.lit("enhance").alias("kind"), F.col("t").alias("item"))
    return debt.unionByName(todo).unionByName(doing).unionByName(fresh).unionByName(last)
