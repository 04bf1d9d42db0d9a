"""What a repository is for: domain by endpoints, libraries and files, and the facts that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.functions.automaton import Rule
from repograin.functions.text import contains_any, lookup
from repograin.operators import components as parts
from repograin.operators import domains
from repograin.registry import operator
from repograin.rules import purpose as P

INDICATOR_RULES = [Rule(domain, (kind,), (word,), P.POINTS[kind]) for domain, kinds in P.INDICATORS.items() for kind, words in kinds.items() for word in words]


@operator("purpose.scores")
def scores(items: DataFrame, rules: list[Rule] = INDICATOR_RULES) -> DataFrame:
    """``repo, domain, points``: every pattern counts for every endpoint, dependency and file that holds it."""
    return domains.config_scores(items, rules)


@operator("purpose.domain")
def domain(repos: DataFrame, scored: DataFrame) -> DataFrame:
    """The domain of most points, of equals the first by name; a repository without points is general software."""
    top = scored.groupBy("repo").agg(F.min(F.struct((-F.col("points")).alias("neg"), "domain")).alias("m"))
    return repos.join(top, "repo", "left").select("repo", F.coalesce("m.domain", F.lit(P.GENERAL)).alias("domain"), F.coalesce(-F.col("m.neg"), F.lit(0)).cast("bigint").alias("points"))


def context_rows() -> list[tuple[str, str, str, int, str]]:
    """(domain, kind, subject, position, text) of all fixed facts; a domain without its own ones has the general ones."""
    out = []
    for name in P.STATEMENTS:
        lists = {"user": P.USERS.get(name, []), "scenario": P.SCENARIOS.get(name, P.SCENARIOS[P.GENERAL]), "indicator": P.INDICATORS_OF_SUCCESS.get(name, P.INDICATORS_OF_SUCCESS[P.GENERAL])}
        out += [(name, kind, "", i, text) for kind, texts in lists.items() for i, text in enumerate(texts, 1)]
        for i, (who, role, goals, pains) in enumerate(P.PERSONAS.get(name, P.PERSONAS[P.GENERAL]), 1):
            out.append((name, "persona", who, i, role))
            out += [(name, kind, who, j, text) for kind, texts in (("goal", goals), ("pain", pains)) for j, text in enumerate(texts, 1)]
    return out


@operator("purpose.context")
def context(chosen: DataFrame) -> DataFrame:
    """Users, scenarios, personas with goals and pains, and success indicators, a row each."""
    table = chosen.sparkSession.createDataFrame(context_rows(), "domain string, kind string, subject string, pos int, text string")
    return chosen.select("repo", "domain").join(F.broadcast(table), "domain").select("repo", "domain", "kind", "subject", "pos", "text")  # under a hundred rows


@operator("purpose.features")
def features(repos: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, pos, feature``: key features by words of endpoints and of the README, or the one that says there are none."""
    found = lambda text, words: F.array_compact(F.array(*[F.when(text.contains(w), F.lit(i)) for i, w in words]))
    first = len(P.ENDPOINT_FEATURES)
    called = items.where(F.col("kind") == "endpoint").select("repo", F.explode(found(F.col("item"), [(i, w) for i, (w, _) in enumerate(P.ENDPOINT_FEATURES)])).alias("pos"))
    told = files.where("path = 'README.md'").select("repo", F.explode(found(F.lower("content"), [(first + i, w) for i, (w, _) in enumerate(P.README_FEATURES)])).alias("pos"))
    known = called.unionByName(told).distinct()
    names = dict(enumerate(f for _, f in [*P.ENDPOINT_FEATURES, *P.README_FEATURES]))
    return repos.join(known, "repo", "left").select("repo", F.coalesce("pos", F.lit(len(names))).alias("pos"), F.coalesce(lookup(F.col("pos"), names), F.lit(P.NO_FEATURE)).alias("feature"))


@operator("purpose.statement")
def statement(chosen: DataFrame, key_features: DataFrame) -> DataFrame:
    """``repo, domain, description, problem, value_proposition, confidence``; at most six features are named in a proposition."""
    named = key_features.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("pos", "feature"))).alias("fs"))
    listed = F.lower(F.array_join(F.transform("fs", lambda f: f["feature"]), ", "))
    of = lambda i: lookup(F.col("domain"), {k: v[i] for k, v in P.STATEMENTS.items() if v[i] is not None})
    return chosen.join(named, "repo").select(
        "repo", "domain", of(0).alias("description"), of(1).alias("problem"), F.coalesce(of(2), F.format_string(P.VALUE, listed)).alias("value_proposition"),
        F.when(F.col("domain") == P.GENERAL, P.GENERAL_CONFIDENCE).otherwise(P.CONFIDENCE).alias("confidence"))


@operator("purpose.product")
def product(components: DataFrame) -> DataFrame:
    """``repo, product, product_type, business_domain, confidence`` of every repository with components.

    The framework is that of the first controller by path that tells one. With
    few controllers, and with no other sign, a product is a web application.
    """
    low = F.lower("name")
    controller = F.col("path").contains(".controller.") | low.contains("controller")
    imported = lambda w: F.exists("imports", lambda i: i.contains(w))
    tells = F.when(controller, F.when(F.col("path").contains("deno") | imported("danet"), "Danet").when(imported("@nestjs"), "NestJS"))
    seen = components.groupBy("repo").agg(
        F.min(F.when(tells.isNotNull(), F.struct("path", tells.alias("framework"))))["framework"].alias("framework"),
        F.count_if(contains_any(low, P.API_NAMES)).alias("named"), F.bool_or(low.contains("component") & low.endswith("tsx")).alias("react"))
    scored = parts.domain_decision(components).select("repo", "domain", "score")
    both = seen.join(scored, "repo", "left")
    api = F.coalesce("score", "named") > P.API_LEAST
    kind = F.when(F.col("domain").isin([k for k in P.PRODUCTS if k not in ("API", "Generic")]), F.col("domain")).when(api, "API").otherwise("Generic")
    framework = F.coalesce("framework", F.when(F.col("domain").isNull() & F.col("react"), "React"), F.lit("Generic"))
    of = lambda i: lookup(F.col("product"), {k: v[i] for k, v in P.PRODUCTS.items()})
    return both.select("repo", kind.alias("product"), framework.alias("framework")).select(
        "repo", "product", F.replace(of(0), F.lit("%s"), F.col("framework")).alias("product_type"), of(1).alias("business_domain"), of(2).alias("confidence"))


def audience_rows() -> list[tuple[str, str, int, str]]:
    """(product, kind, position, text) of personas and journeys."""
    return [(k, kind, i, text) for k, (_, _, _, who, ways) in P.PRODUCTS.items() for kind, texts in (("persona", who), ("journey", ways)) for i, text in enumerate(texts, 1)]


@operator("purpose.audience")
def audience(products: DataFrame) -> DataFrame:
    """``repo, kind, pos, text``: personas and journeys of a repository's product."""
    table = products.sparkSession.createDataFrame(audience_rows(), "product string, kind string, pos int, text string")
    return products.select("repo", "product").join(F.broadcast(table), "product").select("repo", "kind", "pos", "text")  # some forty rows
