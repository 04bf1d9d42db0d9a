"""Queries on what a repository is for, and for whom."""

from pyspark.sql import functions as F

from repograin.operators import purpose
from repograin.plans import code, domains  # noqa: F401
from repograin.plans.base import ORACLES, case_map, cte, frame, has_any, hit_list, q, query, values
from repograin.rules import purpose as P


@frame("purpose_domain")
def _(c):
    return purpose.domain(c.repos, purpose.scores(c.items))


@frame("product")
def _(c):
    return purpose.product(c.components)


_IND = [(d, P.POINTS[kind], kind, w) for d, kinds in P.INDICATORS.items() for kind, ws in kinds.items() for w in ws]
cte(
    "purpose_scores",
    f"SELECT repo, domain, CAST(sum(points) AS BIGINT) AS points FROM (SELECT repo, unnest({hit_list([f'kind = {q(kind)} AND contains(lower(item), {q(w)})' for _, _, kind, w in _IND])}) AS rule FROM items) JOIN {values([(i, d, n) for i, (d, n, _, _) in enumerate(_IND)], 'rule, domain, points', 'r')} USING (rule) GROUP BY repo, domain",
)
cte("purpose_domain", f"SELECT repo, coalesce(domain, '{P.GENERAL}') AS domain, coalesce(points, 0) AS points FROM repos LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY points DESC, domain) AS k FROM purpose_scores) USING (repo) WHERE coalesce(k, 1) = 1")


@query("b12_domain_by_items", "SELECT repo, domain, points FROM purpose_domain")
def _(c):
    """Which domain do endpoints (2), dependencies (3) and file names (1) speak for?"""
    return c.purpose_domain


@query("b14_purpose_context", f"SELECT repo, domain, kind, subject, pos, text FROM purpose_domain JOIN {values(purpose.context_rows(), 'domain, kind, subject, pos, text', 't')} USING (domain)")
def _(c):
    return purpose.context(c.purpose_domain)


_EP = [f"kind = 'endpoint' AND contains(item, {q(w)})" for w, _ in P.ENDPOINT_FEATURES]
_RM = [f"contains(lower(readme), {q(w)})" for w, _ in P.README_FEATURES]
_NAMES = dict(enumerate(f for _, f in [*P.ENDPOINT_FEATURES, *P.README_FEATURES]))
cte(
    "key_features",
    f"""SELECT repo, coalesce(pos, {len(_NAMES)}) AS pos, coalesce({case_map("pos", _NAMES)}, {q(P.NO_FEATURE)}) AS feature FROM repos LEFT JOIN
        (SELECT DISTINCT * FROM (SELECT repo, unnest({hit_list(_EP)}) AS pos FROM items UNION ALL SELECT repo, unnest({hit_list(_RM)}) + {len(_EP)} FROM readmes)) USING (repo)""",
)


@query("b14_key_features", "SELECT repo, pos, feature FROM key_features")
def _(c):
    return purpose.features(c.repos, c.items, c.files)


_ST = lambda i: case_map("domain", {k: v[i] for k, v in P.STATEMENTS.items() if v[i] is not None})
_VALUE = P.VALUE.split("%s")


@query(
    "b14_purpose_statement",
    f"""SELECT repo, domain, {_ST(0)} AS description, {_ST(1)} AS problem, coalesce({_ST(2)}, concat({q(_VALUE[0])}, lower(fs), {q(_VALUE[1])})) AS value_proposition,
        CASE WHEN domain = '{P.GENERAL}' THEN {P.GENERAL_CONFIDENCE}::DOUBLE ELSE {P.CONFIDENCE}::DOUBLE END AS confidence FROM purpose_domain JOIN (SELECT repo, string_agg(feature, ', ' ORDER BY pos) AS fs FROM key_features GROUP BY repo) USING (repo)""",
)
def _(c):
    return purpose.statement(c.purpose_domain, purpose.features(c.repos, c.items, c.files))


_CTRL = "(contains(path, '.controller.') OR contains(lower(name), 'controller'))"
_TELLS = f"CASE WHEN {_CTRL} THEN CASE WHEN contains(path, 'deno') OR len(list_filter(imports, lambda i: contains(i, 'danet'))) > 0 THEN 'Danet' WHEN len(list_filter(imports, lambda i: contains(i, '@nestjs'))) > 0 THEN 'NestJS' END END"
_PR = lambda i: case_map("product", {k: v[i] for k, v in P.PRODUCTS.items()})
cte("decisions", ORACLES["m13_controller_service_scoring"])
cte(
    "products",
    f"""SELECT repo, product, replace({_PR(0)}, '%s', framework) AS product_type, {_PR(1)} AS business_domain, CAST({_PR(2)} AS DOUBLE) AS confidence FROM
        (SELECT repo, CASE WHEN domain IN ({", ".join(q(k) for k in P.PRODUCTS if k not in ("API", "Generic"))}) THEN domain WHEN coalesce(score, named) > {P.API_LEAST} THEN 'API' ELSE 'Generic' END AS product,
         coalesce(framework, CASE WHEN domain IS NULL AND react THEN 'React' END, 'Generic') AS framework FROM
         (SELECT repo, arg_min(tells, path) FILTER (tells IS NOT NULL) AS framework, count(*) FILTER ({has_any("lower(name)", P.API_NAMES)}) AS named, bool_or(contains(lower(name), 'component') AND ends_with(lower(name), 'tsx')) AS react
          FROM (SELECT *, {_TELLS} AS tells FROM components) GROUP BY repo) LEFT JOIN decisions USING (repo))""",
)


@query("m13_product_type", "SELECT repo, product_type, business_domain, confidence FROM products")
def _(c):
    return c.product.select("repo", "product_type", "business_domain", "confidence")


@query("k5_personas_and_journeys", f"SELECT repo, kind, pos, text FROM products JOIN {values(purpose.audience_rows(), 'product, kind, pos, text', 't')} USING (product)")
def _(c):
    return purpose.audience(c.product).select("repo", "kind", F.col("pos"), "text")
