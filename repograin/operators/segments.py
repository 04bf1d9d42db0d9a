"""Code segments: declarations with their extent, details, routes, models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from repograin.functions.facets import facet_counts
from repograin.functions.text import contains_any, let, lines, lookup, rx
from repograin.registry import operator
from repograin.rules import code as K
from repograin.rules.frameworks import SEGMENT_PATTERNS
from repograin.sources.corpus import not_ignored


def segment_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(list(K.SEGMENT_LANGUAGES)) & not_ignored(F.col("path"))).withColumn(
        "language", lookup(F.col("ext"), K.SEGMENT_LANGUAGES)
    )


def _declaration(line: Column, language: Column) -> Column:
    """``struct<kind,name,indent>`` of a declaration line, else null."""
    out = None
    for lang, rules in K.DECLARATIONS.items():
        for kind, pattern, group in rules:
            name = F.regexp_extract(line, rx(pattern), group)
            test = (language == lang) & (name != "") & ~name.isin(K.NOT_NAMES)
            found = F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.length(F.regexp_extract(line, rx(pattern), 1)).alias("indent"))
            out = F.when(test, found) if out is None else out.when(test, found)
    return out


@F.pandas_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def _spans(headers: pd.Series, indents: pd.Series, decorators: pd.Series, size: pd.Series) -> pd.Series:
    """First and last line of each declaration, by one pass with a stack of those still open; only line numbers come here."""

    def of_file(lines, depths, marked, last):
        marked, starts, ends, open_ = set(marked), [], [last] * len(lines), []
        for i, (line, depth) in enumerate(zip(lines, depths)):
            start = line
            while start - 1 in marked:
                start -= 1
            starts.append(start)
            while open_ and depths[open_[-1]] >= depth:
                ends[open_.pop()] = line - 1
            open_.append(i)
        return [{"start": a, "end": b} for a, b in zip(starts, ends)]

    return pd.Series([of_file(h.tolist(), i.tolist(), d.tolist(), n) for h, i, d, n in zip(headers, indents, decorators, size)])


@operator("segments.extract")
def extract(files: DataFrame) -> DataFrame:
    """Segments per source file, nested ones included.

    A segment starts at its decorators and ends before the next declaration
    that is not indented deeper. The file stays in its row: line numbers and
    indents of its declarations are folded once by a stack (in time linear in
    the lines, whatever the file's size), and each text is cut out by its span.
    """

    def scanned(ls: Column) -> Column:
        numbered = F.transform(ls, lambda l, i: F.struct((i + 1).alias("line_no"), _declaration(l, F.col("language")).alias("d"), l.alias("header")))
        marked = F.filter(F.transform(ls, lambda l, i: F.when(F.ltrim(l).startswith("@"), i + 1)), lambda n: n.isNotNull())
        return F.struct(ls.alias("lns"), F.filter(numbered, lambda m: m["d"].isNotNull()).alias("decls"), marked.alias("marked"))

    # exploding one element keeps the optimiser from scanning the lines again for each use
    source = segment_files(files).select("repo", "path", "language", F.explode(F.array(let(lines(F.col("content")), scanned))).alias("f")).select("repo", "path", "language", "f.*").where(F.size("decls") > 0)
    spans = _spans(F.transform("decls", lambda m: m["line_no"]), F.transform("decls", lambda m: m["d"]["indent"]), "marked", F.size("lns"))

    def segment(m: Column, span: Column) -> Column:
        text = F.array_join(F.slice(F.col("lns"), span["start"], span["end"] - span["start"] + 1), "\n")
        return F.struct(
            m["d"]["kind"].alias("kind"), m["d"]["name"].alias("name"), span["start"].alias("start_line"), m["line_no"].alias("header_line"), span["end"].alias("end_line"),
            m["header"].alias("header"), text.alias("content"),
        )

    out = source.withColumn("spans", spans).select("repo", "path", "language", F.explode(F.zip_with("decls", "spans", segment)).alias("s")).select("repo", "path", "language", "s.*")
    model = None
    for lang, ws in K.MODEL_WORDS.items():
        test = (F.col("language") == lang) & contains_any(F.col("content"), ws)
        model = test if model is None else model | test
    return out.select(
        F.concat_ws(":", "path", "header_line", "name").alias("segment_id"), "*",
        F.when((F.col("kind") == "Class") & model, "Database").otherwise(F.col("kind")).alias("segment_type"),
        let(F.lower("content"), lambda low: hints(low, F.col("language"))).alias("hints"),
        let(F.lower("content"), pattern_hits).alias("pattern_hits"),
    )


def pattern_hits(text: Column) -> Column:
    """Framework patterns the text shows, whichever framework the segment turns out to have."""
    return F.array_compact(F.array(*[
        F.when(contains_any(text, ws), F.struct(F.lit(f).alias("framework"), F.lit(n).alias("pattern"))) for f, n, ws in SEGMENT_PATTERNS
    ]))


def hints(text: Column, language: Column) -> Column:
    out = None
    for lang, groups in K.HINTS.items():
        found = F.array_compact(F.array(*[F.when(contains_any(text, ws), F.lit(h)) for h, ws in groups]))
        out = F.when(language == lang, found) if out is None else out.when(language == lang, found)
    return out


def _opt(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


@operator("segments.details")
def details(segments: DataFrame) -> DataFrame:
    """Parameters, return type, async flag, decorators, bases, methods, properties."""
    h, c, lang = F.col("header"), F.col("content"), F.col("language")
    is_class = F.col("kind") == "Class"
    split = lambda x: F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    params = F.when(F.col("kind") == "Function", split(F.regexp_extract(h, r"\(([^)]*)\)", 1)))
    returns = F.when(F.col("kind") == "Function", F.when(lang == "python", _opt(F.regexp_extract(h, r"->\s*([^:]+):", 1))).when(lang == "typescript", _opt(F.regexp_extract(h, r"\)\s*:\s*([^{=]+)", 1)))
                     .otherwise(_opt(F.regexp_extract(h, r"([\w<>\[\]]+)\s+\w+\s*\(", 1))))
    decorators = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(@[\w.]+)"), F.lit(1))
    bases = F.when(is_class, F.when(lang == "python", _opt(F.regexp_extract(h, r"class\s+\w+\(([^)]*)\)", 1))).otherwise(_opt(F.regexp_extract(h, r"extends\s+([\w.]+)", 1))))
    implements = F.when(is_class & (lang != "python"), split(F.regexp_extract(h, r"implements\s+([\w, ]+)", 1)))
    methods = F.when(is_class, F.when(lang == "python", F.regexp_extract_all(c, F.lit(r"(?m)^\s+(?:async\s+)?def\s+(\w+)"), F.lit(1)))
                     .when(lang == "java", F.regexp_extract_all(c, F.lit(r"(?m)^\s+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)[^\n;]*\{"), F.lit(1)))
                     .otherwise(F.filter(F.regexp_extract_all(c, F.lit(r"(?m)^\s+(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\([^)\n]*\)[^\n;]*\{\s*$"), F.lit(1)), lambda m: ~m.isin(K.NOT_NAMES))))
    with_colon = F.filter(F.transform(lines(c), lambda l: F.trim(l)), lambda l: l.contains(":") & ~l.startswith("//"))
    props = F.when(F.col("kind") == "Interface", F.filter(F.transform(with_colon, lambda l: F.trim(F.substring_index(l, ":", 1))), lambda p: p != ""))
    return segments.select(
        "repo", "segment_id", "segment_type", "name", params.alias("parameters"), returns.alias("return_type"), h.rlike(r"\basync\b").alias("is_async"),
        decorators.alias("decorators"), bases.alias("extends"), implements.alias("implements"), methods.alias("methods"), props.alias("properties"),
    )


_UNQUOTE = r"""^['"]+|['"]+$"""


def unquote(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), _UNQUOTE, "")


@operator("segments.routes")
def routes(files: DataFrame) -> DataFrame:
    """One row per route declaration: (path, method, handler)."""
    row = lambda p, m, h: F.struct(p.alias("route"), m.alias("method"), F.lit(h).alias("handler"))
    inner = lambda l: F.regexp_extract(l, r"\(([^)]*)\)", 1)
    first = lambda s: unquote(F.substring_index(s, ",", 1))

    def ts_line(l):
        verb = F.regexp_extract(l, r"@(Get|Post|Put|Delete)\(", 1)
        call = F.regexp_extract(l, r"(?:app|router)\.(get|post|put|delete|patch)\(", 1)
        return F.when(verb != "", row(F.when(unquote(inner(l)) == "", "/").otherwise(unquote(inner(l))), F.upper(verb), "NestJS Controller Method")).when(
            (call != "") & l.contains(","), row(unquote(F.regexp_extract(l, r"(?:app|router)\.\w+\(([^,]*),", 1)), F.upper(call), "Express Route Handler")
        )

    def py_line(l):
        flask = l.contains("@app.route") | l.contains("@bp.route")
        methods = F.regexp_extract(l, r"methods[^\[]*\[([^\]]*)\]", 1)
        named = F.array_join(F.transform(F.split(methods, ","), lambda m: unquote(m)), ",")
        verb = F.regexp_extract(l, r"@(?:app|router)\.(get|post|put|delete)", 1)
        return F.when(flask & l.contains(")"), row(first(inner(l)), F.when(methods != "", named).otherwise("GET"), "Flask Route Handler")).when(
            (verb != "") & l.contains(")"), row(first(inner(l)), F.upper(verb), "FastAPI Endpoint")
        )

    def java_line(l):
        verb = F.regexp_extract(l, r"@(Get|Post|Put|Delete|Request)Mapping", 1)
        inside = inner(l)
        named = unquote(F.regexp_extract(inside, r"(?:value|path)[^=]*=([^,]*)", 1))
        path = F.when(F.trim(inside).rlike("^['\"]"), first(inside)).when(named != "", named).otherwise("/")
        req = F.coalesce(F.nullif(F.regexp_extract(l, r"method\s*=\s*RequestMethod\.(GET|POST|PUT|DELETE)", 1), F.lit("")), F.lit("ANY"))
        return F.when(verb != "", row(path, F.when(verb == "Request", req).otherwise(F.upper(verb)), "Spring Boot Controller Method"))

    c, lang = F.col("content"), F.col("language")
    by_line = F.transform(
        lines(c),
        lambda l, i: F.struct((i + 1).alias("line_no"), F.when(lang == "typescript", ts_line(l)).when(lang == "python", py_line(l)).otherwise(java_line(l)).alias("r")),
    )
    found = F.filter(by_line, lambda x: x["r"].isNotNull())
    nextjs = (lang == "typescript") & c.contains("export default") & c.contains("req") & c.contains("res")
    django = (lang == "python") & c.contains("def") & (c.contains("request") | c.contains("HttpResponse"))
    whole = lambda p, h: F.array(F.struct(F.lit(0).alias("line_no"), F.struct(F.lit(p).alias("route"), F.lit("ANY").alias("method"), F.lit(h).alias("handler")).alias("r")))
    kind = "array<struct<line_no:int,r:struct<route:string,method:string,handler:string>>>"
    chosen = F.when(F.size(found) > 0, found.cast(kind)).when(nextjs, whole("/api/*", "Next.js API Handler").cast(kind)).when(django, whole("/*", "Django View").cast(kind))
    source = segment_files(files).select("repo", "path", F.explode(chosen).alias("x"))
    return source.select("repo", "path", "x.line_no", "x.r.route", "x.r.method", "x.r.handler")


@operator("segments.models")
def models(segments: DataFrame) -> DataFrame:
    """Database models: table name, fields, relationship fields."""
    c, lang = F.col("content"), F.col("language")
    trimmed = F.transform(lines(c), lambda l: F.trim(l))
    left_of = lambda l: F.trim(F.substring_index(l, "=", 1))
    py_fields = F.filter(F.transform(F.filter(trimmed, lambda l: contains_any(l, K.PY_FIELD_WORDS) & l.contains("=")), left_of), lambda n: (n != "") & ~n.startswith("_"))
    py_rel = F.filter(F.transform(F.filter(trimmed, lambda l: contains_any(l, K.PY_RELATION_WORDS) & l.contains("=")), left_of), lambda n: n != "")
    access = r"^(?:private|public|protected) "
    last = lambda l: F.regexp_replace(F.element_at(F.split(l, r"\s+"), -1), ";+$", "")
    skipped = lambda l: contains_any(l, ["@Column", "@Id", "@GeneratedValue"])
    java_fields = F.transform(F.filter(trimmed, lambda l: ~skipped(l) & l.rlike(access) & l.contains(";") & ~l.contains("(") & (F.size(F.split(l, r"\s+")) >= 3)), last)
    java_rel = let(trimmed, lambda ls: F.filter(
        F.transform(ls, lambda l, i: F.when(
            contains_any(l, K.JAVA_RELATION_WORDS),
            last(F.element_at(F.filter(F.slice(ls, i + 2, F.size(ls)), lambda x: x.rlike(access) & x.contains(";") & (F.size(F.split(x, r"\s+")) >= 3)), 1)),
        )), lambda n: n.isNotNull()))
    table = F.when(lang == "python", F.nullif(unquote(F.regexp_extract(c, r"__tablename__[^=]*=([^\n]*)", 1)), F.lit(""))).otherwise(
        F.nullif(unquote(F.regexp_extract(c, r"(?s)@Table.*?name.*?=([^,)]*)", 1)), F.lit(""))
    )
    return segments.where(F.col("segment_type") == "Database").select(
        "repo", "segment_id", "name", table.alias("table_name"), F.when(lang == "python", py_fields).otherwise(java_fields).alias("fields"),
        F.when(lang == "python", py_rel).otherwise(java_rel).alias("relations"),
    )


@operator("segments.framework")
def framework(segments: DataFrame, detected: DataFrame) -> DataFrame:
    """First detected framework whose path or content words the segment shows.

    The words are tested inside the segment's row; only the repository's short
    list of detected frameworks is joined.
    """
    low, path = F.lower("content"), F.lower("path")
    candidates = F.array_compact(F.array(*[
        F.when(contains_any(low, ws) | (contains_any(path, ps) if ps else F.lit(False)), F.lit(f)) for f, ps, ws in K.SEGMENT_FRAMEWORKS
    ]))
    known = detected.groupBy("repo").agg(F.collect_set("framework").alias("known"))
    return (
        segments.withColumn("candidates", candidates).join(known, "repo", "left")
        .withColumn("framework", F.try_element_at(F.filter("candidates", lambda f: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), f)), F.lit(1)))
        .drop("candidates", "known")
    )


@operator("segments.patterns")
def patterns(segments: DataFrame) -> DataFrame:
    """Named framework patterns per segment that belongs to the framework.

    The texts were tested when the segments were cut, so none is shuffled here.
    """
    own = F.filter("pattern_hits", lambda h: h["framework"] == F.col("framework"))
    return segments.where(F.col("framework").isNotNull()).select("repo", "segment_id", "framework", "hints", F.explode(own).alias("h")).select(
        "repo", "segment_id", "framework", "hints", "h.pattern"
    )


@operator("segments.statistics")
def statistics(segments: DataFrame) -> DataFrame:
    by = facet_counts(segments.withColumn("language", F.col("language")), "repo", {"type": "segment_type", "framework": "framework", "language": "language"}, total=True)
    hint = segments.select("repo", F.explode("hints").alias("label")).groupBy("repo", "label").agg(F.count("*").alias("n"))
    return by.unionByName(hint.select("repo", F.lit("hint").alias("dimension"), "label", "n"))
