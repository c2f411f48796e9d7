"""Routing, inference ledgers, coverage and gates: rules over small evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import compact, when_flag
from .relational import ranked

MAX_SOURCES = 12


def route(sources: DataFrame, lanes: list[str], namespaces: list[str], require_open: bool = False, keep: int = MAX_SOURCES) -> DataFrame:
    """Sources that share a lane or a namespace, by priority + 20 per lane + 35 per namespace; ``selected`` are the first
    ``keep``, the rest stays visible as truncated. Reads source_id, priority, lanes, namespaces and is_open."""
    shared = lambda c, wanted: F.size(F.array_intersect(F.col(c), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
    rows = sources.withColumns({"lane_hits": shared("lanes", lanes), "namespace_hits": shared("namespaces", namespaces)}).filter("lane_hits + namespace_hits > 0")
    if require_open:
        rows = rows.filter("is_open")
    rows = rows.withColumn("score", F.col("priority") + 20 * F.col("lane_hits") + 35 * F.col("namespace_hits"))
    return ranked(rows, [], [F.desc("score"), "source_id"], "place").withColumn("selected", F.col("place") <= keep)


def lane_coverage(sources: DataFrame, routed: DataFrame, lanes: list[str]) -> DataFrame:
    """For each wanted lane: covered, truncated, licence_excluded or unregistered."""
    spark = sources.sparkSession
    wanted = spark.createDataFrame([(x,) for x in lanes], "lane string")
    has = lambda df, name: df.select(F.explode("lanes").alias("lane")).distinct().withColumn(name, F.lit(True))
    out = wanted.join(has(routed.filter("selected"), "_s"), "lane", "left").join(has(routed, "_r"), "lane", "left").join(has(sources, "_a"), "lane", "left")
    return out.select("lane", F.when(F.col("_s"), "covered").when(F.col("_r"), "truncated").when(F.col("_a"), "licence_excluded").otherwise("unregistered").alias("coverage"))


def registry_violations(sources: DataFrame) -> DataFrame:
    """Registry rows without id, lane or licence, or with a repeated id."""
    bad = (F.coalesce(F.trim("source_id"), F.lit("")) == "") | (F.size("lanes") <= 0) | (F.coalesce(F.trim("licence"), F.lit("")) == "")
    repeated = sources.groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1").select("source_id", F.lit("repeated").alias("violation"))
    return sources.filter(bad).select("source_id", F.lit("incomplete").alias("violation")).unionByName(repeated)


HOPS = ("gene_to_reaction", "reaction_to_compound", "compound_to_name", "name_to_study", "gene_to_study")


def inference_ledger(gene_reaction: DataFrame, reaction_compound: DataFrame, compound_name: DataFrame, name_study: DataFrame) -> DataFrame:
    """Every hop of gene - reaction - compound - name - study as one row with its state. A compound without a name is kept
    as absent_no_refmet_mapping, and no state is evidence of absence."""
    hop = lambda df, kind, a, b: df.select(F.lit(kind).alias("hop"), F.col(a).alias("subject"), F.col(b).alias("object"))
    named = reaction_compound.select("compound").distinct().join(compound_name, "compound", "left")
    chain = gene_reaction.join(reaction_compound, "reaction").join(compound_name, "compound").join(name_study, "name").select("gene", "study").distinct()
    rows = [hop(gene_reaction, HOPS[0], "gene", "reaction"), hop(reaction_compound, HOPS[1], "reaction", "compound"), hop(named, HOPS[2], "compound", "name"), hop(name_study, HOPS[3], "name", "study"), hop(chain, HOPS[4], "gene", "study")]
    out = reduce(lambda a, b: a.unionByName(b), rows).distinct()
    state = F.when(F.col("object").isNull(), F.when(F.col("hop") == HOPS[2], "absent_no_refmet_mapping").otherwise("not_reported")).otherwise("declared_by_source")
    inferred = F.col("hop") == HOPS[4]
    return out.withColumns({"state": state, "is_inference": inferred, "is_evidence_of_absence": F.lit(False)})


def coverage_ledger(contexts: DataFrame) -> DataFrame:
    """Rows per context with what their status does and doesn't mean. Reads context, status and rows."""
    meaning = F.when(F.col("status") == "ok", "retrieved").when(F.col("status") == "gene_not_annotated", "source_has_no_annotation").when(F.col("status") == "no_hits", "source_returned_nothing").otherwise("not_established")
    return contexts.withColumns({"meaning": meaning, "is_evidence_of_absence": F.lit(False)})


def gate_outcome(checks: dict[str, Column], supported: Column) -> tuple[Column, Column]:
    """(outcome, failed checks): blocked if a check fails or is unknown, else supported or negative."""
    failed = compact(*[when_flag(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])
    return F.when(F.size(failed) > 0, "blocked").when(F.coalesce(supported, F.lit(False)), "supported").otherwise("negative"), F.array_join(failed, ";")


def agrees(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance; unknown on one side only disagrees."""
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def exactly_one(df: DataFrame, keys: dict[str, str], expected: dict[str, str]) -> DataFrame:
    """One row that tells whether the keys select one row, and which declared fields differ from it."""
    hit = df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in keys.items()]))
    differ = [F.when(F.max(F.col(c).cast("string")).eqNullSafe(F.lit(v)), None).otherwise(F.lit(c)) for c, v in expected.items()]
    return hit.agg(F.count("*").alias("rows"), F.array_join(F.array_compact(F.array(*differ)), ";").alias("differing")).withColumn("passed", (F.col("rows") == 1) & (F.col("differing") == ""))


# Fields that an advisory review packet must not have, and words in field names that mark such fields.
FORBIDDEN_FIELDS = (
    "accepted", "rejected", "acceptance", "rejection", "confidence", "approved_transform", "permitted_analysis", "pooling_authorized", "confidence_score", "confidence_scores", "transform", "transforms",
    "pooling_permission", "pooling_permissions", "pooling_authorization", "risk_of_bias_score", "risk_of_bias_scores", "meta_analytic_result", "meta_analytic_results", "meta_analysis_result",
    "meta_analysis_results", "pooled_estimate", "pooled_effect", "effect_calculation",
)
FORBIDDEN_WORDS = ("acceptance", "rejection", "confidence", "transform")
# Words that are forbidden together with one of others.
FORBIDDEN_TOGETHER = (
    (r"pooling", r"allow|authoriz|combinable|permission"),
    (r"risk_of_bias", r"score"),
    (r"meta_analytic|meta_analysis", r"effect|estimate|result"),
    (r"^pooled_", r"effect|estimate|result"),
)
# Fields of time, which would make a packet's digest change.
TIME_FIELDS = ("created_at", "generated_at", "updated_at", "timestamp")
# Fields of prose, what is left out of it before it is read, and statements of authority in the rest.
PROSE_FIELDS = ("intended_use", "detail", "description")
NEGATED = r"(?iu)\b(?:without|cannot|never|must not|do not|does not|did not)\b[^.;!?]*"
STATEMENTS = (
    ("acceptance or rejection decision", r"\b(?:accept|reject)(?:s|ed|ing)?\s+(?:(?:this|the|a|an)\s+)?(?:mapping|dataset|study|evidence|candidate)\b|\b(?:mapping|dataset|study|evidence|candidate)\s+(?:(?:is|was|has been|should be|must be|can be|may be|will be)\s+)?(?:accepted|rejected)\b|\b(?:acceptance|rejection)\s+(?:is\s+)?(?:recommended|approved|authorized|final|warranted)\b"),
    ("confidence score", r"\bconfidence(?:\s+score)?\s*(?:(?:is|=|:)\s*)?(?:0(?:\.\d+)?|1(?:\.0+)?|high|medium|low)\b"),
    ("approved transform", r"\b(?:transform(?:ation)?\s+(?:is\s+)?(?:approved|authorized|permitted|allowed)|(?:approved|authorized|permitted|allowed)\s+transform)\b"),
    ("pooling permission", r"\b(?:pooling\s+(?:is\s+)?(?:approved|authorized|permitted|allowed)|(?:approve|authorize|permit|allow)(?:s|ed|ing)?\s+(?:\w+\s+){0,3}pooling)\b"),
    ("risk-of-bias score", r"\brisk[-_ ]of[-_ ]bias\s+score\s*(?:(?:is|=|:)\s*)?(?:\d+(?:\.\d+)?|high|medium|low)\b"),
    ("meta-analytic result", r"\b(?:meta[-_ ]analytic\s+(?:result|estimate)|pooled\s+(?:result|estimate|effect))\s*(?:(?:is|=|:)\s*)?\S+"),
)


def packet_violations(packets: DataFrame, key: str, body: str) -> DataFrame:
    """Forbidden fields, time fields and statements of authority anywhere in nested packets, each once a packet.

    Every string of the JSON text is a token; the ones before a colon are its fields, at whatever depth. So packets are
    searched in place, without a schema and without recursion. A body that is no JSON is a violation of its own.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    token = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(token), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(token), F.lit(2)).alias("colon"))
    fields = F.array_distinct(F.transform(F.filter(parts, lambda p: p["colon"] != ""), lambda p: p["name"]))
    together = lambda low: reduce(lambda a, b: a | b, [low.rlike(x) & low.rlike(y) for x, y in FORBIDDEN_TOGETHER])
    forbidden = lambda f: f.isin(*FORBIDDEN_FIELDS) | F.lower(f).rlike("|".join(FORBIDDEN_WORDS)) | together(F.lower(f))
    of_time = lambda f: f.isin(*TIME_FIELDS) | F.endswith(f, F.lit("_timestamp"))
    prose = F.regexp_extract_all(text, F.lit(rf'"(?:{"|".join(PROSE_FIELDS)})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    said = F.transform(prose, lambda v: F.regexp_replace(F.element_at(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), 1), NEGATED, ""))
    tagged = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(f"{kind}:"), n))
    states = lambda pattern: F.exists(said, lambda v: v.rlike(f"(?iu)(?:{pattern})"))
    statements = F.array_compact(F.array(*[F.when(states(pattern), F.lit(f"statement:{label}")) for label, pattern in STATEMENTS]))
    found = F.concat(tagged("field", F.filter(fields, forbidden)), tagged("time", F.filter(fields, of_time)), statements)
    return packets.select(key, F.explode(F.when(F.try_parse_json(text).isNull(), F.array(F.lit("not_json"))).otherwise(found)).alias("violation"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Deprecated names with what replaces them and whether the alias is past its removal version (major.minor.patch)."""
    version = lambda c: F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))
    out = names.join(aliases, names[name] == aliases["alias"], "left")
    return out.select(names[name], F.coalesce("target", names[name]).alias("resolved"), F.col("alias").isNotNull().alias("deprecated"), F.coalesce(version(F.col("current")) >= version(F.col("removed_in")), F.lit(False)).alias("removed"))
