"""Parsers of service responses. Retrieval itself is a reader's task; what comes back is classified, never guessed.

A failed source is ``unavailable``, not zero hits; an empty body says nothing about absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import record_key


def _row_count(body: Column, nested: Column | None = None) -> Column:
    """Objects in a JSON body: of a list, of a list's lists where ``nested``, of one object that isn't empty; else 0."""
    is_object = lambda x: F.ltrim(x).startswith("{")
    items = F.from_json(body, "array<string>")
    inner = lambda x: F.coalesce(F.size(F.filter(F.from_json(x, "array<string>"), is_object)), F.lit(0))
    own = F.size(F.filter(items, is_object))
    listed = own if nested is None else F.when(nested, F.aggregate(items, F.lit(0), lambda n, x: n + F.when(F.ltrim(x).startswith("["), inner(x)).otherwise(is_object(x).cast("int")))).otherwise(own)
    return F.when(body.startswith("["), listed).when(body.startswith("{"), (~body.rlike(r"\A\{\s*\}\z")).cast("int")).otherwise(0)


def _is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def classify(status: Column, content_type: Column, body: Column) -> Column:
    """ok / no_hits / request_rejected / unavailable. The service answers 200 for bad requests and misses alike, so the body
    decides: HTML rejects a request, an empty or broken body is a failed source, JSON without a row is no hit."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    page = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")) | text.startswith("<")
    return (
        F.when(status.isNull() | (status >= 400) | (text == ""), "unavailable").when(page, "request_rejected")
        .when(~_is_json(text), "unavailable").when(_row_count(text) == 0, "no_hits").otherwise("ok")
    )


def _json_tail(text: Column) -> Column:
    """Whether a body ends in a whole JSON list or object that starts at some bracket of it."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.substring(text, i, F.lit(1)).isin("[", "{"))
    return F.when(text.rlike(r"[\]}]\z"), F.exists(at, lambda i: _is_json(F.substring(text, i, F.length(text))))).otherwise(F.lit(False))


def classify_gene(status: Column, body: Column, nested: Column | None = None) -> Column:
    """As classify, for a service that answers 500 for unknown genes, empty bodies for unknown terms, and HTML before the JSON
    of a partial answer, which must not be read as a whole one. ``nested`` tells where rows come in lists of lists."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    page = F.when(_json_tail(text), "unavailable").when(F.contains(F.lower(text), F.lit("no summaries found")), "gene_not_annotated").otherwise("unavailable")
    return (
        F.when(status.isNull() | (status == 403), "unavailable").when(status == 500, "gene_unresolved_or_source_error").when(status >= 400, "unavailable")
        .when(text == "", "indeterminate_empty_body").when(text.startswith("<"), page)
        .when(~_is_json(text), "unavailable").when((text == "null") | (_gene_rows(text, nested) == 0), "no_hits").otherwise("ok")
    )


def _gene_rows(text: Column, nested: Column | None) -> Column:
    """An object is a row of its own here, an empty one too."""
    return F.when(text.startswith("{"), 1).otherwise(_row_count(text, nested))


def unwrap_rows(body: Column, row_schema: str) -> Column:
    """Rows of the shapes {"1": {...}}, {"Row1": {...}}, {...} and [{...}] as one array; {} has no row."""
    as_list = F.from_json(body, f"array<struct<{row_schema}>>")
    as_map = F.filter(F.map_values(F.from_json(body, f"map<string, struct<{row_schema}>>")), lambda x: x.isNotNull())
    single = F.from_json(body, f"struct<{row_schema}>")
    listed = F.ltrim(body).startswith("[")
    nested = F.ltrim(body).rlike(r'^\{\s*"(Row)?\d+"\s*:')
    none = F.slice(as_list, 1, 0)
    return F.when(listed, as_list).when(nested, as_map).when(F.trim(body).isin("{}", ""), none).otherwise(F.array(single))


def unwrap_nested(body: Column, row_schema: str, doubled: Column) -> Column:
    """Rows of [[{...}]] where ``doubled``, else of [{...}]."""
    return F.when(doubled, F.flatten(F.from_json(body, f"array<array<struct<{row_schema}>>>"))).otherwise(F.from_json(body, f"array<struct<{row_schema}>>"))


def explode_matrix(df: DataFrame, keys: list[str], data: str, sample: str = "sample", value: str = "value") -> DataFrame:
    """Metabolite rows with a map of samples as long rows; values that are no number are NULL, and stay."""
    return df.select(*keys, F.explode(data).alias(sample, "_v")).select(*keys, sample, F.when(~F.isnan(F.col("_v").try_cast("double")), F.col("_v").try_cast("double")).alias(value))


#: Fixed value: how far matched minus target may be from a stated delta.
MASS_TOLERANCE = 1e-4


def mass_rows(text: Column) -> Column:
    """Rows (target, matched, delta, rest) of a tab-separated mass table after its header. Where the tab between matched
    and delta is missing, the digits are split where |matched - target| is nearest to delta."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: (i > 0) & (F.trim(x) != ""))

    def row(line: Column) -> Column:
        cells = F.split(line, "\t")
        target, merged = cells[0].try_cast("double"), cells[1]
        sound = F.get(cells, F.lit(2)).try_cast("double").isNotNull() & merged.try_cast("double").isNotNull()
        cuts = F.filter(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(merged) - 1)), lambda k: F.struct(
                F.abs(F.abs(F.substring(merged, F.lit(1), k).try_cast("double") - target) - F.abs(F.substring(merged, k + 1, F.length(merged)).try_cast("double"))).alias("residual"),
                F.substring(merged, F.lit(1), k).try_cast("double").alias("matched"), F.substring(merged, k + 1, F.length(merged)).try_cast("double").alias("delta"))),
            lambda c: c["residual"] <= MASS_TOLERANCE)
        best = F.array_min(cuts)
        return F.struct(
            target.alias("target"), F.when(sound, merged.try_cast("double")).otherwise(best["matched"]).alias("matched"), F.when(sound, cells[2].try_cast("double")).otherwise(best["delta"]).alias("delta"),
            F.array_join(F.slice(cells, F.when(sound, F.lit(4)).otherwise(F.lit(3)), 100), "\t").alias("rest"))

    return F.transform(lines, row)


def bibliographic(df: DataFrame, source_system: str, fields: dict[str, str]) -> DataFrame:
    """Nested records as flat rows of one schema; what a source doesn't have is '' and never a guess."""
    names = ("title", "authors", "journal", "publication_year", "publication_types", "doi", "pmid", "pmcid", "abstract", "cited_by_count", "source_url")
    out = df.select(*[(F.coalesce(F.expr(fields[n]).cast("string"), F.lit("")) if n in fields else F.lit("")).alias(n) for n in names], F.lit(source_system).alias("source_system"))
    return out.withColumn("record_key", record_key(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title"), F.col("publication_year")))


def link_preprints(records: DataFrame, links: DataFrame) -> DataFrame:
    """Preprint rows take server and published DOI from their link; what other rows say of these stays."""
    l = links.select(F.lower("doi").alias("_d"), F.col("published_doi").alias("_p"), F.col("server").alias("_s")).dropDuplicates(["_d"])  # noqa: E741
    out = records.join(l, F.lower("doi") == F.col("_d"), "left")
    had = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    return out.withColumns({
        "linked_published_doi": F.coalesce("_p", had("linked_published_doi", "string")), "preprint_server": F.coalesce("_s", had("preprint_server", "string")),
        "is_preprint": F.col("_d").isNotNull() | F.coalesce(had("is_preprint", "boolean"), F.lit(False)),
    }).drop("_d", "_p", "_s")


def retrieval_state(pages: DataFrame) -> DataFrame:
    """Per source: pages, rows, reported hits and whether the pages are complete. A failed page makes a source truncated."""
    by = pages.groupBy("source_system").agg(F.count("*").alias("pages"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum(F.when(F.col("status") == "ok", F.col("rows")).otherwise(0)).alias("retrieved"), F.max("reported_hits").alias("reported_hits"))
    state = F.when(F.col("failed") == F.col("pages"), "unavailable").when((F.col("failed") > 0) | (F.col("retrieved") < F.col("reported_hits")), "truncated").otherwise("complete")
    return by.withColumn("state", state)


def phrase_query(names: list[str], context: list[str], field: str | None = None) -> str:
    """Name variants OR-ed as phrases, context terms AND-ed; a field makes it the tagged dialect."""
    tag = f"[{field}]" if field else ""
    quote = lambda t: '"' + t.replace('"', " ").strip() + '"' + tag
    named = " OR ".join(dict.fromkeys(quote(n) for n in names if n.strip()))
    return " AND ".join([f"({named})", *dict.fromkeys(quote(c) for c in context if c.strip())])
