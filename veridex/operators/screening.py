"""Screening of bibliographic records: entity dedup, text flags, evidence tier, species, class, escalations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import compact, when_flag
from ..functions.text import accessions, matches_any, name_in_text

# Pattern banks, matched in lower-case text of title, abstract, journal and notes.
BANKS = {
    "human": (r"\bhuman(s|)\b", r"\bmen\b", r"\bwomen\b", r"\bparticipants?\b", r"\bsubjects?\b", r"\bpatients?\b", r"\bathletes?\b", r"\bvolunteers?\b", r"\bcohort\b", r"\bhomo sapiens\b"),
    "rodent": (r"\bmice\b", r"\bmouse\b", r"\brats?\b", r"\bmurine\b", r"\brodents?\b", r"\bc57bl\b"),
    "other_animal": (r"\bzebrafish\b", r"\bhorses?\b", r"\bequine\b", r"\bcanine\b", r"\bdogs?\b", r"\bpigs?\b", r"\bporcine\b", r"\bbovine\b", r"\bcows?\b", r"\bsheep\b", r"\bmacaques?\b", r"\bmonkeys?\b", r"\bdrosophila\b", r"\bc\. elegans\b"),
    "in_vitro": (r"\bin vitro\b", r"\bcell lines?\b", r"\bmyotubes?\b", r"\bhek293\b", r"\bhepg2\b", r"\brecombinant enzyme\b", r"\bcell culture\b"),
    "metabolomics": (r"\bmetabolom", r"\bmetabolite", r"\bmass spectrometry\b", r"\blc-?ms\b", r"\bgc-?ms\b", r"\bnmr\b", r"\buntargeted\b", r"\btargeted panel\b", r"\blipidom"),
    "exercise": (r"\bexercise\b", r"\btraining\b", r"\bphysical activity\b", r"\bendurance\b", r"\bresistance training\b", r"\bsprint\b", r"\bcycling\b", r"\brunning\b", r"\btreadmill\b", r"\bhiit\b", r"\bathletic performance\b", r"\bexertion\b"),
    "genetics": (r"\bgenetic", r"\bgwas\b", r"\bgenome-wide\b", r"\bsnp\b", r"\bheritab", r"\bpolygenic\b", r"\bmendelian randomi"),
    "cpet": (r"\bvo2\s?max\b", r"\bvo2peak\b", r"\bcardiopulmonary exercise test", r"\bcpet\b", r"\bpeak oxygen uptake\b"),
    "actigraphy": (r"\bactigraph", r"\baccelerometer", r"\bwearable", r"\bstep count", r"\bfitness tracker"),
    "body_composition": (r"\bbody composition\b", r"\bdexa\b", r"\bdxa\b", r"\bfat mass\b", r"\blean mass\b", r"\bbmi\b", r"\badiposity\b"),
    "diet": (r"\bdiet", r"\bnutrition", r"\bfeeding\b", r"\bfood intake\b", r"\bcaloric\b", r"\bfasting\b"),
    "biological": (r"\bmetabolom", r"\bmetabolite", r"\bplasma\b", r"\bserum\b", r"\bwhole blood\b", r"\burine\b", r"\bmuscle\b", r"\bexercise\b", r"\bphysical activity\b", r"\blactate\b", r"\blactic acid\b", r"\bcndp2\b", r"\bappetite\b", r"\bfood intake\b", r"\bobesity\b", r"\bmice\b", r"\bhuman", r"\bpharmacokinetic"),
    "material": (r"\bcopolymer", r"\bpolymer", r"\bpolylactide\b", r"\bpoly\(lact", r"\bscaffold", r"\bhydrogel", r"\bnanoparticle", r"\bmicelle", r"\bresin\b", r"\bcoating\b", r"\btissue engineering\b", r"\bdrug delivery\b"),
}
MODALITIES = ("human", "exercise", "metabolomics", "genetics", "cpet", "actigraphy", "body_composition", "diet")
DESIGNS = (
    ("randomized_controlled_trial", (r"\brandomi[sz]ed controlled trial\b", r"\brandomi[sz]ed\b.*\btrial\b", r"\brct\b")),
    ("interventional_exercise_bout_or_program", (r"\bacute (bout|exercise)\b", r"\bexercise (intervention|program|protocol|bout)\b", r"\btraining (intervention|program|study)\b", r"\bpre-?\s?and\s?post-?exercise\b")),
    ("observational_cohort_or_cross_sectional", (r"\bcohort\b", r"\bcross-?sectional\b", r"\bobservational\b", r"\bpopulation-based\b")),
    ("preclinical_experiment", (r"\bknockout\b", r"\bko mice\b", r"\bwild-?type\b", r"\btreadmill running in (mice|rats)\b")),
)
CLASS_ORDER = ("direct_human_exercise", "human_non_exercise_context", "animal_or_invitro_mechanistic", "secondary_synthesis", "screening_uncertain_insufficient_text", "non_relevant_context", "not_primary_evidence")


def text_flag(hit: Column, has_abstract: Column, structured: Column | None = None) -> Column:
    """A flag with its basis; a text sweep without an abstract establishes nothing."""
    found = F.when(hit, "yes:text_inference").when(has_abstract, "no_signal:text_inference").otherwise("unknown:no_abstract_text")
    return found if structured is None else F.when(structured.isNull(), found).when(structured, "yes:structured_field").otherwise("no:structured_field")


def evidence_tier(types: Column, is_preprint: Column, published_doi: Column) -> Column:
    t = F.lower(F.coalesce(types, F.lit("")))
    return (
        F.when(is_preprint & (F.coalesce(F.trim(published_doi), F.lit("")) != ""), "preprint_later_published").when(is_preprint, "preprint_not_peer_reviewed")
        .when(t.rlike("retract"), "retracted_or_retraction_notice").when(t.rlike("correction|erratum"), "correction_or_erratum")
        .when(t.rlike("review|meta-analysis|systematic"), "peer_reviewed_secondary_synthesis").when(t.rlike("editorial|comment|news|letter"), "editorial_or_commentary")
        .when(t.rlike("journal-article|journal article|research-article|research support|clinical trial"), "peer_reviewed_primary").otherwise("unknown_publication_type")
    )


def screen(records: DataFrame, subject_terms: tuple[str, ...] = ()) -> DataFrame:
    """Classify deduplicated records.

    Reads title, abstract, journal, notes, publication_types, is_preprint (boolean), linked_published_doi and
    has_conflicts (boolean). Adds a flag per modality, species_scope, evidence_tier, intervention_design, accessions,
    subject_term_evidence, homonym_risk, screen_class and review_status.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat_ws(" ", blank("title"), blank("abstract"), blank("journal"), blank("notes"))
    rows = records.withColumn("_raw", raw).withColumn("_text", F.lower(raw)).withColumn("abstract_available", F.trim(blank("abstract")) != "")
    rows = rows.withColumns({f"_{b}": matches_any(F.col("_text"), p) for b, p in BANKS.items()})
    rows = rows.withColumns({f"{m}_evidence": text_flag(F.col(f"_{m}"), F.col("abstract_available")) for m in MODALITIES})
    human, animal = F.col("_human"), F.col("_rodent") | F.col("_other_animal")
    species = F.when(human & animal, "human_and_animal").when(human, "human").when(F.col("_rodent"), "rodent").when(F.col("_other_animal"), "other_animal").when(F.col("_in_vitro"), "in_vitro_or_enzymatic").otherwise("not_stated_in_retrieved_text")
    design = F.coalesce(*[F.when(matches_any(F.col("_text"), p), F.lit(n)) for n, p in DESIGNS], F.lit("not_stated_in_retrieved_text"))
    rows = rows.withColumns({"species_scope": species, "evidence_tier": evidence_tier(F.col("publication_types"), F.col("is_preprint"), F.col("linked_published_doi")), "intervention_design": design, "accessions": accessions(F.col("_raw"))})
    if subject_terms:
        inside = lambda c: F.greatest(*[name_in_text(F.lit(t), F.col(c)).cast("int") for t in subject_terms], F.lit(0)) == 1
        subject = F.when(inside("title"), "subject_name_in_title").when(inside("abstract"), "subject_name_in_abstract").when(F.col("abstract_available"), "subject_name_absent_from_title_and_abstract").otherwise("unknown_no_abstract_retrieved")
        located = subject.isin("subject_name_in_title", "subject_name_in_abstract")
        homonym = F.when(~located, "not_assessed_subject_name_not_located").when(F.col("_material") & ~F.col("_biological"), "flagged_non_metabolite_homonym_context").when(F.col("_material"), "mixed_material_and_biological_context").otherwise("no_homonym_signal")
    else:
        subject = homonym = F.lit("not_applicable_no_subject_term_declared")
    rows = rows.withColumns({"subject_term_evidence": subject, "homonym_risk": homonym})
    tier = F.col("evidence_tier")
    kind = (
        F.when(tier.isin("retracted_or_retraction_notice", "correction_or_erratum", "editorial_or_commentary"), "not_primary_evidence")
        .when(~F.col("abstract_available") & ~F.col("_metabolomics") & ~F.col("_exercise"), "screening_uncertain_insufficient_text")
        .when(tier == "peer_reviewed_secondary_synthesis", "secondary_synthesis")
        .when(F.col("species_scope").isin("rodent", "other_animal", "in_vitro_or_enzymatic") & ~human, "animal_or_invitro_mechanistic")
        .when(human & F.col("_exercise"), "direct_human_exercise").when(human, "human_non_exercise_context")
        .when(F.col("species_scope") == "not_stated_in_retrieved_text", "screening_uncertain_insufficient_text").otherwise("non_relevant_context")
    )
    rows = rows.withColumn("screen_class", kind)
    review = (
        F.col("screen_class").isin("screening_uncertain_insufficient_text", "direct_human_exercise") | F.col("has_conflicts") | tier.isin("preprint_not_peer_reviewed", "unknown_publication_type", "retracted_or_retraction_notice")
        | F.col("homonym_risk").isin("flagged_non_metabolite_homonym_context", "mixed_material_and_biological_context") | (F.col("subject_term_evidence") == "subject_name_absent_from_title_and_abstract")
    )
    return rows.withColumn("review_status", F.when(review, "requires_human_review").otherwise("advisory_only")).drop("_raw", "_text", *[f"_{b}" for b in BANKS])


def escalations(screened: DataFrame, key: str) -> DataFrame:
    """One row for each reason to ask a person, from one pass."""
    kinds = compact(
        when_flag(F.col("screen_class") == "screening_uncertain_insufficient_text", "unscreenable_record"),
        when_flag(F.col("has_conflicts"), "cross_source_metadata_conflict"),
        when_flag(F.col("evidence_tier") == "preprint_not_peer_reviewed", "preprint_without_peer_review"),
        when_flag(F.col("evidence_tier") == "retracted_or_retraction_notice", "retraction_flag_in_publication_type"),
        when_flag(F.col("homonym_risk").isin("flagged_non_metabolite_homonym_context", "mixed_material_and_biological_context"), "possible_name_homonym"),
        when_flag(F.col("subject_term_evidence") == "subject_name_absent_from_title_and_abstract", "subject_name_not_located_in_record"),
        when_flag((F.col("screen_class") == "direct_human_exercise") & (F.size("accessions") == 0), "unresolved_data_deposition"),
    )
    return screened.select(key, F.explode(kinds).alias("escalation"))


# Evidence that names the subject, and designs that can replicate a finding.
SUBJECT_CONFIRMED = ("subject_name_in_title", "subject_name_in_abstract")
REPLICATION_DESIGNS = ("randomized_controlled_trial", "interventional_exercise_bout_or_program")


def literature_stats(screened: DataFrame, key: str) -> DataFrame:
    """(metric, value, n) of screened records: counts, confirmed records by class, distinct years of the confirmed ones, and
    escalations of each kind with their total. A count that is 0 is a row; years and kinds have rows where they occur."""
    confirmed = F.col("subject_term_evidence").isin(*SUBJECT_CONFIRMED)
    kind, tier = F.col("screen_class"), F.col("evidence_tier")
    human = confirmed & (kind == "direct_human_exercise")
    primary = human & (tier == "peer_reviewed_primary")
    counts = {
        "record_count": F.lit(True), "confirmed_count": confirmed, "human_exercise_count": human, "human_exercise_primary_count": primary, "replication_count": primary & F.col("intervention_design").isin(*REPLICATION_DESIGNS),
        "mechanistic_count": confirmed & (kind == "animal_or_invitro_mechanistic"), "reviews_count": confirmed & (kind == "secondary_synthesis"), "non_exercise_count": confirmed & (kind == "human_non_exercise_context"),
        "retracted_count": tier == "retracted_or_retraction_notice", "preprint_count": tier == "preprint_not_peer_reviewed", "human_exercise_with_accession": human & (F.size("accessions") > 0),
        "subject_absent": F.col("subject_term_evidence") == "subject_name_absent_from_title_and_abstract", "no_abstract": F.col("subject_term_evidence") == "unknown_no_abstract_retrieved",
        "homonym_flagged": F.col("homonym_risk") == "flagged_non_metabolite_homonym_context", "homonym_mixed": F.col("homonym_risk") == "mixed_material_and_biological_context", "uncertain_total": kind == "screening_uncertain_insufficient_text",
    }
    row = screened.agg(*[F.count_if(c).alias(m) for m, c in counts.items()])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("value"), F.col(m).alias("n")) for m in counts])).alias("x")).select("x.*")
    year = F.nullif(F.trim("publication_year"), F.lit(""))
    years = screened.filter(confirmed & year.isNotNull()).groupBy(year.alias("value")).agg(F.count("*").alias("n")).select(F.lit("year").alias("metric"), "value", "n")
    raised = escalations(screened, key)
    kinds = raised.groupBy(F.col("escalation").alias("value")).agg(F.count("*").alias("n")).select(F.lit("escalation").alias("metric"), "value", "n")
    total = raised.agg(F.count("*").alias("n")).select(F.lit("escalation_total").alias("metric"), F.lit(None).cast("string").alias("value"), "n")
    return out.unionByName(years).unionByName(kinds).unionByName(total)


def source_escalations(sources: DataFrame) -> DataFrame:
    """Escalations of retrieval: unavailable is not zero hits, truncated is not complete."""
    kind = F.when(F.col("status") == "unavailable", "retrieval_source_unavailable").when((F.col("status") == "ok") & ~F.coalesce("pagination_complete", F.lit(False)), "retrieval_truncated")
    return sources.select(F.concat(F.lit("source:"), "source_system").alias("record_key"), kind.alias("escalation")).filter("escalation is not null")


# Phrases in which an exercise word means something else, taken out of a title one after another.
AMBIGUOUS_PHRASES = (
    ("training_set_ml", r"\btraining\s*set\b"),
    ("biosignature_training_ml", r"\bbiosignature\s+training\b"),
    ("fitness_biological_sense", r"\bfitness\s+to\s+hypoxia\b"),
    ("breathing_exercises", r"\bbreathing\s+exercises?\b"),
)
# Exercise terms, sought in what is left.
EXERCISE_TERMS = (
    ("exercise", r"\bexercis(?:e|es|ed|ing)\b"),
    ("post_exercise", r"\bpost[- ]exercise\b"),
    ("exercise_induced", r"\bexercise[- ]induced\b"),
    ("training", r"\btraining\b"),
    ("training_induced", r"\btraining[- ]induced\b"),
    ("athlete", r"\bathlet\w*"),
    ("sport", r"\bsports?\b"),
    ("endurance", r"\bendurance\b"),
    ("hiit_or_interval", r"\bhiit\b|\bhigh[- ]intensity\s+interval\b"),
    ("physical_activity", r"\bphysical\s+activity\b"),
    ("cardiorespiratory_fitness", r"\bcardiorespiratory\s+fitness\b"),
    ("marathon_running_cycling", r"\bmarathon\b|\brunning\b|\bcycling\b"),
    ("resistance_training", r"\bresistance\s+training\b"),
)
# Fixed value: the sweep that the screened titles were retrieved by.
RETRIEVAL_SWEEP = r"exercis|train|fitness|sport|athlet|cardio"


def title_screen(title: Column) -> Column:
    """(class, terms, phrases, sweep) of a title: its inference class, the terms and ambiguous phrases in it, joined by ";"."""
    left, phrases = F.coalesce(title, F.lit("")), []
    for name, pattern in AMBIGUOUS_PHRASES:
        phrases.append(F.when(left.rlike(f"(?iu){pattern}"), F.lit(name)))
        left = F.regexp_replace(left, f"(?iu){pattern}", " ")
    terms = [F.when(left.rlike(f"(?iu)(?:{pattern})"), F.lit(name)) for name, pattern in EXERCISE_TERMS]
    some = lambda found: reduce(lambda a, b: a | b, [c.isNotNull() for c in found])
    kind = F.when(some(terms), "title_supports_exercise_context").when(some(phrases), "title_ambiguous_term_only").otherwise("title_no_exercise_term")
    sweep = F.coalesce(title.rlike(f"(?iu){RETRIEVAL_SWEEP}"), F.lit(False))
    return F.struct(kind.alias("class"), F.concat_ws(";", *terms).alias("terms"), F.concat_ws(";", *phrases).alias("phrases"), sweep.alias("sweep"))


# What a study's metadata says of it, in lower-cased text.
PUBLICATION_FLAGS = {
    "human": (r"\bhomo sapiens\b", r"\bhuman\b"),
    "exercise": (r"\bexercise\b", r"\bendurance\b", r"\bresistance\b", r"\btraining\b", r"\btreadmill\b", r"\brun\b", r"\brunning\b"),
    "actigraphy": (r"\bactigraphy\b", r"\bacceleromet"),
    "genetics": (r"\bgenetic", r"\bgenomic", r"\bgenotype"),
    "cpet": (r"\bcpet\b", r"cardiopulmonary", r"\bvo2", r"oxygen consumption"),
    "body_composition": (r"body composition", r"\bdxa\b", r"\bfat mass\b", r"\blean mass\b"),
    "diet": (r"\bdiet\b", r"\bnutrition\b", r"\bfood\b"),
}


def publication_flags(*parts: Column) -> dict[str, Column]:
    """Flags of a study from all parts of its metadata; every study of the repository is a metabolomics one."""
    low = F.lower(F.concat_ws(" ", *parts))
    return {name: matches_any(low, patterns) for name, patterns in PUBLICATION_FLAGS.items()} | {"metabolomics": F.lit(True)}
