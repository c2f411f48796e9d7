"""Entity schemas, allowed values and sentinel sets. NULL always means "not documented", never "no"."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "b": T.BooleanType(), "i": T.IntegerType(), "d": T.DoubleType(), "as": T.ArrayType(T.StringType()), "dec": T.DecimalType(10, 6)}


def struct(spec: str) -> T.StructType:
    """``"study_id:s human:b"`` as a StructType."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (part.split(":") for part in spec.split())])


PUBLICATION = struct("study_id:s title:s doi:s pmid:s human:b exercise:b actigraphy:b metabolomics:b genetics:b cpet:b body_composition:b diet:b repository_accession:s notes:s")
REPOSITORY = struct("study_id:s repository:s accession:s public_status:s has_metadata:b has_codebook:b has_data_files:b assay_platform:s sample_matrix:s biospecimen_timing:s sample_size:i modalities:as documented_absent_modalities:as")
STUDY_CARD = struct("study_id:s human:b modalities:as")
DATASET_CARD = struct("study_id:s dataset_id:s has_metadata:b has_codebook:b has_data_files:b assay_platform:s sample_matrix:s biospecimen_timing:s sample_size:i modalities:as documented_absent_modalities:as")
VARIABLE_CARD = struct("study_id:s source_variable:s label:s unit:s timing:s modality:s description:s")
VARIABLE_MAPPING = struct("source_study:s source_variable:s source_label:s source_unit:s source_timing:s source_modality:s proposed_common_variable:s proposed_common_unit:s transform:s confidence:d evidence:s review_status:s")
QUALITY_GOLD = struct("study_id:s overall_score:dec scope_status:s")
MAPPING_GOLD = struct("source_study:s source_variable:s common_variable:s review_status:s")
EFFECT = struct("metabolite:s refmet_name:s log2fc:d p_value:d fdr:d platform:s sex:s refmet_id:s")
CONTRAST = struct("contrast_id:s numerator_label:s denominator_label:s effect_scale:s fdr_method:s fdr_scope:s source_study_id:s source_dataset_id:s tissue:s assay:s platform:s exercise_group:s alpha:d effect_threshold:d display_order:i")

# Sentinel sets differ by operator and must stay apart.
MIRAGE_UNKNOWN = ("", "unknown", "not_available", "not_reported")
QUALITY_UNREPORTED = ("", "unknown", "not_reported")
ACCESSION_UNKNOWN = ("", "unknown", "not_available", "not_reported")
ASSAY_MISSING = ("", "unknown", "not_reported", "not_available", "none")
PLOT_MISSING = ("", "na", "nan", "none", "null", "not_reported", "unknown")
EFFECT_MISSING = ("", "nan", "na", "none")
LABEL_MISSING = ("", "na", "nan", "none", "null")

# Allowed values of enumerated columns.
REVIEW_STATUS = ("accepted", "requires_human_review", "rejected")
AVAILABILITY = ("public", "restricted_metadata_only", "not_available", "unknown")
RECOMMENDATION_CLASS = ("direct_match", "enrichment_candidate", "complementary", "mirage", "excluded")
SCOPE_STATUS = ("in_scope_human", "out_of_scope_non_human", "human_status_unknown")
MODALITY_FLAGS = ("metabolomics", "exercise", "actigraphy", "genetics", "cpet", "body_composition", "diet")
