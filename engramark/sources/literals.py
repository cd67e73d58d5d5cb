"""Workloads that are stated value by value: relation names and a small multi-tenant stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.sources.generators import WORKLOADS, literal_forms

# The forms of each relation, in order.
RELATIONS = {
    "IsA": ["IsA", "is_a", "IS_A", "INSTANCE_OF", "type_of", "kind_of"],
    "PartOf": ["PartOf", "part_of", "PART_OF", "member_of", "belongs_to"],
    "HasA": ["HasA", "has_a", "HAS_A", "has_part", "contains_part"],
    "UsedFor": ["UsedFor", "used_for", "USED_FOR", "purpose_of", "function_of"],
    "CapableOf": ["CapableOf", "capable_of", "CAPABLE_OF", "can_do", "ABILITY_TO"],
    "AtLocation": ["AtLocation", "at_location", "AT_LOCATION", "located_at", "found_at"],
    "Causes": ["Causes", "causes", "CAUSES", "leads_to", "results_in", "produces"],
    "HasSubevent": ["HasSubevent", "has_subevent", "HAS_SUBEVENT", "includes_step"],
    "HasFirstSubevent": ["HasFirstSubevent", "has_first_subevent", "starts_with_step"],
    "HasLastSubevent": ["HasLastSubevent", "has_last_subevent", "ends_with_step"],
    "HasPrerequisite": ["HasPrerequisite", "has_prerequisite", "REQUIRES", "depends_on"],
    "HasProperty": ["HasProperty", "has_property", "HAS_PROPERTY", "has_attribute"],
    "MotivatedByGoal": ["MotivatedByGoal", "motivated_by_goal", "driven_by_goal"],
    "ObstructedBy": ["ObstructedBy", "obstructed_by", "blocked_by", "hindered_by"],
    "Desires": ["Desires", "desires", "DESIRES", "wants", "wishes_for"],
    "CreatedBy": ["CreatedBy", "created_by", "CREATED_BY", "made_by", "authored_by"],
    "Synonym": ["Synonym", "synonym", "SYNONYM", "same_as", "equivalent_to"],
    "Antonym": ["Antonym", "antonym", "ANTONYM", "opposite_of"],
    "DistinctFrom": ["DistinctFrom", "distinct_from", "different_from"],
    "DerivedFrom": ["DerivedFrom", "derived_from", "originates_from"],
    "SymbolOf": ["SymbolOf", "symbol_of", "represents"],
    "DefinedAs": ["DefinedAs", "defined_as", "is_defined_as"],
    "MannerOf": ["MannerOf", "manner_of", "way_of"],
    "LocatedNear": ["LocatedNear", "located_near", "near", "close_to"],
    "HasContext": ["HasContext", "has_context", "in_context_of"],
    "SimilarTo": ["SimilarTo", "similar_to", "resembles"],
    "EtymologicallyRelatedTo": ["EtymologicallyRelatedTo", "etymologically_related"],
    "EtymologicallyDerivedFrom": ["EtymologicallyDerivedFrom", "etymologically_derived_from"],
    "CausesDesire": ["CausesDesire", "causes_desire", "makes_want"],
    "MadeOf": ["MadeOf", "made_of", "MADE_OF", "composed_of", "consists_of"],
    "ReceivesAction": ["ReceivesAction", "receives_action", "acted_upon_by"],
    "ExternalURL": ["ExternalURL", "external_url", "EXTERNAL_LINK"],
    "RelatedTo": ["RelatedTo", "related_to", "RELATED_TO", "associated_with"],
    "FormOf": ["FormOf", "form_of", "variant_of"],
}

# Source, form and canonical of each write, in order.
TENANTS = [
    ("sales", "Apple", "Apple_Inc"),
    ("sales", "AAPL", "Apple_Inc"),
    ("marketing", "Apple", "Apple_Inc"),
    ("marketing", "Apple Computer", "Apple_Inc"),
    ("ops", "Apple", "Apple_Supplier_Inc"),
    ("ops", "Apple Foods", "Apple_Supplier_Inc"),
    ("sales", "Microsoft", "Microsoft_Corp"),
    ("sales", "MSFT", "Microsoft_Corp"),
    ("ops", "Microsoft", "Microsoft_Corp"),
    ("ops", "Microsoft Corp", "Microsoft_Corp"),
    ("marketing", "Microsoft", "Microsoft_Corp"),
    ("sales", "Tesla", "Tesla_Inc"),
    ("marketing", "Tesla", "Tesla_Inc"),
    ("marketing", "Tesla Motors", "Tesla_Inc"),
    ("ops", "Acme Logistics", "Acme_Supplier"),
    ("ops", "Acme", "Acme_Supplier"),
    ("marketing", "Nike", "Nike_Brand"),
    ("marketing", "Nike Inc", "Nike_Brand"),
    ("sales", "Salesforce", "Salesforce_Inc"),
    ("sales", "SFDC", "Salesforce_Inc"),
    ("sales", "IBM", "IBM_Corp"),
    ("sales", "International Business Machines", "IBM_Corp"),
    ("marketing", "IBM", "IBM_Corp"),
    ("sales", "Amazon", "Amazon_Inc"),
    ("sales", "AMZN", "Amazon_Inc"),
    ("ops", "Amazon", "Amazon_Logistics_Partner"),
    ("ops", "Amazon Delivery", "Amazon_Logistics_Partner"),
    ("sales", "Google", "Google_LLC"),
    ("marketing", "Google", "Google_LLC"),
    ("ops", "Google", "Google_LLC"),
    ("sales", "Oracle", "Oracle_Corp"),
    ("sales", "Oracle Database", "Oracle_Corp"),
    ("ops", "Acme Corp", "Acme_Supplier"),
]


def relations(spark: SparkSession) -> DataFrame:
    """seq, source_id, input, oracle of every relation's forms; one source, ``default``."""
    return literal_forms(spark, {"default": RELATIONS})


def tenants(spark: SparkSession) -> DataFrame:
    """seq, source_id, input, oracle of writes by three sources; oracles are global, some forms mean different ones by source."""
    rows = [(k, *row) for k, row in enumerate(TENANTS)]
    return spark.createDataFrame(rows, "seq long, source_id string, input string, oracle string")


#: A canonical of several strata belongs to the first of these.
STRATA = ("global", "partial", "conditional")

Entry = tuple[str, str, dict[str, list[str]]]


def stratum_of(oracle: Column, entries: list[Entry]) -> Column:
    """The stratum of a canonical in entries (stratum, canonical, forms by source); ``unknown`` where it is in none."""
    found: dict[str, str] = {}
    for stratum, canonical, _ in sorted(entries, key=lambda e: STRATA.index(e[0])):
        found.setdefault(canonical, stratum)
    pairs = [F.lit(x) for pair in found.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[oracle], F.lit("unknown")) if pairs else F.lit("unknown")


def stratified(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """seq, source_id, input, oracle, stratum of entries (stratum, canonical, forms by source), stratum after stratum, in their order within each."""
    ordered = sorted(entries, key=lambda e: STRATA.index(e[0]))
    rows = [(source, form, canonical) for _, canonical, by in ordered for source, forms in by.items() for form in forms]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "seq long, source_id string, input string, oracle string")
    return df.withColumn("stratum", stratum_of(F.col("oracle"), entries))


WORKLOADS.register("relations", relations)
WORKLOADS.register("tenants", tenants)
