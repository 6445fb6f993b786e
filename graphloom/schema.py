"""Fixed schemas of the fact tables and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 12
NODES = "id string, symbol_id string, label string, kind string, qualified_name string, package string, source_file string, source_location string, module string, scope string, javadoc string, metadata string"
EDGES = "eid string, source_id string, target_id string, external_target_fqn string, relation string, call_kind string, confidence string, resolution string, context string, is_external boolean, source_file string, source_location string, metadata string"
ANNOTATIONS = "node_id string, annotation_fqn string, attributes string"
DOCUMENTS = "path string, title string, content string, doc_type string, module string"
SEMANTIC = "id string, node_id string, doc_id string, category string, business_label string, business_description string, source string, confidence string"
FILE_CACHE = "source_file string, hash string, file_size long, file_mtime_ns long, contract_hash string"
DIAGNOSTICS = "severity string, code string, phase string, source_file string, module string, scope string, symbol string, occurrence_count long, sample string"
FLOW_NODES = "id string, method_id string, kind string, label string, source_file string, module string, scope string, line int, column_no int, callee_method string, slot string"
FLOW_EDGES = "id string, source_node string, target_node string, relation string, method_id string, source_file string, confidence string, context string"

TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION", "ANONYMOUS_CLASS")
METHOD_KINDS = ("METHOD", "CONSTRUCTOR")
BODY_KINDS = ("ANONYMOUS_CLASS", "LAMBDA", "METHOD_REF")
SCOPES = ("MAIN", "TEST", "GENERATED")
DEPENDENCY = ("CALLS", "REFERENCES", "READS", "WRITES", "INHERITS", "IMPLEMENTS")
PACKAGE_DEPENDENCY = ("CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS", "INJECTS")
FRAMEWORK = ("INJECTS", "WIRES", "HANDLES", "DEFINED_BY", "CONFIGURES")
LOOPS = ("for", "foreach", "while", "do")
BRANCHES = ("if-then", "if-else", "case", "default", "ternary-then", "ternary-else", "catch")
DATA_FLOW = ("DEF_USE", "ARGUMENT_FLOW", "RETURN_FLOW", "CALL_ARGUMENT", "CALL_RETURN", "TAINT_FLOW")
CONTROL_FLOW = ("CONTROL_FLOW", "CONDITION_FLOW", "GUARD_TRUE", "GUARD_FALSE")


def violations(edges: DataFrame) -> DataFrame:
    """Edges that break the rule: internal ones have a target and no external name, external ones
    the reverse."""
    internal = ~F.col("is_external") & F.col("target_id").isNotNull() & F.col("external_target_fqn").isNull()
    external = F.col("is_external") & F.col("target_id").isNull() & F.col("external_target_fqn").isNotNull()
    return edges.where(~F.coalesce(internal | external, F.lit(False)))


def check_version(found: int) -> None:
    if found != SCHEMA_VERSION:
        raise ValueError(f"tables of schema {found} can't be read by schema {SCHEMA_VERSION}: build them anew")
