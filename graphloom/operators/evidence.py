"""Coverage, evidence, health, diagnostics and the cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPABILITIES = ("DECLARATION", "CALL_OUTGOING", "CALL_INCOMING", "CALL_PATH", "TYPE_OUTGOING", "TYPE_INCOMING", "REFERENCE_OUTGOING", "REFERENCE_INCOMING", "FIELD_ACCESS", "WIRING", "FLOW", "AGGREGATE")
#: which capabilities a phase's diagnostics touch
RELEVANCE = {
    "parse": CAPABILITIES,
    "resolve_call": ("CALL_OUTGOING", "CALL_INCOMING", "CALL_PATH", "FLOW", "AGGREGATE"),
    "resolve_type": ("TYPE_OUTGOING", "TYPE_INCOMING", "REFERENCE_OUTGOING", "REFERENCE_INCOMING", "WIRING"),
    "resolve_field": ("FIELD_ACCESS", "FLOW"),
    "flow": ("FLOW",),
}


def coverage(diagnostics: DataFrame) -> DataFrame:
    """(source_file, module, scope, capability, status, occurrences, groups_count, codes, code_counts):
    diagnostics spread over the capabilities they touch; blanks count as *."""
    spark = diagnostics.sparkSession
    table = spark.createDataFrame([(p, c) for p, cs in RELEVANCE.items() for c in cs], "phase string, capability string")
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("*")).otherwise(F.col(c)).alias(c)
    own = diagnostics.where("severity <> 'info'").join(F.broadcast(table), "phase").select(blank("source_file"), blank("module"), blank("scope"), "capability", "severity", "code", F.col("occurrence_count").alias("n"))
    one = own.groupBy("source_file", "module", "scope", "capability", "code").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.max((F.col("severity") == "error").cast("int")).alias("bad"))
    pairs = F.array_sort(F.collect_list(F.struct("code", "n")))
    return one.groupBy("source_file", "module", "scope", "capability").agg(
        F.when(F.max("bad") == 1, F.lit("failed")).otherwise(F.lit("partial")).alias("status"), F.sum("n").alias("occurrences"), F.sum("g").alias("groups_count"),
        F.array_sort(F.collect_set("code")).alias("codes"), F.map_from_entries(pairs).alias("code_counts"),
    )


def evidence(found: DataFrame, gaps: DataFrame, capabilities: list[str]) -> DataFrame:
    """(status, gaps, occurrences, code_counts) of an answer: found, found_incomplete,
    confirmed_empty or inconclusive, by whether it has rows and whether what it needed has gaps."""
    own = gaps.where(F.col("capability").isin(*capabilities) & (F.col("status") != "complete"))
    sums = own.select(F.explode("code_counts").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n"))
    codes = sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("code_counts"))
    a = own.agg(F.countDistinct("source_file", "module", "scope", "capability").alias("gaps"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    b = found.limit(1).agg((F.count("*") > 0).alias("any"))
    status = F.when(F.col("any"), F.when(F.col("gaps") > 0, "found_incomplete").otherwise("found")).otherwise(F.when(F.col("gaps") > 0, "inconclusive").otherwise("confirmed_empty"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(codes)).select(status.alias("status"), "gaps", "occurrences", "code_counts")


def health(diagnostics: DataFrame, policy: str = "error") -> DataFrame:
    """(phase, groups, occurrences, worst, blocking): per dimension, with the codes that the policy
    (error, warning or none) doesn't let pass."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    least = {"error": 2, "warning": 1, "none": 3}[policy]
    return diagnostics.withColumn("r", rank).groupBy("phase").agg(F.count("*").alias("groups"), F.sum("occurrence_count").alias("occurrences"), F.max("r").alias("worst"), F.array_sort(F.collect_set(F.when(F.col("r") >= least, F.col("code")))).alias("blocking"))


def retain(diagnostics: DataFrame, most: int = 5000) -> DataFrame:
    """At most most diagnostics: one of each code first, then by severity and count; what is left out
    is one more row. The rank within a code comes first, so only the best of each code compete."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = [rank, F.desc("occurrence_count"), F.col("source_file"), F.col("symbol")]
    first = diagnostics.withColumn("__c", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("__c") <= most)
    kept = first.orderBy(F.col("__c") > 1, *order, "code").limit(most)
    total = diagnostics.agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("o"))
    mine = kept.agg(F.count("*").alias("kn"), F.sum("occurrence_count").alias("ko"))
    rest = total.crossJoin(F.broadcast(mine)).where("n > kn")
    none = F.lit(None).cast("string")
    over = rest.select(*[{"severity": F.lit("info"), "code": F.lit("DIAGNOSTICS_TRUNCATED"), "occurrence_count": (F.col("o") - F.col("ko")).cast("long")}.get(c, none).alias(c) for c in diagnostics.columns])
    return kept.select(*diagnostics.columns).unionByName(over)


def resolution_failures(failures: DataFrame) -> DataFrame:
    """Failed resolutions (source_file, module, scope, phase, symbol, message, line) by reason, found
    by the first rule that holds; only failures within the graph or the platform are warnings."""
    m, s = F.lower(F.coalesce("message", F.lit(""))), F.coalesce("symbol", F.lit(""))
    reason = (
        F.when(m.contains("unsupported"), "UNSUPPORTED").when(m.contains("ambiguous"), "AMBIGUOUS").when(m.contains("type parameter") | s.rlike("^[A-Z]$"), "GENERIC")
        .when(F.col("phase") == "resolve_field", "FIELD").when(m.contains("unsolved method"), "METHOD").when(s.rlike(r"^(java|javax)\."), "PLATFORM")
        .when(s.startswith(F.concat(F.coalesce("module", F.lit("?")), F.lit("."))), "INTERNAL").when(s.contains("."), "THIRD_PARTY").otherwise("OTHER")
    )
    own = failures.withColumn("reason", reason).withColumn("severity", F.when(F.col("reason").isin("INTERNAL", "PLATFORM"), "warning").otherwise("info"))
    return own.groupBy("source_file", "module", "scope", "phase", "reason", "severity", "symbol", "line").agg(F.count("*").alias("occurrences"))


def bounded_failures(failures: DataFrame, most: int = 5000) -> DataFrame:
    """resolution_failures() of at most most groups, those of most occurrences first, then by place;
    all others are one more row, DIAGNOSTIC_LIMIT_REACHED, so that no occurrence is lost."""
    groups = resolution_failures(failures)
    order = [F.desc("occurrences"), "source_file", "phase", "reason", "symbol", "line", "module", "scope"]
    kept = groups.orderBy(*order).limit(most)
    total = groups.agg(F.count("*").alias("n"), F.sum("occurrences").alias("o")).crossJoin(F.broadcast(kept.agg(F.sum("occurrences").alias("k")))).where(F.col("n") > most)
    given = {"module": F.lit("."), "scope": F.lit("MAIN"), "phase": F.lit("RESOLUTION"), "reason": F.lit("DIAGNOSTIC_LIMIT_REACHED"), "severity": F.lit("info"), "line": F.lit(0), "occurrences": F.col("o") - F.col("k")}
    over = total.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in groups.schema])
    return kept.unionByName(over)


def unresolved(diagnostics: DataFrame) -> DataFrame:
    """(unresolved): occurrences of all diagnostics of resolution."""
    return diagnostics.where(F.lower("phase").startswith("resol")).agg(F.coalesce(F.sum("occurrence_count"), F.lit(0)).cast("long").alias("unresolved"))


def ewma(values: list[float], alpha: float = 0.25) -> float | None:
    """Exponentially weighted mean, oldest first."""
    out = None
    for v in values:
        out = v if out is None else alpha * v + (1 - alpha) * out
    return out


def worth_increment(files: int, total: int, per_file: float | None = None, full: float | None = None, cap: int | None = None) -> bool:
    """Whether so many files are to be redone on their own: under 70 % of a full run by past costs,
    or, without those, at most 200 or a fifth of all files."""
    if cap is not None and files > cap:
        return False
    if per_file is not None and full is not None:
        return files * per_file <= 0.7 * full
    return files <= max(200, total // 5)


def readiness(version: int | None, wanted: int, nodes: int, stale: bool, dimensions: dict[str, str]) -> dict:
    """Whether a graph may be relied on: blockers call for repair, partial dimensions degrade it."""
    blockers = []
    if version is None:
        blockers.append("INDEX_MISSING")
    elif version != wanted:
        blockers.append("SCHEMA_MISMATCH")
    elif nodes == 0:
        blockers.append("INDEX_EMPTY")
    if stale:
        blockers.append("INDEX_STALE")
    blockers += [code for key, code in (("parse", "PARSE_INCOMPLETE"), ("graph", "GRAPH_INTEGRITY_FAILED"), ("index", "INDEX_INTEGRITY_FAILED")) if dimensions.get(key) == "failed"]
    partial = sorted(k for k, v in dimensions.items() if v == "partial")
    return {"status": "REPAIR_REQUIRED" if blockers else "DEGRADED" if partial else "READY", "blockers": blockers, "partial": partial}


#: which states of freshness may follow which
FRESHNESS = {
    "IDLE": {"INCREMENTAL", "REBUILDING", "STALE"}, "INCREMENTAL": {"IDLE", "FAILED", "STALE", "REBUILDING"}, "REBUILDING": {"IDLE", "FAILED"},
    "STALE": {"INCREMENTAL", "REBUILDING"}, "FAILED": {"INCREMENTAL", "REBUILDING", "STALE"},
}


def freshness(now: str, then: str) -> str:
    if then not in FRESHNESS[now]:
        raise ValueError(f"{now} is not followed by {then}")
    return then
