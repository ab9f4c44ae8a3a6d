"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger records which (blob, rule version)
pairs have been scanned; a scan takes each distinct blob once, only with the rules it has not met, and findings are joined
back to all paths and versions that have the blob. A stored ledger is a folder that keeps the findings beside the pairs, so a later scan
has the earlier findings too. Only built-in functions: a match's place is found from the
lengths of the text between matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, scratch_path, written

LEDGER = "blob string, due array<struct<kind:string,version:int>>, hits array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>"


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: leftmost non-overlapping matches. value_group, least: a match counts if that group is so long.

    hint: a substring or, with ``hint_regex``, a pattern without which a text cannot match.
    """

    kind: str
    version: int
    pattern: str
    value_group: int = 0
    least: int = 0
    hint: str = ""
    hint_regex: bool = False


BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)passw|secret|token|api_?key", True),
    # runs are maximal, so the least length can stand in the pattern: a shorter match never hides a longer one
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}", True),
)
#: What the method adds to the base kinds.
MORE = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
    Rule("private_key", 1, r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 0, "-----BEGIN"),
)
RULES = BASE + MORE


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start int, end int>> of a rule's matches in code points, end exclusive."""

    def places(gaps: Column, found: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, k: Column) -> Column:
            begin = acc["at"] + F.length(F.get(gaps, k))
            end = begin + F.length(F.get(found, k))
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(F.length(F.get(values, k)) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = found if rule.value_group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.value_group))
    both = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), found.alias("found"), values.alias("values"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    hinted = text.rlike(rule.hint) if rule.hint_regex else text.contains(rule.hint)
    return F.when(hinted, let(both, lambda b: F.when(F.size(b["found"]) > 0, places(b["gaps"], b["found"], b["values"])).otherwise(none))).otherwise(none)


def _scan(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, due (the rules it has not met) and hits (their findings) of every distinct blob with a due rule."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    if ledger is not None:
        seen = ledger.select("blob", "kind", "version").distinct().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(pairs, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
        blobs = blobs.filter(F.size("due") > 0)
    else:
        blobs = blobs.withColumn("due", pairs)
    none = F.array().cast("array<struct<start:int,end:int>>")
    per_rule = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                 (spans_of(F.col("text"), r) if ledger is None else F.when(F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), spans_of(F.col("text"), r)).otherwise(none)).alias("spans"))
        for r in rules
    ]
    return blobs.select("blob", "due", F.filter(F.array(*per_rule), lambda x: F.size(x["spans"]) > 0).alias("hits"))


def _findings(found: DataFrame) -> DataFrame:
    return found.select("blob", F.explode("hits").alias("hit")).select("blob", "hit.kind", "hit.version", F.explode("hit.spans").alias("s")).select("blob", "kind", "version", "s.start", "s.end")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("blob", F.explode("due").alias("d")).select("blob", "d.kind", "d.version")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan blobs that a rule has not seen. versions: blob (content address) and text, one row for each version of a path.

    ledger: earlier results of this function's second part (blob, kind, version), or None. Returns (findings, scanned):
    findings has blob, kind, version, start, end; scanned has the pairs to append to the ledger. Each distinct blob's text is
    kept once, so a blob under a third of all paths is scanned once; null texts are to be coalesced before.
    """
    found = written(_scan(versions, ledger, rules), "scan")
    return _findings(found), _pairs(found)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a stored ledger: blob, due (the pairs scanned) and hits (their findings); None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_into_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger in the folder ``path`` has not seen, append it there, and return all its findings (blob, kind, version, start, end) of these rules' versions."""
    spark = versions.sparkSession
    old = read_ledger(spark, path)
    _scan(versions, None if old is None else _pairs(old), rules).write.mode("append").parquet(path)
    current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    return _findings(read_ledger(spark, path)).filter(F.array_contains(current, F.struct("kind", "version")))


def blob_versions(documents: DataFrame) -> DataFrame:
    """doc_id, blob and text of every document; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))


def secrets_by_document(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans (and their structs in ``found``) for every document.

    ledger: the folder of a stored ledger, which is begun or continued; None for one of this call's own. Findings of earlier scans count
    like those of this one. A null text is an empty one. Documents without findings have zero counts and empty strings' digests. Repeated rows are
    paths of one blob and get its findings each; a null doc_id is kept.
    """
    versions = blob_versions(documents)
    findings = scan_into_ledger(versions, ledger or scratch_path(documents.sparkSession, "secret-ledger"), rules)
    rank = F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i))), F.col("kind"))
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found"))
    joined = versions.select("doc_id", "blob").join(per_blob, "blob", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    joined = joined.withColumn("found", found)
    base = [r.kind for r in BASE]
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc_id", "blob", *(count(k) for k in base), F.sha2(text_of(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text_of(F.col("found")).alias("spans"), "found",
    )


def _sql_kind(rank: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""
select doc_id, '{r.kind}' as kind, {rank} as rank, start, start + length(m) as stop from (
  select doc_id, m, v, cast(sum(length(g) + coalesce(length(pm), 0)) over (partition by rid order by i) as bigint) as start from (
    select rid, doc_id, i, g, m, v, lag(m) over (partition by rid order by i) as pm from (
      select rid, doc_id, unnest(range(len(ms))) as i, unnest(gs[1:len(ms)]) as g, unnest(ms) as m, unnest(vs) as v from (
        select rid, doc_id, regexp_split_to_array(text, '{pattern}') as gs, regexp_extract_all(text, '{pattern}', 0) as ms, regexp_extract_all(text, '{pattern}', {r.value_group}) as vs from d)))) where length(v) >= {r.least}"""


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind in ('assign', 'access', 'hex')) as base,
             string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from s group by 1)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""
