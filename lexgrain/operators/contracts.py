"""Contract checks: JSON lines, duplicates, references, plans. Each gives rows of violations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.operators.search import dsl_faults
from lexgrain.sources import shared

TASK = "id string, repo string, query_nl string, query_dsl struct<must:array<string>,k:int>, gold struct<kind:string,file:string,anchor:string>, difficulty string, type string"
TASK_KEYS = ("id", "repo", "query_nl", "query_dsl", "gold")


def malformed(lines: DataFrame, value: str = "value", schema: str = TASK, required: tuple[str, ...] = TASK_KEYS) -> DataFrame:
    """(line_no, reason) of rows(line_no, value) that are no JSON of the schema or lack a required key; blank lines pass."""
    parsed = F.from_json(value, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.length(F.trim(value)) > 0).withColumn("x", parsed)
    missing = F.filter(F.array(*[F.when(F.col(f"x.{k}").isNull(), F.lit(k)) for k in required]), lambda k: k.isNotNull())
    reason = F.when(F.col("x._corrupt_record").isNotNull(), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    return rows.select("line_no", reason.alias("reason")).where("reason is not null")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key the target does not have."""
    return rows.join(target.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def too_few(rows: DataFrame, least: int, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(name).alias("rule"), F.col("n").cast("string").alias("detail"))


def latency_order(constraints: DataFrame) -> DataFrame:
    """constraints(p50, p95, p99) that do not rise."""
    return constraints.where(~((F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))))


def placeholders(rows: DataFrame, *columns: str) -> DataFrame:
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.col(c)).rlike("^(tbd|todo|xxx|placeholder|<.*>|0{40})$")
    return rows.where(F.coalesce(test, F.lit(False)))


def task_violations(tasks: DataFrame, corpora: DataFrame, least_tasks: int = 1, least_corpora: int = 1) -> DataFrame:
    """One table of (rule, detail): minimum counts, unique ids, repositories that exist, placeholders."""
    out = too_few(tasks, least_tasks, "tasks").unionByName(too_few(corpora, least_corpora, "corpora"))
    out = out.unionByName(duplicates(tasks, "id").select(F.lit("duplicate task").alias("rule"), F.col("id").alias("detail")))
    out = out.unionByName(duplicates(corpora, "id").select(F.lit("duplicate corpus").alias("rule"), F.col("id").alias("detail")))
    out = out.unionByName(dangling(tasks.select("id", "repo"), "repo", corpora, "id").select(F.lit("unknown repo").alias("rule"), F.col("id").alias("detail")))
    return out.unionByName(placeholders(corpora, "commit").select(F.lit("placeholder").alias("rule"), F.col("id").alias("detail")))


def plan_violations(steps: DataFrame, plan: tuple[str, ...] = ()) -> DataFrame:
    """steps(id, order, dependencies): gaps in the order, unknown dependencies, ones that do not come before. plan: columns that tell plans apart; without them all steps are one plan, ranked by one task."""
    n = steps.withColumn("want", F.row_number().over(Window.partitionBy(*plan).orderBy("order", "id")))
    gaps = n.where(F.col("order") != F.col("want")).select(*plan, F.lit("order").alias("rule"), F.col("id").alias("detail"))
    needs = steps.select(*plan, "id", "order", F.explode("dependencies").alias("dep"))
    seen = steps.select(*plan, F.col("id").alias("dep"), F.col("order").alias("dep_order"))
    joined = needs.join(seen, [*plan, "dep"], "left")
    unknown = joined.where("dep_order is null").select(*plan, F.lit("unknown dependency").alias("rule"), F.col("id").alias("detail"))
    late = joined.where(F.col("dep_order") >= F.col("order")).select(*plan, F.lit("dependency order").alias("rule"), F.col("id").alias("detail"))
    return gaps.unionByName(unknown).unionByName(late)


# The phases that a plan has.
PHASES = ("phase0_planning", "phase1_spec", "phase2_mvp", "phase3_benchmark", "phase4_data", "phase5_paper", "phase6_go_live", "phase7_release")


def register_violations(steps: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """steps(id, order, phase, status, register_only): repeated ids and orders, phases without a step, steps that are not registered only."""
    out = duplicates(steps, "id").select(F.lit("duplicate step").alias("rule"), F.col("id").alias("detail"))
    out = out.unionByName(duplicates(steps, "order").select(F.lit("duplicate order").alias("rule"), F.col("order").cast("string").alias("detail")))
    wanted = steps.sparkSession.createDataFrame([(p,) for p in phases], "phase string")
    out = out.unionByName(dangling(wanted, "phase", steps, "phase").select(F.lit("missing phase").alias("rule"), F.col("phase").alias("detail")))
    out = out.unionByName(steps.where(~F.col("status").eqNullSafe("registered")).select(F.lit("status").alias("rule"), F.col("id").alias("detail")))
    return out.unionByName(steps.where(~F.col("register_only").eqNullSafe(True)).select(F.lit("register_only").alias("rule"), F.col("id").alias("detail")))


def policy_violations(tasks: DataFrame, corpora: DataFrame, baselines: DataFrame, constraints: DataFrame, policy: dict) -> DataFrame:
    """(rule, detail) across files: what task_violations() finds, minima by repository, terms and anchors, templates, the order of latencies.

    policy: minimums (corpora, baselines, tasks_total, tasks_per_repo, must_terms_per_task, anchor_min_length),
    baseline_required_placeholders and run_constraints.enforce_latency_order.
    """
    least = policy["minimums"]
    out = task_violations(tasks.select("id", "repo"), corpora, least["tasks_total"], least["corpora"])
    out = out.unionByName(too_few(baselines, least["baselines"], "baselines"))
    out = out.unionByName(duplicates(baselines, "tool").select(F.lit("duplicate tool").alias("rule"), F.col("tool").alias("detail")))
    for word in policy["baseline_required_placeholders"]:
        out = out.unionByName(baselines.where(~F.contains("cmd_template", F.lit(word))).select(F.lit(f"template without {word}").alias("rule"), F.col("tool").alias("detail")))
    if policy["run_constraints"]["enforce_latency_order"]:
        out = out.unionByName(latency_order(constraints).select(F.lit("latency order").alias("rule"), F.concat_ws(",", "p50", "p95", "p99").alias("detail")))
    have = tasks.groupBy("repo").agg(F.count("*").alias("n"))
    per_repo = corpora.select(F.col("id").alias("repo")).join(have, "repo", "left").where(F.coalesce("n", F.lit(0)) < least["tasks_per_repo"])
    out = out.unionByName(per_repo.select(F.lit("tasks of a repo").alias("rule"), F.col("repo").alias("detail")))
    out = out.unionByName(tasks.where(F.size("query_dsl.must") < least["must_terms_per_task"]).select(F.lit("must terms").alias("rule"), F.col("id").alias("detail")))
    return out.unionByName(tasks.where(F.length("gold.anchor") < least["anchor_min_length"]).select(F.lit("anchor length").alias("rule"), F.col("id").alias("detail")))


JSON_KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def schema_faults(schema: object, at: str = "") -> list[str]:
    """What is wrong with a JSON schema itself: its types, required names, properties and items."""
    if not isinstance(schema, dict):
        return [f"{at or 'schema'}: is no object"]
    out, kinds = [], schema.get("type", [])
    out += [f"{at or 'schema'}: unknown type {k}" for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in JSON_KINDS]
    names = schema.get("required", [])
    if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
        out.append(f"{at or 'schema'}: required is no list of names")
    for name, more in schema.get("properties", {}).items():
        out += schema_faults(more, f"{at}/{name}")
    return out + (schema_faults(schema["items"], f"{at}/items") if "items" in schema else [])


def value_faults(value: object, schema: dict, at: str = "") -> list[str]:
    """Where a value departs from a schema: types, required names, names beside the properties, choices, least values and sizes."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_a = lambda k: isinstance(value, JSON_KINDS[k]) and (k == "boolean" or not isinstance(value, bool))
    if kinds and not any(map(is_a, kinds)):
        return [f"{at or '<root>'}: is no {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '<root>'}: is none of the choices")
    if isinstance(value, int | float) and value < schema.get("minimum", value):
        out.append(f"{at or '<root>'}: is under {schema['minimum']}")
    if isinstance(value, str | list) and len(value) < schema.get("minLength" if isinstance(value, str) else "minItems", 0):
        out.append(f"{at or '<root>'}: is too short")
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        out += [f"{at or '<root>'}: lacks {k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at or '<root>'}: has {k}" for k in value if k not in inner]
        for k, v in value.items():
            out += value_faults(v, inner[k], f"{at}/{k}") if k in inner else []
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += value_faults(v, schema["items"], f"{at}/{k}")
    return out


def file_faults(spark: SparkSession, root: str, schemas: dict[str, str], samples: dict[str, str]) -> DataFrame:
    """(file, fault) of contract files below root, by name: ones that lack, are no JSON, are no schema, or do not follow theirs."""
    rows, known = [], {}
    for name, path in [*schemas.items(), *samples.items()]:
        try:
            known[path] = json.loads(shared.get(spark, f"{root}/{path}"))
        except ValueError:
            rows.append((path, "is no JSON"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.append((path, "is missing"))
    for path in schemas.values():
        rows += [(path, x) for x in schema_faults(known[path])] if path in known else []
    for name, path in samples.items():
        if path in known and schemas[name] in known:
            rows += [(path, x) for x in value_faults(known[path], known[schemas[name]])]
    return spark.createDataFrame(rows, "file string, fault string")


def read_json(path: str) -> tuple[object | None, str | None]:
    """(value, None) or (None, what is wrong) of a small local contract file."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f), None
    except (OSError, ValueError) as e:
        return None, str(e)


def check_queries(spark: SparkSession, queries: list[dict]) -> DataFrame:
    """(query_no, fault) of a list of DSL queries."""
    rows = [(i, fault) for i, q in enumerate(queries) for fault in dsl_faults(q)]
    return spark.createDataFrame(rows, "query_no int, fault string")
