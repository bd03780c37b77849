"""Classification of questions by rules that are data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import Store

METRICS = ["avg_score", "difficulty_index", "discrimination_index", "reliability", "total_attempts"]


def holds(value, operator, low, high):
    """A condition; false for a null metric, an unknown operator, or between without an upper bound."""
    result = (
        F.when(operator == "=", F.abs(value - low) < 1e-4).when(operator == ">", value > low).when(operator == "<", value < low)
        .when(operator == ">=", value >= low).when(operator == "<=", value <= low)
        .when(operator == "between", (value >= low) & (value <= high))
    )
    return F.coalesce(result, F.lit(False))


def classify(metrics: DataFrame, rules: DataFrame, conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """``question_id, categories, flags, messages`` of the rules that fire, in the order of rules.

    A rule fires if it is active, has a condition and all its conditions hold. Rules are a handful of
    rows that users write; Spark broadcasts them if they are as small as that.
    """
    long = metrics.select("question_id", *(F.col(m).cast("double").alias(m) for m in METRICS))
    long = long.unpivot("question_id", METRICS, "metric_name", "value")
    active = rules.where("is_active").join(conditions, "rule_id")
    checked = long.join(active, "metric_name")
    checked = checked.withColumn("ok", holds(F.col("value"), F.col("operator"), F.col("value_from"), F.col("value_to")))
    needed = active.groupBy("rule_id").agg(F.count("*").alias("needed"))
    fired = checked.groupBy("question_id", "rule_id", "rule_order").agg(F.count_if("ok").alias("held"))
    fired = fired.join(needed, "rule_id").where("held = needed")
    done = fired.join(actions, "rule_id")
    order = F.struct("rule_order", "rule_id", "action_id", "action_type", "action_value", "action_message")
    done = done.groupBy("question_id").agg(F.array_sort(F.collect_list(order)).alias("a"))
    values = lambda kind: F.transform(F.filter("a", lambda x: x["action_type"] == kind), lambda x: x["action_value"])
    said = F.filter(F.transform("a", lambda x: x["action_message"]), lambda m: m.isNotNull() & (m != ""))
    return done.select(
        "question_id", values("set_category").alias("categories"), values("set_flag").alias("flags"), said.alias("messages")
    )


def nested(rules: DataFrame, conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """Each rule with its conditions and actions as arrays, by order."""
    c = conditions.groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("condition_order", "metric_name", "operator", "value_from", "value_to"))).alias("conditions")
    )
    a = actions.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("action_id", "action_type", "action_value"))).alias("actions"))
    return rules.join(c, "rule_id", "left").join(a, "rule_id", "left").orderBy("rule_order", "rule_id")


def toggled(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.withColumn("is_active", F.when(F.col("rule_id") == rule_id, ~F.col("is_active")).otherwise(F.col("is_active")))


def without(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.where(F.col("rule_id") != rule_id)


#: What a rule that users build may consist of (fixed values).
BUILDER_METRICS = ["difficulty_index", "discrimination_index", "avg_score", "total_attempts"]
BUILDER_OPERATORS = [">", "<", ">=", "<=", "between"]
BUILDER_CATEGORIES = ["too_difficult", "too_easy", "poor_discrimination", "insufficient_attempts"]
#: The tables of rules, which change together.
RULE_TABLES = {
    "rules": "rule_id int, rule_name string, rule_order int, is_active boolean",
    "conditions": "condition_id int, rule_id int, condition_order int, metric_name string, operator string, value_from double, value_to double",
    "actions": "action_id int, rule_id int, action_type string, action_value string, action_message string",
}


def _number(text: str | float | None) -> float | None:
    try:
        return None if text is None or isinstance(text, str) and "_" in text else float(text)
    except ValueError:
        return None


def create_rule(
    tables: Store, name: str, metric: str, operator: str, value_from: str | float, category: str, value_to: str | float | None = None, message: str = "", order: int = 1
) -> int:
    """Adds an active rule of one condition and one category, in one commit; its id. What isn't allowed is an error and changes nothing.

    The upper bound counts for between alone; an order below 1 is 1.
    """
    if not name.strip():
        raise ValueError("a rule has a name")
    for value, allowed, what in ((metric, BUILDER_METRICS, "metric"), (operator, BUILDER_OPERATORS, "operator"), (category, BUILDER_CATEGORIES, "category")):
        if value not in allowed:
            raise ValueError(f"{value} is no {what} of rules")
    low = _number(value_from)
    if low is None:
        raise ValueError("a rule has a value to compare with")
    high = _number(value_to) if operator == "between" else None
    commit = tables.commit()
    rows = {
        "rules": (commit.number, name.strip(), max(1, order), True),
        "conditions": (commit.number, commit.number, 1, metric, operator, low, high),
        "actions": (commit.number, commit.number, "set_category", category, message.strip()),
    }
    for table, row in rows.items():
        commit.append(table, tables.spark.createDataFrame([row], RULE_TABLES[table]))
    commit.publish()
    return commit.number


def active_rules(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """The active rules with ``condition_ids``, the ids of their conditions in their order as one string; null without any."""
    ids = conditions.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("condition_order", "condition_id"))).alias("c"))
    ids = ids.select("rule_id", F.array_join(F.transform("c", lambda x: x["condition_id"].cast("string")), ",").alias("condition_ids"))
    return rules.where("is_active").join(ids, "rule_id", "left").orderBy("rule_order", "rule_id")
