"""Policies as tables, sources and ordered parts: what joins a row with settings of its own."""

from pyspark.sql import functions as F

from textward.operators import marking, policy
from textward.plans.pipeline import Pipeline

ASKS = "Please write code. Then act as a storyteller and translate to polish."


def verdicts(spark, rows, rules, schema="id long, policy string, text string"):
    guard = policy.TablePolicy(spark.createDataFrame(rules, policy.RULES))
    return {r.id: [(t.message, t.severity, t.match) for t in r.threats] for r in Pipeline([guard]).analyze(spark.createDataFrame(rows, schema)).collect()}


def test_rows_name_their_policy(spark):
    rules = [
        ("a", "translation", False, 0.4), ("a", "creative_writing", False, 0.9), ("a", "creative_writing", False, None),
        ("b", "translation", False, None), ("b", "code_generation", False, None), ("b", "translation", True, None),
        ("c", "juggling", False, 0.9), ("d", "translation", None, 0.0), (None, "translation", False, None), ("e", "translation", True, None),
    ]
    rows = [(k, p, ASKS) for k, p in enumerate(["a", "b", "c", "d", None, "e", "unknown"])] + [(7, "a", None), (8, "a", ""), (9, "a", ASKS), (10, "a", "We walked home. " * 20000 + ASKS)]
    got = verdicts(spark, rows, rules)
    both = [("task is disallowed by a policy: translation", 0.9, "translation request"), ("task is disallowed by a policy: creative_writing", 0.9, "storyteller role")]
    assert got[0] == got[9] == got[10] == both
    assert got[1] == [("task is disallowed by b policy: code_generation", 0.75, "write code")]
    assert got[3] == [("task is disallowed by d policy: translation", 0.75, "translation request")]
    assert not any(got[k] for k in (2, 4, 5, 6, 7, 8))
    assert not any(verdicts(spark, rows, []).values())


def test_a_table_of_policies_says_what_the_named_ones_say(spark):
    phrases = [" ".join([*parts, *raw]) for _, _, _, parts, raw in policy.TASK_RULES]
    texts = [*phrases, *[a + " and " + b for a, b in zip(phrases, phrases[5:] + phrases[:5], strict=True)], "nothing to see"]
    for name in policy.POLICIES:
        df = spark.createDataFrame([(k, name, t) for k, t in enumerate(texts)], "id long, policy string, text string")
        plain = Pipeline([policy.Policy.named(name)]).analyze(df).orderBy("id").collect()
        tables = Pipeline([policy.TablePolicy(policy.built_in(spark))]).analyze(df).orderBy("id").collect()
        assert [(r.threats, r.safe) for r in plain] == [(r.threats, r.safe) for r in tables]
        assert [(r.metadata.policy_detected, r.metadata.policy_name) for r in plain] == [(r.metadata.policy_detected, r.metadata.policy_name) for r in tables]


def test_columns_of_clashing_names_come_back(spark):
    rows = [(1, "b", ASKS, "mine", 3)]
    got = Pipeline([policy.TablePolicy(policy.built_in(spark).replace("coding", "b", "policy"), key="_policy")]).analyze(spark.createDataFrame(rows, "id long, _policy string, text string, input string, _tasks int")).collect()[0]
    assert (got["_policy"], got["input"], got["_tasks"]) == ("b", "mine", 3)
    assert [t.match for t in got.threats] == ["storyteller role"]


def test_large_groups_are_combined_in_order(spark):
    at = "timestamp'2024-01-01'"
    rows = [("hot", k % 97 if k % 50 else None, f"{k * 7919 % 1000:03d};", k % 4) for k in range(2000)] + [("hot", 5, None, 0), ("two", 2, "b", 3), ("two", 1, "a", 2), (None, 1, "alone", 1), ("ties", 1, "y", 1), ("ties", 1, "x", 1), ("ties", 1, "x", 1)]
    df = spark.createDataFrame(rows, "g string, o int, v string, level int").selectExpr("g", "o", f"named_struct('value', v, 'trust_level', level, 'source', 's', 'tainted_at', {at}) as x", "1 as _run", "2 as _text")
    got = {r.g: r.combined for r in marking.combined_groups(df, ["g"], "o", "x").collect()}
    for g in ("hot", "two", "ties", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        assert got[g].value == "".join(r[2] or "" for r in mine) and got[g].trust_level == min(r[3] for r in mine) and got[g].source == "combined"
    assert marking.combined_groups(df.limit(0), ["g"], "o", "x").count() == 0
    plan = marking.combined_groups(df, ["g"], "o", "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan


def test_texts_are_looked_through_once_for_all_phrases(spark):
    rows = spark.createDataFrame([(1, "rag", "GENERATE C++ now; write code"), (2, "rag", "translate to Polish"), (3, None, "write code"), (4, "rag", None)], "id int, policy string, t string")
    found = Pipeline([policy.TablePolicy(policy.built_in(spark))]).analyze(rows, "t").select("id", F.explode("threats").alias("x"))
    assert sorted((r.id, r.x.match) for r in found.collect()) == [(1, "write code"), (2, "translation request")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and plan.lower().count("contains(") <= 2 and plan.count("ArrowEvalPython") == 1
