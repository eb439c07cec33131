"""Transition models and value learning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(steps: DataFrame) -> DataFrame:
    """state, action, next, prob of the observed steps."""
    n = steps.where("next is not null").groupBy("state", "action", "next").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("state", "action"))
    return n.select("state", "action", "next", (F.col("n") / total).alias("prob"))


def likeliest(steps: DataFrame) -> DataFrame:
    """state, action and the next state seen most often; of equal ones the least."""
    n = steps.where("next is not null").groupBy("state", "action", "next").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("state", "action").agg(F.max_by("next", F.struct("n", -F.col("next"))).alias("next"))


def q_values(steps: DataFrame, key: str, order: list[str], rate: float, discount: float, sarsa: bool = False, explore: float | None = None) -> DataFrame:
    """key, state, action, q: values learned step by step within each key's sequence.

    What lies ahead is the best action's value, that of the next action (sarsa), or what is expected of a policy that
    takes the best action but explores with the given probability (expected SARSA).
    """
    kind = dict(steps.dtypes)[key]

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        q: dict[tuple, float] = {}
        actions = sorted(set(rows["action"]))
        items = list(zip(rows["state"], rows["action"], rows["reward"]))
        for (s, a, r), after in zip(items, [*items[1:], None]):
            if after is None:
                ahead = 0.0
            elif explore is not None:
                values = [q.get((after[0], x), 0.0) for x in actions]
                ahead = (1 - explore) * max(values) + explore * sum(values) / len(values)
            elif sarsa:
                ahead = q.get((after[0], after[1]), 0.0)
            else:
                ahead = max(q.get((after[0], x), 0.0) for x in actions)
            q[s, a] = q.get((s, a), 0.0) + rate * (r + discount * ahead - q.get((s, a), 0.0))
        return pd.DataFrame([(rows[key].iloc[0], s, a, v) for (s, a), v in q.items()], columns=[key, "state", "action", "q"])

    return steps.groupBy(key).applyInPandas(learn, f"{key} {kind}, state long, action string, q double")


def td_target(reward, discount: float, ahead):
    return reward + discount * ahead


def linear_value(weights, features):
    return F.aggregate(F.zip_with(weights, features, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
