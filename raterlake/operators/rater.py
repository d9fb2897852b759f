"""The offline rater: deterministic answers to planned trials, for tests and dry runs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import canonical
from ..functions.seeds import derive

#: What the rater says when it doesn't answer.
FREE_TEXT = "fake answer"
NOT_JSON = "I think it is about a 4."
KINDS = ("fatal", "refused", "transient")
#: No option of a pairwise item; the second where the first is one.
NO_OPTION = ("C", "Z")


def category(seed: int, rates: dict[str, float]) -> str:
    """The first kind that its own stream of the seed hits, else ok."""
    for kind in KINDS:
        if rates.get(kind, 0) > 0 and random.Random(derive(seed, f"fake_{kind}", "")).random() < rates[kind]:
            return kind
    return "ok"


def _points(item: dict) -> int:
    """Arrow hands nullable integers over as floats."""
    return int(item["points"]) if item["points"] is not None and item["points"] == item["points"] else 1


def answer(seed: int, items: list[dict]) -> dict[str, int | str]:
    rng, out = random.Random(seed), {}
    for item in items:
        if item["type"] == "likert":
            out[item["item_id"]] = rng.randint(1, _points(item))
        elif item["type"] == "pairwise":
            out[item["item_id"]] = rng.choice(list(item["options"]) if item["options"] is not None else ["A", "B"])
        else:
            out[item["item_id"]] = FREE_TEXT
    return out


def invalid_answer(seed: int, attempt: int, items: list[dict]) -> str:
    """Not JSON, a missing item, or a value out of range, in turn by attempt."""
    kind = (attempt - 1) % 3
    if kind == 0:
        return NOT_JSON
    found, first = answer(seed, items), items[0]
    if kind == 1:
        found.pop(first["item_id"])
    elif first["type"] == "likert":
        found[first["item_id"]] = _points(first) + 1
    else:
        options = list(first["options"]) if first["options"] is not None else ["A", "B"]
        found[first["item_id"]] = next(x for x in NO_OPTION if x not in options) if first["type"] == "pairwise" else ""
    return canonical(found)


def rated(attempts: DataFrame, items: DataFrame, rates: dict[str, float] | None = None, invalid_rate: float = 0.0) -> DataFrame:
    """attempts (trial_id, attempt, seed, instrument) with category and raw. Each row is
    answered from its own seed, so the result doesn't depend on how rows are spread."""
    rates = rates or {}
    listed = items.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "type", "points", "options"))).alias("items"))
    rows = attempts.join(F.broadcast(listed), "instrument").select("trial_id", "attempt", "seed", "items")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds, raws = [], []
            for seed, attempt, asked in zip(batch["seed"], batch["attempt"], batch["items"]):
                seed, asked = int(seed), [i if isinstance(i, dict) else i.asDict() for i in asked]
                kind = category(seed, rates)
                broken = invalid_rate > 0 and random.Random(derive(seed, "fake_invalid", "")).random() < invalid_rate
                kinds.append(kind)
                raws.append(None if kind != "ok" else invalid_answer(seed, int(attempt), asked) if broken else canonical(answer(seed, asked)))
            yield pd.DataFrame({"trial_id": batch["trial_id"], "attempt": batch["attempt"], "category": kinds, "raw": raws})

    return rows.mapInPandas(run, "trial_id string, attempt int, category string, raw string")
