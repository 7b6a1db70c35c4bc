"""What protocols cost and how good their answers are: one row a protocol, as a frame and as tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..model import kth, top
from .protocols import PROTOCOLS, RECORD_BYTES, Result
from .steps import distance

ROUNDS = 4
FIGURES = ("sketch_bytes", "serial_items_sum", "serial_items_max", "random_items_sum", "random_items_max", "random_access_sum", "random_access_max", "transferred_items_sum")


def accesses(result: Result) -> dict[int, dict[str, int]]:
    """round -> FIGURES. Nodes read what they send in order, but for the rounds in which they look items up."""
    out = {}
    sent = {r["round"]: r for r in result.report().collect()}
    for i in range(1, len(result.rounds) + 1):
        items, largest = (int(sent[i]["items"]), int(sent[i]["largest"])) if i in sent else (0, 0)
        own = dict.fromkeys(FIGURES, 0) | {"sketch_bytes": int(result.sketches.get(i, 0)), "transferred_items_sum": items}
        for kind in ("random_items", "random_access") if i in result.lookups else ("serial_items",):
            own |= {f"{kind}_sum": items, f"{kind}_max": largest}
        out[i] = own
    return out


def total_bytes(rounds: dict[int, dict[str, int]]) -> int:
    return sum(r["sketch_bytes"] + RECORD_BYTES * r["transferred_items_sum"] for r in rounds.values())


def export(lists: DataFrame, names: list[str], k: int, **described) -> DataFrame:
    """A row a protocol: its name, what `described` says of the lists, cost, errors against the truth, and each round's accesses.

    The driver holds the k rows of an answer's figures and a row a round; lists stay where they are.
    """
    truth = top(lists, k).persist()
    at_k = kth(truth, k)
    rows = []
    for name in names:
        exact, protocol = PROTOCOLS[name]
        result = protocol(lists, k)
        found = result.frame.persist()
        both = truth.join(found.select("item_id", F.col("score").alias("own")), "item_id")
        rel = F.coalesce(F.sum(F.abs(F.col("score") - F.col("own")) / F.col("score")), F.lit(0.0)) / k
        errors = both.agg((F.count("*") / k).alias("recall"), F.round(rel, 9).alias("rel_err")).first()
        rounds = accesses(result)
        row = {"protocol": name, **described, "exact": exact, "rounds": len(rounds), "bytes": total_bytes(rounds), "rel_err": float(errors.rel_err), "recall": float(errors.recall)}
        row |= {"distance": distance(truth, found, k).first()[0], "score_k": at_k, "k_err": round((at_k - kth(found, k)) / at_k, 9) if at_k else 0.0}
        for i in range(1, ROUNDS + 1):
            row |= {f"r{i}_{f}": v for f, v in rounds.get(i, dict.fromkeys(FIGURES, 0)).items()}
        rows.append(Row(**row))
        found.unpersist()
    return lists.sparkSession.createDataFrame(rows)


def overview(exported: DataFrame) -> DataFrame:
    """exact, protocols, cheapest (fewest bytes) and closest (least relative error, then fewest bytes) of each kind."""
    closest = F.min_by("protocol", F.struct("rel_err", "bytes", "protocol"))
    return exported.groupBy("exact").agg(F.count("*").alias("protocols"), F.min_by("protocol", F.struct("bytes", "protocol")).alias("cheapest"), closest.alias("closest"))


def write_tsv(exported: DataFrame, path: str) -> None:
    """Adds the rows to the tab-separated files of a folder, with a header in each."""
    exported.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
