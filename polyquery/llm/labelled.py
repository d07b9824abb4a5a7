"""A bounded, deterministic sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit uses at most (about), and by default the characters of them.
FIT_DOCUMENTS = 3000
FIT_CHARACTERS = 10_000_000


def held_out(folds: int, fold: int, doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod folds is fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def within(docs: DataFrame, ids: DataFrame, characters: int = FIT_CHARACTERS) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of the documents of ``ids`` (doc_id, label; few enough for every task), at most ``characters`` of text.

    Labels share the characters evenly, rarest first, and what one leaves goes to
    the next. Of a label the documents are taken in the order of a hash of
    doc_id; one that doesn't fit (all rows of a repeated doc_id together) is
    skipped. Lengths are looked at before any text comes to the driver.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in picked.groupBy("doc_id", "label").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).collect():
        sizes.setdefault(r["label"], []).append((r["doc_id"], r["n"]))
    left, over = characters, []
    for k, label in enumerate(sorted(sizes, key=lambda x: (len(sizes[x]), x))):
        room = left // (len(sizes) - k)
        for doc_id, n in sorted(sizes[label], key=lambda x: (x[0] * 2654435761 % (1 << 32), x[0])):
            if n > room:
                over.append(doc_id)
            else:
                room, left = room - n, left - n
    if over:
        picked = picked.where(~F.col("doc_id").isin(over))
    return [(r["doc_id"], r["text"] or "", int(r["label"])) for r in picked.select("doc_id", "text", "label").toLocalIterator()]


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int = FIT_DOCUMENTS, characters: int = FIT_CHARACTERS) -> list[tuple[str, int]]:
    """(text, label) of about ``bound`` training documents at most, half of them of the rarer label if there are as many.

    A document is taken if a hash of its doc_id is under a share that the counts
    of labelled rows set, so the sample is the same in every run and its size
    doesn't follow the input. Of more than ``characters`` of text, what :func:`within`
    takes for each label stays. Labels of the held-out fold, null labels and null
    ids are left out; of several labels of a document the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(folds, fold))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    few = min(counts.values())
    room = {k: (min(few, bound // 2) if n == few else bound - min(few, bound // 2)) for k, n in counts.items()} if len(counts) == 2 else dict.fromkeys(counts, bound)
    if len(set(counts.values())) == 1:
        room = dict.fromkeys(counts, bound // len(counts))
    spread = 1 << 20
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    under = F.lit(0)
    for k, n in counts.items():
        under = F.when(F.col("label") == k, F.lit(min(spread, int(spread * room[k] / n)))).otherwise(under)
    ids = rows.where(place < under).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most about ``bound`` rows, by the share above: small enough to send to every task
    return [(text, y) for _, text, y in sorted(within(docs, ids, characters))]
