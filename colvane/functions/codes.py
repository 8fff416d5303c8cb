"""Huffman codes of characters, as column functions; the code itself is made on the driver from one row a character."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """(c, n): how often each character occurs in all texts; null and empty texts have none."""
    return df.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))


def huffman(counts: DataFrame) -> dict[str, str]:
    """Character -> bits, from (c, n). Ties go to the smaller character; a lone character has one bit.

    Only distinct characters reach the driver: at most as many as there are code points, whatever the size of the texts.
    """
    heap = [(r["n"], r["c"], [r["c"]]) for r in counts.collect()]
    heapq.heapify(heap)
    code = {c: "" if len(heap) > 1 else "0" for _, c, _ in heap}
    while len(heap) > 1:
        (n, c, low), (m, d, high) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in (("0", low), ("1", high)):
            for x in side:
                code[x] = bit + code[x]
        heapq.heappush(heap, (n + m, min(c, d), low + high))
    return code


def _map(code: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in sorted(code.items()) for x in pair]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))


def encode(text: Column, code: dict[str, str]) -> Column:
    """The text's bits; null if it is null or has a character without a code."""
    bits = _map(code)
    parts = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(bits, c))
    return F.when(~F.exists(parts, lambda b: b.isNull()), F.array_join(parts, ""))


def decode(bits: Column, code: dict[str, str]) -> Column:
    """The text of bits; null if they are null or end inside a code."""
    back = _map({b: c for c, b in code.items()})
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("text"))

    def step(s, bit):
        found = F.try_element_at(back, F.concat(s["open"], bit))
        return F.struct(F.when(found.isNull(), F.concat(s["open"], bit)).otherwise("").alias("open"), F.concat(s["text"], F.coalesce(found, F.lit(""))).alias("text"))

    return F.aggregate(F.filter(F.split(bits, ""), lambda b: b != ""), start, step, lambda s: F.when(s["open"] == "", s["text"]))
