"""License scan: ordered signature rules, gated by keywords, with overlaps resolved.

A text's words are met with the rules' keywords first; only rules whose keyword occurs run their
pattern. Detections are then resolved by priority: one that lies within an accepted detection of
higher priority is dropped, and so is one that lies within another of its own priority. Base
phrases count at every place and keep their label whatever suppresses them.

A row depends on its text alone. Null and empty texts have no words and no labels. Repeated rows
give repeated results. Columns of the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_rules import BASE, RULES

#: Confidence that a detection of some priority gives.
CONFIDENCE = {1: 0.5, 2: 0.7, 3: 0.85, 4: 0.95}


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    base: bool


class Hit(NamedTuple):
    start: int  # bytes in the joined words
    end: int
    rule: Rule


def rules() -> list[Rule]:
    """The base phrases, then RULES."""
    found = [(label, 1, phrase.split()[0], phrase, True) for phrase, label in BASE.items()]
    found += [(*(x.strip() for x in line.split(" | ", 3)), False) for line in RULES.strip().splitlines()]
    return [Rule(k, label, int(p), key.encode(), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )"), base) for k, (label, p, key, pattern, base) in enumerate(found)]


def resolve(hits: list[Hit]) -> list[Hit]:
    """Drops hits that lie within an accepted hit of higher priority, or within one of their own."""
    accepted: list[Hit] = []
    for priority in sorted({h.rule.priority for h in hits}, reverse=True):
        accepted.sort()
        starts, reach, far = [h.start for h in accepted], [], 0
        for h in accepted:
            far = max(far, h.end)
            reach.append(far)
        far = -1
        for h in sorted((h for h in hits if h.rule.priority == priority), key=lambda h: (h.start, -h.end, h.rule.order)):
            k = bisect_right(starts, h.start) - 1
            if h.end > far and not (k >= 0 and reach[k] >= h.end):
                accepted.append(h)
                far = h.end
    return sorted(accepted)


class Scanner:
    def __init__(self) -> None:
        self.by_key: dict[bytes, list[Rule]] = {}
        for r in rules():
            self.by_key.setdefault(r.keyword, []).append(r)
        self.keys = frozenset(self.by_key)

    def hits(self, words: list[bytes]) -> tuple[bytes, list[Hit]]:
        keys = self.keys.intersection(words)
        if not keys:
            return b"", []
        joined = b" " + b" ".join(words) + b" "
        return joined, sorted(Hit(m.start(), m.end(), r) for k in keys for r in self.by_key[k] for m in r.pattern.finditer(joined))

    def scan(self, payload: bytes | None) -> tuple:
        words = common.words(payload)
        joined, hits = self.hits(words)
        base, kept = [h for h in hits if h.rule.base], resolve(hits)
        at, seen, done = {}, 0, 0  # word numbers of places: the spaces before them
        for h in sorted([*base, *kept]):
            seen, done = seen + joined.count(b" ", done, h.start), h.start
            at[h.start] = seen - 1
        labels = {h.rule.label for h in base} | {h.rule.label for h in kept}
        detections = [{"label": h.rule.label, "priority": h.rule.priority, "word": at[h.start], "n_words": joined.count(b" ", h.start, h.end) + 1} for h in kept]
        return (
            len(words), len(base), at[base[0].start] if base else None, at[base[-1].start] if base else None,
            ",".join(sorted({h.rule.label for h in base})), ",".join(sorted(labels)), max((CONFIDENCE[h.rule.priority] for h in [*base, *kept]), default=0.0), detections,
        )


_DETECTION = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("word", pa.int64()), ("n_words", pa.int64())])
_OUT = [
    ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()),
    ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()),
    ("detections", "array<struct<label:string,priority:int,word:long,n_words:long>>", pa.list_(_DETECTION)),
]


def scan(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` with the columns of carry (None: all), the scan's digest, and its resolved detections."""

    def start():
        scanner = Scanner()
        return lambda texts: zip(*map(scanner.scan, texts), strict=True)

    return common.map_texts(df, text_col, df.columns if carry is None else carry, start, _OUT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir), carry=["doc_id"])
    return found.select("row.doc_id", *[x[0] for x in _OUT[:-1]], F.size("detections").cast("long").alias("n_detections"))
