import re
from itertools import product

from stemline.llm import licenses

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    found = licenses.scan(rows, carry=["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["row"]["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_overlapping_detections_are_resolved():
    scan = licenses.Scanner().scan
    *_, labels, score, detections = scan(b"Licensed under the Apache License, Version 2.0 (the License); CC BY-SA 4.0, mit license mit license")
    assert [(d["label"], d["word"], d["n_words"]) for d in detections] == [("apache-2.0", 0, 8), ("cc-by-sa-4.0", 10, 5), ("mit", 15, 2), ("mit", 16, 2), ("mit", 17, 2)]
    assert labels == "apache,apache-2.0,cc-by,cc-by-sa-4.0,mit" and score == 0.95
    assert scan(b"cc by cc by")[:5] == (4, 2, 0, 2, "cc-by")
    assert scan(b"agplv3 by permit licenses") [5] == "agpl-3.0"


def test_there_are_hundreds_of_rules_gated_by_a_word_they_need():
    rules = licenses.rules()
    assert len(rules) > 200
    assert not any(r.pattern.search(b" lorem ipsum ") for r in rules)


def matches(tree):
    """Texts that a parsed pattern matches: every branch and character, repeats at their fewest and once."""
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) for o, v in value if str(o) == "LITERAL"] or ["x"])
        elif name == "BRANCH":
            parts.append([t for branch in value[1] for t in matches(branch)])
        elif name == "SUBPATTERN":
            parts.append(matches(value[-1]))
        elif name == "MAX_REPEAT":
            least, _, inner = value
            parts.append([t * n for n in {least, max(least, 1)} for t in matches(inner)])
        else:
            assert name in ("ASSERT", "AT"), name
    return ["".join(p) for p in product(*parts)]


def test_every_rule_runs_on_all_that_its_pattern_matches():
    for r in licenses.rules():
        texts = matches(re._parser.parse(r.pattern.pattern.decode()))
        assert texts and all(r.pattern.search(f" {t} ".encode()) for t in texts)
        assert [t for t in texts if r.keyword.decode() not in t.split()] == [], r


def test_rules_whose_words_are_parted_by_hyphens():
    scan = licenses.Scanner().scan
    for text in (b'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND', b"distributed on an AS-IS basis, without warranties or conditions of any kind"):
        assert scan(text)[5:7] == ("apache-2.0", 0.85)
    assert scan(b"Creative Commons Attribution Non-Commercial No-Derivs")[5] == "cc-by-nc-nd"


def test_odd_rows(odd, none):
    found = licenses.scan(odd)
    assert found.count() == odd.count() and set(found.first()["row"].asDict()) == set(odd.columns)
    by = {(r["row"]["doc_id"], r["row"]["text"] is None): r for r in found.collect()}
    assert by[1, False]["base_labels"] == "mit" and by[3, True]["n_words"] == by[2, False]["n_words"] == 0 and by[3, True]["labels"] == ""
    assert by[4, False]["n_words"] == 40_000 and by[4, False]["n_base"] > 100
    assert licenses.scan(none).count() == 0
