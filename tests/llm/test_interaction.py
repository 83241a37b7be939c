"""The filters' interaction against a walk through every order, document by document."""

import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import interaction

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, _ in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append({k for k, v in own.items() if v})
    good, toxic = ({r[0] for r in labels if r[j] == 1 and r[0] is not None} for j in (1, 2))
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(docs[k][0], fails[k]) for k in range(len(docs)) if (docs[k][2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in mine), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for order, step in itertools.product(map("".join, itertools.permutations("ABCDE")), range(1, 6)):
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in interaction.COUNTS] for r in df.collect()}


def test_audit_equals_walking_every_order(spark):
    rng = np.random.default_rng(12)
    docs = []
    for i in range(150):
        n = int(rng.choice([0, 5, 199, 200, 260]))
        ws = [f"w{k}" for k in rng.integers(int(rng.choice([30, 5000])), size=n)]
        if n and rng.random() < 0.4:
            ws[0] = "#" if rng.random() < 0.5 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3
        text = str(rng.choice([" ", "\n", "\x1c", "\x85 "])).join(ws)
        docs.append((i, text, str(rng.choice(["a", "b", "c"]))))
        if rng.random() < 0.3:
            docs.append((int(rng.integers(200)), text, "a"))
    docs += [(None, docs[5][1], "b"), (3, None, None), (3, None, None), (1, "", "")] + [(500 + i, "same text", "hot") for i in range(60)]
    docs += [(900, "Ä🎉" * 3 + "B", "chars"), (901, "word " * 40000, "long"), (902, "Xy " * 40000, "long")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(200, size=150)] + [(None, 1, 1), (4, None, None)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("mask", "part", "one", "good", "words")}).repartition(3)
    assert found(interaction.audited(df, spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interaction.audited(none, no_labels).count() == 0
    assert interaction.audited(spark.createDataFrame([(1, "a", "s")], DOCS), no_labels).count() == 600
