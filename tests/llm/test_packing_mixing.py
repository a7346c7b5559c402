import itertools
import random

import numpy as np
import pytest

from casewright.llm.mixing import mix_sources, sized_records
from casewright.llm.packing import DIMS, Packer, best_fit, fill_report, hilbert_key, pack_documents
from casewright.llm.tokens import encoding


def test_hilbert_is_a_curve():
    """Neighbours on the curve are neighbours in space, and every cell has its own place."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packer_keeps_everything():
    r = random.Random(2)
    items = [(i, r.choice([0, 1, 7, 40, 99, 100, 101, 250, 1000])) for i in range(4000)]
    p = Packer(100, 16)
    bins = [b for i, n in items for b in p.add(i, n)] + p.close()
    sums: dict[int, int] = {}
    for b in bins:
        assert sum(s for s, _, _ in b) <= 100
        for s, i, _ in b:
            sums[i] = sums.get(i, 0) + s
    assert sums == dict(items)
    used = sum(n for _, n in items)
    assert used / (100 * sum(1 for b in bins if any(s for s, _, _ in b))) > 0.98
    assert best_fit([], 5) == []


def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta file host".split()) for _ in range(r.choice([1, 5, 30, 120]))), r.choice("abbcccc")) for i in range(600)]
    rows += [(600, "", "a"), (601, None, "a"), (602, "word " * 3000, "b"), (603, "same text", "c"), (604, "same text", "c"), (None, "x", "a"), (605, "x", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n_tokens", "2 AS _key")


def test_pack_documents(spark):
    df = docs(spark)
    caps = {"small": 64, "large": 500}
    out = pack_documents(df, caps, containers_per_range=4).collect()
    want = {r["doc_id"]: len(encoding().encode_ordinary(r["text"] or "")) for r in df.collect() if r["doc_id"] is not None}
    for kind, cap in caps.items():
        got, load, parts = {}, {}, {}
        for r in out:
            if r["pack_kind"] == kind:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
                load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
                parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + 1
        assert got == want and max(load.values()) <= cap
        assert all(n == 1 for d, n in parts.items() if want[d] <= cap)
    assert {r["pack_kind"]: r["fill"] for r in fill_report(pack_documents(df, caps, containers_per_range=1000), caps).collect()}["small"] > 0.97
    assert pack_documents(df.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, {"x": 0})
    assert DIMS * 10 < 63


def test_mix_sources(spark):
    sized = sized_records(docs(spark), "doc_id", "source", "text").cache()
    have = {r[0]: r[1] for r in sized.groupBy("_source").sum("_n").collect()}
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.2, 2), ("none", 0.1, 4), (None, 0.3, 1), ("a", 0.1, 9)], "source string, target_share double, max_repeats int")
    records, report = mix_sources(sized, targets)
    rows = {r["source"]: r for r in report.collect()}
    total = sum(r["used_tokens"] for r in rows.values())
    # a threshold cuts between records: each source is off by half of its largest record at most, and so is the total by source
    largest = {r[0]: r[1] for r in sized.groupBy("_source").max("_n").collect()}
    off = sum(largest[s] / 2 for s in "abc")
    for s in "abc":
        assert abs(rows[s]["used_tokens"] - rows[s]["adjusted_share"] * total) <= largest[s] / 2 + rows[s]["adjusted_share"] * off + 1
        assert rows[s]["most_copies"] <= rows[s]["max_repeats"] and rows[s]["available_tokens"] == have[s]
    assert rows["none"]["used_tokens"] == 0 and abs(sum(rows[s]["adjusted_share"] for s in "abc") - 1) < 1e-9
    small = {r["doc_id"]: r["n_copies"] for r in mix_sources(sized, targets, total / 4)[0].collect()}
    large = {r["doc_id"]: r["n_copies"] for r in records.collect()}
    assert all(large.get(d, 0) >= n for d, n in small.items()), "budgets are nested"
    empty, rep = mix_sources(sized.limit(0), targets)
    assert empty.count() == 0 and all(r["used_tokens"] == 0 for r in rep.collect())
