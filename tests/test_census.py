"""The census works its facts out once, and its percentiles are those of the values written out."""

import math
import random

from pagelume.operators import census
from pagelume.operators.ranks import floor_percentiles

FACTS = "doc bigint, page_index bigint, placement_index bigint, is_top boolean, n_placements bigint, page_reason string, shear_deg double, skew_deg double, degenerate boolean"


def test_census_works_facts_out_once(spark):
    rng = random.Random(7)
    rows = []
    for page in range(300):
        n, reason = rng.randrange(0, 5), rng.choice(["", "", "has-text", None])
        for k in range(n) if n else (-1,):
            bad = k >= 0 and rng.random() < 0.2
            shear = None if bad or k < 0 or rng.random() < 0.05 else rng.choice([0.0, 0.01, 0.07, 0.3, 1.0, 1.7, 2.0, 3.0, 20.0])
            # every third page has two placements on top
            rows.append((page % 40, page, k, k >= 0 and k >= n - 1 - (page % 3 == 0), n, reason, shear, rng.choice([0.5, 2.0, 2.5, None]), bad))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {(r.section, r.name): r.value for r in census.placement_census(spark.createDataFrame(rows, FACTS).mapInArrow(count, FACTS)).collect()}
    assert seen.value == len(rows)

    pages = {}
    for r in rows:
        pages.setdefault(r[1], []).append(r)
    sound = [r for r in rows if r[2] >= 0 and not r[8]]
    gate = {id(r) for r in sound if r[6] is not None and r[6] <= 2 and r[7] is not None and r[7] <= 2}
    clean = [p for p in pages.values() if p[0][5] == ""]
    want = {("total", "documents"): len({r[0] for r in rows}), ("total", "pages"): len(pages), ("total", "image_bearing_pages"): sum(p[0][4] > 0 for p in pages.values())}
    want |= {("total", "placements"): sum(r[2] >= 0 for r in rows), ("total", "degenerate_placements"): sum(r[2] >= 0 and r[8] for r in rows)}
    want["total", "degenerate_top_pages"] = sum(any(r[3] and r[8] for r in p) for p in pages.values())
    tops = [max((r[6] for r in p if r[3] and not r[8] and r[6] is not None), default=None) for p in pages.values()]
    for i, label in enumerate(census.LABELS):
        low = -1 if i == 0 else census.EDGES[i - 1]
        want["placement", label] = sum(r[6] is not None and low < r[6] <= census.EDGES[i] for r in sound)
        want["page_top", label] = sum(v is not None and low < v <= census.EDGES[i] for v in tops)
    for t in census.THRESHOLDS:
        want["gated_top", f"{t:g}"] = sum(any(id(r) in gate and r[6] > t and r[3] for r in p) for p in clean)
        want["gated_any", f"{t:g}"] = sum(any(id(r) in gate and r[6] > t for r in p) for p in clean)
    for section, some in (("placement_percentile", sound), ("page_top_percentile", [r for r in sound if r[3]])):
        values = sorted(r[6] for r in some if r[6] is not None)
        want |= {(section, name): values[math.floor(p * (len(values) - 1))] for name, p in census.SHARES.items()}
    assert got == want


def test_census_of_nothing_has_totals_of_0_and_no_percentiles(spark):
    rows = census.placement_census(spark.createDataFrame([], FACTS)).collect()
    assert len(rows) == 36 and all(r.value == 0 for r in rows)


def test_percentiles_of_counted_values_are_those_of_the_values(spark):
    rng = random.Random(8)
    rows = [(None if i == 5 else rng.choice([rng.random(), i / 7]), rng.randrange(0, 4), int(i == 3), 0) for i in range(500)]
    got = floor_percentiles(spark.createDataFrame(rows, "x double, a bigint, b bigint, c bigint").repartition(7), "x", {"many": "a", "one": "b", "none": "c"}, census.SHARES)
    want = {("one", name, rows[3][0]) for name in census.SHARES}
    values = sorted(x for x, a, _, _ in rows if x is not None for _ in range(a))
    want |= {("many", name, values[math.floor(p * (len(values) - 1))]) for name, p in census.SHARES.items()}
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want
