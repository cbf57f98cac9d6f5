"""UD02: rates from printed amounts, against the row-wise solver."""

import random
from decimal import Decimal

from posada.operators import extraction, rates


def solve(spark, docs):
    """docs: id -> (subtotal, amounts, printed rates as halves), all in cents."""
    sub = spark.createDataFrame([(k, s) for k, (s, _, _) in docs.items()], "document_id long, subtotal long")
    printed = spark.createDataFrame([(k, a) for k, (_, xs, _) in docs.items() for a in xs], "document_id long, amount long")
    numbers = spark.createDataFrame([(k, r) for k, (_, _, rs) in docs.items() for r in rs], "document_id long, rate int")
    return {r.document_id: r for r in rates.infer(sub, printed, numbers).collect()}


def invoice(rng, parts):
    kinds = rng.sample([8, 10, 20, 42, 60, 1], parts)
    bases = [rng.randint(500, 90_000) for _ in kinds]
    quotas = [(b * r + 100) // 200 for b, r in zip(bases, kinds)]
    return sum(bases), [*bases, *quotas, sum(bases), sum(bases) + sum(quotas), *(rng.randint(1, 100_000) for _ in range(6))], kinds


def test_against_the_row_wise_solver(spark):
    rng = random.Random(2)
    docs = {k: invoice(rng, 1 + k % 3) for k in range(60)} | {100: (1000, [1000, 5], []), 101: (0, [3], []), 102: (1000, [], [])}
    got = solve(spark, docs)
    d = lambda x: Decimal(x) / 100
    for k, (subtotal, amounts, shown) in docs.items():
        want = extraction.infer_rates(d(subtotal), {d(a) for a in amounts}, {Decimal(r) / 2 for r in shown}) if subtotal else None
        assert (k in got) == (want is not None), k
        if want:
            r = got[k]
            assert ({Decimal(x) / 2: d(q) for x, q in zip(r.rates, r.quotas)}, d(r.total)) == want and sum(r.bases) == subtotal
    assert {len(r.bases) for r in got.values()} == {1, 2, 3}


def test_a_thousand_printed_amounts(spark):
    rng = random.Random(3)
    subtotal, amounts, shown = invoice(rng, 3)
    amounts += [rng.randint(1, 10**7) for _ in range(1000)]
    got = solve(spark, {1: (subtotal, amounts, shown)})
    assert sum(got[1].bases) == subtotal and set(got[1].bases) <= set(amounts) and set(got[1].quotas) <= set(amounts) and got[1].total in amounts
