"""Q08, UD06: lines that refer to other lines and statements."""

from collections import Counter

import pytest

from posada.operators import accounts


def line(estado, ref, padre=None, formula=()):
    return {"estado": estado, "ref": ref, "padre": padre, "formula": list(formula)}


def test_lines_are_resolved_in_order_of_dependence():
    form = [line("ecpn", "T", formula=["RA", "balance:P", "nowhere"]), line("ecpn", "RA", formula=["pyg:D"]), line("pyg", "D", formula=["1", "2", "1"]), line("pyg", "1"), line("pyg", "2"), line("balance", "P"), line("balance", "P.1", "P"), line("balance", "P.1.a", "P.1")]
    got = accounts.resolved(form)
    p = Counter({("balance", k): 1 for k in ("P", "P.1", "P.1.a")})
    assert got["balance", "P"] == p and got["pyg", "D"] == got["ecpn", "RA"] == Counter({("pyg", "1"): 2, ("pyg", "2"): 1}) and got["ecpn", "T"] == p + got["pyg", "D"]


def test_a_cycle_is_named():
    with pytest.raises(ValueError, match="pyg:A -> balance:B -> pyg:A"):
        accounts.resolved([line("pyg", "A", formula=["balance:B"]), line("balance", "B", formula=["pyg:A"])])
    with pytest.raises(ValueError, match="pyg:A -> pyg:B -> pyg:A"):
        accounts.resolved([line("pyg", "A"), line("pyg", "B", "A", formula=["A"])])
