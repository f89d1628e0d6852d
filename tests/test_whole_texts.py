"""Script alignment reads whole texts."""

import pytest

from cueloom.operators import script_alignment as sa
from cueloom.plans import catalog
from cueloom.plans.fixtures import table


def test_alignment_is_given_whole_texts(spark, sf, monkeypatch):
    """Units, and items as a part of them, are the turns' texts to their ends."""
    given = {}
    monkeypatch.setattr(sa, "align_scripts", lambda units, items: given.update(units=units, items=items) or units)
    catalog.QUERIES["l9_script_alignment"](spark, sf)
    want = {(r["conv_id"], r["turn"]): (r["text"] or "").lower() for r in table(spark, sf, "conversations").select("conv_id", "turn", "text").collect()}
    assert max(map(len, want.values())) > 30
    assert {(r["audio_id"], r["pos"]): r["norm"] or "" for r in given["units"].collect()} == want
    back = lambda a, p: 100 - p if a % 4 == 0 else p
    assert {(r["audio_id"], back(r["audio_id"], r["pos"])): r["norm"] or "" for r in given["items"].collect()} == {k: t for k, t in want.items() if k[1] % 3 != 2}


@pytest.mark.parametrize("tail, same", [(" and so to the end", True), (" but it ends quite another way, in many more words than before", False)])
def test_equal_beginnings_are_no_exact_match(tail, same):
    start = "the same thirty letters to begin with"
    matches, _ = sa.align_region([start + " and so to the end"], [start + tail])
    assert [m[4] == 1.0 for m in matches] in ([same], [])
