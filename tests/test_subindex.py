"""The sub-index of a chunk on hand-written cases."""

from stackmill.operators.subindex import cited, sub_index


def asset(i, kind, number, page, y, caption=None):
    return {"asset_id": i, "kind": kind, "number": number, "page": page, "y": y, "caption": caption}


def shape(subs):
    return [(s["kind"], s["text"], s["asset_ids"]) for s in subs]


def test_cited_sentences_get_their_assets():
    subs = sub_index("如图5-1所示。plain！见表5-2", [asset(1, "figure", "5-1", 10, 100, "图5-1"), asset(2, "table", "5-2", 10, 300, "new words")])
    assert shape(subs) == [("ref", "如图5-1所示。", [1]), ("ref", "见表5-2", [2])]
    assert subs[0]["index_text"] == "如图5-1所示。" and subs[1]["index_text"] == "见表5-2\nnew words"


def test_gap_text_takes_what_lies_between():
    assets = [asset(1, "figure", "1-1", 1, 100), asset(2, "figure", None, 1, 200), asset(3, "figure", "1-2", 1, 300)]
    assert shape(sub_index("如图1-1！between！如图1-2！", assets)) == [("ref", "如图1-1！", [1]), ("gap", "between！", [2]), ("ref", "如图1-2！", [3])]


def test_without_gap_text_the_nearer_side_wins_and_ties_go_back():
    near = [asset(1, "figure", "1-1", 1, 100), asset(2, "figure", None, 1, 280), asset(3, "figure", "1-2", 1, 300)]
    assert shape(sub_index("如图1-1！如图1-2！", near)) == [("ref", "如图1-1！", [1]), ("ref", "如图1-2！", [3, 2])]
    tie = [near[0], asset(2, "figure", None, 1, 200), near[2]]
    assert shape(sub_index("如图1-1！如图1-2！", tie))[0][2] == [1, 2]


def test_merging_moves_the_anchor():
    assets = [asset(1, "figure", "1-1", 1, 100), asset(4, "figure", None, 1, 400), asset(2, "figure", "1-2", 1, 300)]
    # after the last reference: 4 lies below it and there is no text, so it joins the last sentence
    assert shape(sub_index("如图1-1！如图1-2！", assets)) == [("ref", "如图1-1！", [1]), ("ref", "如图1-2！", [2, 4])]


def test_no_reference_and_nothing():
    assert shape(sub_index("plain", [asset(1, "figure", None, 1, 1, "cap")])) == [("gap", "", [1])]
    assert sub_index(None, []) == [] and sub_index("plain", []) == []
    assert cited("Figure 2-03 and figure 2-3") == [("figure", "2-3")]
