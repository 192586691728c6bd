"""Licence expressions of any length are read to their end."""

from proofloom.llm import licenses


def test_long_expression():
    names = [f"LicenseRef-part-{i}" for i in range(200)]
    _, _, _, _, _, labels, expression, grade, _ = licenses.scan("SPDX-License-Identifier: (MIT AND " + " AND ".join(names) + ") OR GPL-2.0-only\nmore text")
    assert {x for x in labels.split(",") if x.startswith("id:licenseref")} == {f"id:{n.lower()}" for n in names}
    assert "id:gpl-2.0-only" in labels.split(",") and expression.endswith("gpl-2.0-only or") and grade == 1


def test_tags_of_one_line():
    for gap in (" ", " and so on " * 100):
        labels = licenses.scan("SPDX-License-Identifier: MIT" + gap + "SPDX-License-Identifier: GPL-2.0-only")[5].split(",")
        assert "id:mit" in labels and "id:gpl-2.0-only" in labels
