"""Links found after the first groups: these groups are joined, not only added to."""

import pytest

from textward.llm import p1_near_copies as p1


@pytest.mark.parametrize(
    ("fresh", "want"),
    [
        # a chain over two groups and a new node; the third group stays
        ([(2, 4), (4, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 5: 5, 6: 5}),
        # only inside a group: nothing changes
        ([(1, 2)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}),
        # two nodes of no group yet
        ([(7, 8)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}),
    ],
)
def test_groups_joined_by_further_links(spark, fresh, want):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, root long")
    links = spark.createDataFrame(fresh, "a long, b long")
    rows = p1.regrouped(roots, links).collect()
    assert len(rows) == len(want)
    assert {r.node: r.root for r in rows} == want
